"""Replayed steps against pandas and NumPy, and what is refused."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryline.operators import replay as R


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, None if i in (1, 4) else float(i * 3 % 7), ["red", "blue", None][i % 3], i % 2) for i in range(8)]
    return spark.createDataFrame(rows, "row_id long, value double, colour string, target long")


def ids(frame):
    return sorted(r.row_id for r in frame.data.collect())


def test_dropna_keeps_source_positions(people):
    frames = R.replay([{"operation": "load", "path": "p", "output": "df"}, {"operation": "dropna", "input": "df", "output": "clean", "subset": ["value"]}], {"p": people}, ["clean"])
    assert ids(frames["clean"]) == [0, 2, 3, 5, 6, 7]
    assert sorted(r.row_id for r in R.removed_rows(people, frames["clean"].data).collect()) == [1, 4]
    assert tuple(R.row_loss(people, frames["clean"].data).first()) == (8, 6, 2, 0.25)


@pytest.mark.parametrize("drop_first", [False, True])
@pytest.mark.parametrize("dummy_na", [False, True])
def test_one_hot_like_pandas(people, drop_first, dummy_na):
    got = R.one_hot(R.load(people), ["colour"], drop_first, dummy_na)
    want = pd.get_dummies(people.orderBy("row_id").toPandas().drop(columns="row_id"), columns=["colour"], drop_first=drop_first, dummy_na=dummy_na, dtype=int)
    assert got.columns() == list(want.columns)
    table = got.data.orderBy("row_id").toPandas()
    for c in want.columns[2:]:
        assert table[c].tolist() == want[c].tolist()
    assert got.sources[want.columns[-1]] == {"colour"}


def test_standard_scaler(people):
    got = R.standard_scale(R.drop_null_rows(R.load(people), ["value"]), ["value", "target"]).data.orderBy("row_id").toPandas()
    raw = people.toPandas().dropna(subset=["value"])
    for c in ("value", "target"):
        assert np.allclose(got[c], (raw[c] - raw[c].mean()) / raw[c].std(ddof=0))


@pytest.mark.parametrize(("start", "stop", "step"), [(None, None, 1), (2, None, 1), (None, 5, 2), (-3, None, 1), (None, -2, 1), (1, 7, 3), (20, None, 1)])
def test_slices(people, start, stop, step):
    assert ids(R.slice_rows(R.load(people), start, stop, step)) == list(range(8))[start:stop:step]


def test_loc_is_inclusive_and_iloc_is_not(people):
    f = R.drop_null_rows(R.load(people), ["value"])
    assert ids(R.select_labels(f, slice(2, 6))) == [2, 3, 5, 6]
    assert ids(R.select_at(f, slice(1, 3), [0])) == [2, 3] and R.select_at(f, [0, 5], [0, 2]).columns() == ["value", "target"]


def test_absent_columns_leave_the_frame_alone(people):
    f = R.load(people)
    assert R.select_columns(f, ["value", "nope"]) is f and R.drop_columns(f, ["nope"]) is f


def test_split_like_numpy(people):
    train, test = R.random_split(R.load(people), 0.25, 42)
    order = np.random.RandomState(42).permutation(8)
    assert ids(test) == sorted(order[:2].tolist()) and ids(train) == sorted(order[2:].tolist())


def test_a_split_of_more_than_a_million_rows(spark):
    n = 1_000_003
    train, test = R.random_split(R.load(spark.range(n).withColumnRenamed("id", "row_id")), 0.2, 42)
    order = np.random.RandomState(42).permutation(n)
    take = int(np.ceil(n * 0.2))
    got = np.sort(test.data.toPandas()["row_id"].to_numpy())
    assert (got == np.sort(order[:take])).all() and train.data.count() == n - take


def test_placeholder_makes_a_partial_column(people):
    f = R.set_column(R.load(people), "made", literal=False)
    assert f.partial == {"made"} and R.select_columns(f, ["value"]).partial == set()


def test_casts(people):
    f = R.cast(R.load(people), {"target": "float64", "value": "str"})
    assert dict(f.data.dtypes)["target"] == "double" and dict(f.data.dtypes)["value"] == "string"
    with pytest.raises(R.Unreplayable):
        R.cast(R.load(people), "complex128")


def test_unknown_steps_matter_only_where_they_are_needed(people):
    steps = [
        {"operation": "load", "path": "p", "output": "df"},
        {"operation": "lambda", "input": "df", "output": "odd"},
        {"operation": "column_selection", "input": "df", "output": "x", "columns": ["value"]},
    ]
    assert R.replay(steps, {"p": people}, ["x"])["x"].columns() == ["value"]
    with pytest.raises(R.Unreplayable):
        R.replay(steps, {"p": people}, ["odd"])
    for wrong in ({"stratify": "colour", "random_state": 1}, {}):
        with pytest.raises(R.Unreplayable):
            R.replay([steps[0], {"operation": "train_test_split", "input": "df", "outputs": ["a", "b"], **wrong}], {"p": people}, ["a"])


def test_drop_duplicates_keeps_the_first(people):
    assert ids(R.drop_duplicate_rows(R.load(people), ["colour", "target"])) == [0, 1, 2, 3, 4, 5]


def test_positions_are_those_of_the_order(spark):
    df = spark.range(0, 5000, 7).repartition(9)
    got = sorted((r.id, r._pos) for r in R.with_positions(df, "id").collect())
    assert got == [(x, i) for i, x in enumerate(range(0, 5000, 7))]


def test_a_stratified_split_against_plain_numpy(spark):
    """Each class permuted by itself, its first rows for training; whole shares first, then the largest rests."""
    import numpy as np

    kinds = ["a"] * 41 + ["b"] * 23 + ["c"] * 36
    order = np.random.default_rng(3).permutation(100)
    rows = [(i, kinds[k]) for i, k in enumerate(order.tolist())]
    f = R.load(spark.createDataFrame(rows, "row_id long, kind string"))
    train, test = R.random_split(f, 0.25, 11, "kind")
    rng, n_test = np.random.RandomState(11), 25
    members = {c: [i for i, k in rows if k == c] for c in "abc"}
    exact = {c: len(m) * 75 / 100 for c, m in members.items()}  # 30.75, 17.25, 27
    to_train = {c: int(x) for c, x in exact.items()}
    rng.choice(np.array([0]), size=1, replace=False)  # the one that is missing goes to the largest rest, of a
    to_train["a"] += 1
    want = []
    for c in "abc":
        p = rng.permutation(len(members[c]))
        want += [members[c][k] for k in p[to_train[c] :]]
    assert len(want) == n_test and sorted(r.row_id for r in test.data.collect()) == sorted(want)
    assert sorted(r.row_id for r in train.data.collect()) == sorted({i for i, _ in rows} - set(want))
    for bad in (f.data.where("row_id < 3").withColumn("kind", F.col("row_id").cast("string")), f.data.withColumn("kind", F.lit(None).cast("string"))):
        with pytest.raises(R.Unreplayable):
            R.random_split(R.load(bad), 0.25, 11, "kind")


def test_label_slices_with_a_step_and_dummy_options(spark):
    f = R.load(spark.createDataFrame([(i, "xy"[i % 2], i) for i in range(20)], "row_id long, kind string, n int"))
    assert [r.row_id for r in R.select_labels(f, slice(3, 15, 4)).data.orderBy("row_id").collect()] == [3, 7, 11, 15]
    made = R.one_hot(f, ["kind"], prefix={"kind": "k"}, sep="=", dtype="bool", input_columns=["kind", "n"])
    assert made.data.columns == ["row_id", "n", "k=x", "k=y"] and dict(made.data.dtypes)["k=x"] == "boolean"
    assert made.sources["k=x"] == {"kind"}
    assert R.one_hot(f, ["n"]).data.columns[2:5] == ["n_0", "n_1", "n_2"]  # in the order of numbers
    assert R.one_hot_long(f, ["kind"]).count() == 20
    with pytest.raises(R.Unreplayable):
        R.one_hot(f, ["kind"], input_columns=["gone"])
    assert R.preprocess(f, "RobustScaler", ["n"]).partial == {"n"}
    with pytest.raises(R.Unreplayable):
        R.preprocess(f, "Mystery", ["n"])


def test_more_values_than_may_become_columns_are_refused(spark, monkeypatch):
    f = R.load(spark.range(60).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("kind"), (F.col("id") % 30).alias("n")))
    with pytest.raises(R.Unreplayable, match="60 values"):
        R.one_hot(f, ["kind"], most=50)
    assert len(R.one_hot(f, ["kind"], most=60).data.columns) == 62
    monkeypatch.setattr(R, "MOST_CLASSES", 10)
    with pytest.raises(R.Unreplayable, match="classes"):
        R.random_split(f, 0.5, 1, stratify="n")
