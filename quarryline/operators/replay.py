"""Replay of a recorded list of dataframe steps as one lazy DataFrame chain.

A step is a dict with ``operation``, ``input``, ``output`` and parameters.  Nothing is executed
from user code: an operation that isn't known makes its output unknown, and the replay refuses
only if what it was asked for depends on it.  Rows keep the position they had in the source
(``row_id``), so train and test membership and removed rows are stated in source positions.
Columns keep the source columns that they were made from.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.duplicates import keep_first
from quarryline.sources.scratch import written

ROW = "row_id"
#: Positions of a split whose parts are told in one row of bits; a multiple of 8.
BLOCK = 8192
#: The types a cast may name, and what they are here.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "float": "double",
    "bool": "boolean", "boolean": "boolean", "str": "string", "string": "string", "object": "string", "category": "string",
    "datetime64[ns]": "timestamp",
}
#: Preprocessors that keep rows, besides the one that is replayed exactly.
PREPROCESSORS = ("MinMaxScaler", "RobustScaler", "MaxAbsScaler", "Normalizer", "SimpleImputer", "OrdinalEncoder", "LabelEncoder")


class Unreplayable(ValueError):
    """What was asked for depends on a step whose effect is unknown."""


@dataclass
class Frame:
    """A frame of the replay: its rows, the source columns of each column, how sure the values are."""

    data: DataFrame
    sources: dict[str, set[str]]
    partial: set[str] = field(default_factory=set)

    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c != ROW]

    def having(self, data: DataFrame, **changed: set[str]) -> Frame:
        kept = {c: s for c, s in ({**self.sources, **changed}).items() if c in data.columns}
        return Frame(data, kept, {c for c in self.partial if c in data.columns})


def load(df: DataFrame) -> Frame:
    return Frame(df, {c: {c} for c in df.columns if c != ROW})


def select_columns(f: Frame, columns: Sequence[str]) -> Frame:
    """Only these columns; unchanged where one of them is absent."""
    return f.having(f.data.select(ROW, *columns)) if set(columns) <= set(f.columns()) else f


def drop_columns(f: Frame, columns: Sequence[str]) -> Frame:
    return f.having(f.data.drop(*columns)) if set(columns) <= set(f.columns()) else f


def set_column(f: Frame, column: str, value=None, literal: bool = True) -> Frame:  # noqa: ANN001
    """A constant column; a value that isn't a literal leaves a placeholder and a partial column."""
    out = f.having(f.data.withColumn(column, F.lit(value if literal else 0)), **{column: set()})
    return Frame(out.data, out.sources, (out.partial - {column}) | (set() if literal else {column}))


def cast(f: Frame, types: Mapping[str, str] | str) -> Frame:
    types = {c: types for c in f.columns()} if isinstance(types, str) else types
    if bad := [t for t in types.values() if t not in TYPES]:
        raise Unreplayable(f"unknown type {bad[0]}")
    return f.having(f.data.withColumns({c: F.col(c).try_cast(TYPES[t]) for c, t in types.items() if c in f.columns()}))


#: Columns that one_hot makes at most, unless the caller allows more, and classes of a stratified split.
MOST_DUMMIES, MOST_CLASSES = 10_000, 1_000_000


def one_hot(
    f: Frame,
    columns: Sequence[str] | None = None,
    drop_first: bool = False,
    dummy_na: bool = False,
    sep: str | Sequence[str] | Mapping[str, str] = "_",
    prefix: str | Sequence[str] | Mapping[str, str] | None = None,
    dtype: str = "int32",
    input_columns: Sequence[str] | None = None,
    most: int = MOST_DUMMIES,
) -> Frame:
    """A column for each value of each column, values in order, behind the columns that aren't
    encoded.  The values are found by one distinct aggregate, and counted first: as each becomes a
    column, more than ``most`` are refused, and better told by :func:`one_hot_long`.

    ``prefix`` and ``sep`` are one for all columns, one for each in their order, or by column;
    ``dtype`` is the type of the new columns.  With ``input_columns`` only these are taken; one that
    is absent makes the step unreplayable.
    """
    if input_columns:
        if not set(input_columns) <= set(f.columns()):
            raise Unreplayable("the columns to encode are absent")
        f = select_columns(f, input_columns)
    if dtype not in TYPES:
        raise Unreplayable(f"unknown type {dtype}")
    columns = list(columns or [c for c, t in f.data.dtypes if t == "string"])

    def of_column(option: str | Sequence[str] | Mapping[str, str] | None) -> dict[str, str]:
        if option is None or isinstance(option, str):
            return {c: c if option is None else option for c in columns}
        if not isinstance(option, Mapping) and len(option) != len(columns):
            raise Unreplayable("as many prefixes as columns are needed")
        return dict(option) if isinstance(option, Mapping) else dict(zip(columns, option, strict=True))

    prefixes, seps = of_column(prefix), of_column(sep)
    listed = written(one_hot_long(f, columns).select("column", "value").distinct(), "dummies")
    many = listed.count()
    if many > most:
        raise Unreplayable(f"{many} values would each become a column; one_hot_long tells them as rows")
    found: dict[str, list[str]] = {}
    for r in listed.orderBy("column", "value").collect():  # one row for each column to be made
        found.setdefault(r["column"], []).append(r["value"])
    kinds, new, sources = dict(f.data.dtypes), {}, dict(f.sources)
    for c in columns:
        name = prefixes.get(c, c) + seps.get(c, "_")
        # values are ordered as values of their type, not as texts
        values = sorted(found.get(c, []), key=(float if kinds[c] not in ("string", "boolean", "date", "timestamp") else str))
        for v in values[1:] if drop_first else values:
            new[f"{name}{v}"] = F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast(TYPES[dtype])
            sources[f"{name}{v}"] = set(f.sources.get(c, {c}))
        if dummy_na:
            new[f"{name}nan"] = F.col(c).isNull().cast(TYPES[dtype])
            sources[f"{name}nan"] = set(f.sources.get(c, {c}))
    data = f.data.select(*(c for c in f.data.columns if c not in columns), *(x.alias(c) for c, x in new.items()))
    return Frame(data, {c: s for c, s in sources.items() if c in data.columns}, f.partial & set(data.columns))


def one_hot_long(f: Frame, columns: Sequence[str]) -> DataFrame:
    """(row_id, column, value): the ones of a 0/1 coding of ``columns``, however many values they
    have; a row without a value has none."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return f.data.select(ROW, cells.alias("c")).select(ROW, "c.*").where("value is not null")


def standard_scale(f: Frame, columns: Sequence[str]) -> Frame:
    """Columns less their mean, over the population deviation; a deviation of zero counts as one."""
    stats = f.data.agg(*(m for i, c in enumerate(columns) for m in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))))
    wide = f.data.crossJoin(F.broadcast(stats))  # stats is one row
    scaled = {c: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}")) for i, c in enumerate(columns)}
    return f.having(wide.withColumns(scaled).drop(*(f"_{k}{i}" for i in range(len(columns)) for k in "ms")))


def preprocess(f: Frame, kind: str, columns: Sequence[str]) -> Frame:
    """A known preprocessor: StandardScaler exactly; of the others the rows are known and the
    values aren't, so their columns are partial."""
    if kind == "StandardScaler":
        return standard_scale(f, columns)
    if kind not in PREPROCESSORS:
        raise Unreplayable(f"{kind} can't be replayed")
    return Frame(f.data, f.sources, f.partial | set(columns) & set(f.columns()))


def drop_null_rows(f: Frame, subset: Sequence[str] | None = None) -> Frame:
    return f.having(f.data.na.drop(subset=list(subset or f.columns())))


def drop_duplicate_rows(f: Frame, subset: Sequence[str] | None = None) -> Frame:
    return f.having(keep_first(f.data, ROW, list(subset or f.columns())))


def with_positions(df: DataFrame, order: str = ROW) -> DataFrame:
    """``df`` with ``_pos``, 0-based in the order of ``order``: rows are sorted in ranges, counted
    for each range, and numbered inside it, so no single task sees them all."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    # written, as ranges found anew for the counts and for the rows would not have the same bounds
    ranged = written(ranged, "positions")
    # one row a partition
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "_part int, _start long")
    numbered = ranged.withColumn("_in", F.row_number().over(_in_part(order)))
    return numbered.join(F.broadcast(first), "_part").withColumn("_pos", F.col("_start") + F.col("_in") - 1).drop("_part", "_start", "_in")


def _in_part(order: str):  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy("_part").orderBy(order)


def slice_rows(f: Frame, start: int | None = None, stop: int | None = None, step: int = 1) -> Frame:
    """Rows by position, as a Python slice with a positive step."""
    placed = with_positions(f.data)
    n = None
    if (start or 0) < 0 or (stop or 0) < 0:
        n = f.data.count()
    low = 0 if start is None else start if start >= 0 else max(0, n + start)
    high = None if stop is None else stop if stop >= 0 else n + stop
    keep = (F.col("_pos") >= low) & ((F.col("_pos") - low) % step == 0)
    keep = keep if high is None else keep & (F.col("_pos") < high)
    return f.having(placed.where(keep).drop("_pos"))


def select_at(f: Frame, rows: Sequence[int] | slice | None, columns: Sequence[int] | None = None) -> Frame:
    """Rows and columns by position."""
    if isinstance(rows, slice):
        f = slice_rows(f, rows.start, rows.stop, rows.step or 1)
    elif rows is not None:
        f = f.having(with_positions(f.data).where(F.col("_pos").isin(list(rows))).drop("_pos"))
    return f if columns is None else select_columns(f, [f.columns()[i] for i in columns])


def select_labels(f: Frame, rows: Sequence[int] | slice | None, columns: Sequence[str] | None = None) -> Frame:
    """Rows by label and columns by name; a slice of labels includes both ends, and may take every
    so manieth row of those between."""
    if isinstance(rows, slice):
        data = f.data if rows.start is None else f.data.where(F.col(ROW) >= rows.start)
        f = f.having(data if rows.stop is None else data.where(F.col(ROW) <= rows.stop))
        f = f if (rows.step or 1) == 1 else slice_rows(f, None, None, rows.step)
    elif rows is not None:
        f = f.having(f.data.where(F.col(ROW).isin(list(rows))))
    return f if columns is None else select_columns(f, columns)


def in_test(spark: SparkSession, n: int, take: int, random_state: int, classes: Sequence[int] = ()) -> DataFrame:
    """(_block, _bits): for each BLOCK of the positions 0 to n - 1, a bit for each that is in the test
    part: among the first ``take`` of NumPy's MT19937 permutation or, with the sizes of ``classes``
    whose rows follow one another, as :func:`stratified_marks` says.  The permutation is one sequence,
    so one task makes it, in 4 bytes a row (8 above 2**31 rows); the driver sees nothing of it."""
    import numpy as np
    import pyarrow as pa

    sizes = list(classes)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if sizes:
                marks = stratified_marks(sizes, n - take, take, random_state)
            else:
                order = np.arange(n, dtype=np.int32 if n <= 2**31 else np.int64)
                np.random.RandomState(random_state).shuffle(order)
                marks = np.zeros(n, bool)
                marks[order[:take]] = True
                del order
            for at in range(0, n, BLOCK):
                bits = np.packbits(marks[at : at + BLOCK], bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int64()), pa.array([bits], pa.binary())], ["_block", "_bits"])

    return written(spark.range(0, 1, 1, 1).mapInArrow(shuffle, "_block long, _bits binary"), "split")


def class_shares(counts, draws: int, rng):  # noqa: ANN001, ANN201
    """How many of ``draws`` fall to each class: the whole parts of the exact shares, and the rest
    to the largest fractions, of equal ones to those that the generator chooses."""
    import numpy as np

    exact = counts / counts.sum() * draws
    whole = np.floor(exact)
    rest, missing = exact - whole, int(draws - whole.sum())
    for fraction in sorted(set(rest.tolist()), reverse=True):
        if missing <= 0:
            break
        equal = np.flatnonzero(rest == fraction)
        chosen = rng.choice(equal, size=min(len(equal), missing), replace=False)
        whole[chosen] += 1
        missing -= len(chosen)
    return whole.astype(np.int64)


def stratified_marks(sizes: Sequence[int], train: int, test: int, random_state: int):  # noqa: ANN201
    """Which rows, of classes that follow one another, a seeded stratified split puts in the test
    part: each class is permuted by itself, and its first rows are the training ones."""
    import numpy as np

    counts, rng = np.array(sizes, np.int64), np.random.RandomState(random_state)
    to_train = class_shares(counts, train, rng)
    to_test = class_shares(counts - to_train, test, rng)
    marks, start = np.zeros(counts.sum(), bool), 0
    for size, a, b in zip(counts.tolist(), to_train.tolist(), to_test.tolist(), strict=True):
        order = rng.permutation(size)
        marks[start + order[a : a + b]] = True
        start += size
    return marks


def random_split(f: Frame, test_size: float | int = 0.25, random_state: int | None = None, stratify: str | None = None) -> tuple[Frame, Frame]:
    """Train and test parts as a seeded shuffle of positions defines them: the first test rows of
    NumPy's MT19937 permutation are the test part.  With ``stratify`` every class of that column is
    permuted by itself and has its share in both parts; classes need two rows at least, each part as
    many rows as there are classes, and there are no rows without a class.  Needs a seed."""
    import numpy as np

    if random_state is None:
        raise Unreplayable("a split without random_state isn't reproducible")
    classes: list[int] = []
    if stratify is None:
        n, placed = f.data.count(), with_positions(f.data)
    else:
        sizes = written(f.data.groupBy(stratify).agg(F.count("*").alias("_rows")), "classes")
        if sizes.count() > MOST_CLASSES:
            raise Unreplayable(f"more than {MOST_CLASSES} classes to stratify by")
        found = sizes.orderBy(stratify).collect()  # one row a class, in order
        classes, n = [r["_rows"] for r in found], sum(r["_rows"] for r in found)
        if any(r[stratify] is None for r in found) or min(classes, default=2) < 2:
            raise Unreplayable("a stratified split needs classes of two rows or more, and no row without one")
        placed = with_positions(f.data.withColumn("_class", F.struct(stratify, ROW)), "_class").drop("_class")
    take = int(np.ceil(n * test_size)) if isinstance(test_size, float) else test_size
    if min(take, n - take) < len(classes):
        raise Unreplayable("a part is smaller than the number of classes")
    placed = placed.withColumn("_block", F.floor(F.col("_pos") / BLOCK))
    joined = placed.join(in_test(f.data.sparkSession, n, take, random_state, classes), "_block")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_pos") % BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = joined.withColumn("_byte", byte).withColumn("_test", F.expr("getbit(_byte, cast(_pos % 8 as int))") == 1).drop("_block", "_bits", "_byte", "_pos")
    return f.having(marked.where("not _test").drop("_test")), f.having(marked.where("_test").drop("_test"))


#: operation -> function of a frame and the step
STEPS = {
    "assign": lambda f, s: f,
    "observe": lambda f, s: f,
    "column_selection": lambda f, s: select_columns(f, s["columns"]),
    "drop_columns": lambda f, s: drop_columns(f, s["columns"]),
    "set_column": lambda f, s: set_column(f, s["column"], s.get("value"), s.get("literal", True)),
    "astype_column": lambda f, s: cast(f, {s["column"]: s["dtype"]}),
    "astype": lambda f, s: cast(f, s["dtype"]),
    "get_dummies": lambda f, s: one_hot(f, s.get("columns"), s.get("drop_first", False), s.get("dummy_na", False), s.get("prefix_sep") or "_", s.get("prefix"), s.get("dtype") or "int32", s.get("input_columns")),
    "preprocess_transform": lambda f, s: preprocess(f, s["preprocessor"], s["columns"]),
    "standard_scaler": lambda f, s: standard_scale(f, s["columns"]),
    "dropna": lambda f, s: drop_null_rows(f, s.get("subset")),
    "drop_duplicates": lambda f, s: drop_duplicate_rows(f, s.get("subset")),
    "row_slice": lambda f, s: slice_rows(f, s.get("start"), s.get("stop"), s.get("step") or 1),
    "iloc_selection": lambda f, s: select_at(f, s.get("rows"), s.get("columns")),
    "loc_selection": lambda f, s: select_labels(f, s.get("rows"), s.get("columns")),
}


def required(steps: Sequence[Mapping], wanted: Sequence[str]) -> list[int]:
    """The numbers of the steps that ``wanted`` frames depend on, found backwards."""
    need, out = set(wanted), []
    for i in range(len(steps) - 1, -1, -1):
        outputs = set(steps[i].get("outputs") or [steps[i].get("output")])
        if outputs & need:
            out.append(i)
            need = (need - outputs) | ({steps[i]["input"]} if steps[i].get("input") else set())
    return out[::-1]


def replay(steps: Sequence[Mapping], tables: Mapping[str, DataFrame], wanted: Sequence[str]) -> dict[str, Frame]:
    """The frames named in ``wanted``.  ``tables`` maps the paths of load steps to DataFrames with
    a ``row_id``.  Raises Unreplayable where a needed step isn't known."""
    frames: dict[str, Frame] = {}
    for i in required(steps, wanted):
        step = steps[i]
        kind = step["operation"]
        if kind == "load":
            if step["path"] not in tables:
                raise Unreplayable(f"no table for {step['path']}")
            frames[step["output"]] = load(tables[step["path"]])
            continue
        if step["input"] not in frames:
            raise Unreplayable(f"{step['input']} is unknown")
        source = frames[step["input"]]
        if kind == "train_test_split":
            frames.update(zip(step["outputs"], random_split(source, step.get("test_size", 0.25), step.get("random_state"), step.get("stratify")), strict=True))
        elif kind in STEPS:
            frames[step["output"]] = STEPS[kind](source, step)
        else:
            raise Unreplayable(f"{kind} can't be replayed")
    if missing := [w for w in wanted if w not in frames]:
        raise Unreplayable(f"{missing[0]} is never made")
    return {w: frames[w] for w in wanted}


def row_loss(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (before, after, removed, removed_rate)."""
    table = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
    return table.withColumns({"removed": F.col("before") - F.col("after"), "removed_rate": F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0)})


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select(ROW), ROW, "left_anti")
