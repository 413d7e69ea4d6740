"""Rules over small tables with known faults: what fires, with which counts and severities."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import duplicates as D
from quarryline.operators import overlap as V
from quarryline.operators import profile as P
from quarryline.operators import quality as Q
from quarryline.operators.outliers import fences, fences_of, integer_domain


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rules(df, *args, **kwargs):
    return {(r.rule_id, r.column): r for r in Q.audit(df, *args, **kwargs).collect()}


def test_clean_table_has_no_severe_findings(spark):
    rows = [(float(i * 37 % 61), float(i * 53 % 67), ["a", "b", "c"][i % 3]) for i in range(60)]
    found = rules(frame(spark, "feature_a double, feature_b double, segment string", rows))
    assert not [k for k, r in found.items() if r.severity == "High"]
    assert len([k for k, r in found.items() if r.severity == "Medium"]) <= 1


def test_empty_and_small(spark):
    assert list(rules(frame(spark, "a long", []))) == [("DQ_EMPTY_DATASET", None)]
    assert ("DQ_VERY_SMALL_DATASET", None) in rules(frame(spark, "a long", [(1,), (2,)]))


def test_missing_blank_token_and_space(spark):
    rows = [(None, "NA", " x"), (2.0, " n/a ", "  "), (float("nan"), "fine", "y")]
    found = rules(frame(spark, "value double, token string, space string", rows))
    assert found["DQ_MISSING_VALUES", "value"].detected_count == 2 and found["DQ_MISSING_VALUES", "value"].severity == "High"
    assert {r.evidence for k, r in found.items() if k[0] == "DQ_SUSPECTED_MISSING_TOKEN"} & {"token=na", "token=n/a"}
    blank = found["DQ_BLANK_STRING", "space"]
    assert blank.detected_count == 1 and blank.severity == "Medium"
    assert found["DQ_SURROUNDING_WHITESPACE", "space"].detected_count == 2


def test_missing_in_a_column_that_the_model_leaves_out(spark):
    found = rules(frame(spark, "a double, b double", [(None, 1.0), (2.0, 2.0), (3.0, 5.0)]), flow={"model_features": ["b"]})
    assert found["DQ_MISSING_VALUES", "a"].action == "Informational" and found["DQ_MISSING_VALUES", "a"].score_impact == 0


def test_constants_and_identical_columns(spark):
    rows = [("x", "a" if i else "b", i % 7, i % 7, None) for i in range(100)]
    found = rules(frame(spark, "constant string, near string, left long, right long, gone string", rows))
    assert ("DQ_CONSTANT_COLUMN", "constant") in found and ("DQ_SINGLE_CATEGORY", "constant") in found
    assert found["DQ_NEAR_CONSTANT_COLUMN", "near"].detected_rate == pytest.approx(0.99)
    assert ("DQ_IDENTICAL_COLUMNS", "left / right") in found and ("DQ_ALL_NULL_COLUMN", "gone") in found


def test_identical_columns_tell_null_from_value(spark):
    df = frame(spark, "a long, b long", [(1, None), (None, 1)])
    assert D.identical_columns(df).count() == 0


def test_duplicates(spark):
    df = frame(spark, "k long, a string, b double", [(0, "x", None), (1, "x", None), (2, "y", 1.0), (3, "x", None), (4, "y", 2.0)])
    row = D.duplicate_summary(df, ["a", "b"]).first()
    assert (row.rows, row.duplicate_rows, row.duplicate_groups) == (5, 2, 1)
    assert [tuple(r) for r in D.duplicate_groups(df, "k", ["a", "b"]).collect()] == [(0, 3, [0, 1, 3])]
    assert sorted(r.k for r in D.keep_first(df, "k", ["a", "b"]).collect()) == [0, 2, 4]
    found = rules(df.drop("k"))
    assert found["DQ_DUPLICATE_ROWS", None].severity == "High"


def test_parse_anomalies(spark):
    numbers = [(str(i), f"2024-01-{i + 1:02d}") for i in range(9)] + [("bad", "2024-13-77")]
    found = rules(frame(spark, "number string, date string", numbers))
    assert found["DQ_NUMERIC_PARSE_ANOMALY", "number"].detected_count == 1 and found["DQ_DATETIME_PARSE_ANOMALY", "date"].detected_count == 1
    half = [(str(i) if i % 2 else f"t{i}",) for i in range(10)]
    assert found["DQ_NUMERIC_PARSE_ANOMALY", "number"].action == "Fix"
    assert rules(frame(spark, "value string", half))["DQ_MIXED_REPRESENTATION", "value"].detected_count == 5
    assert rules(frame(spark, "ticket string", half))["DQ_IDENTIFIER_REPRESENTATION", "ticket"].action == "Informational"


@pytest.mark.parametrize(("text", "number"), [("1", 1.0), (" 1.5e3 ", 1500.0), ("-inf", float("-inf")), ("1d", None), ("nan", None), ("", None), (".5", 0.5), ("1,000", None)])
def test_number_in(spark, text, number):
    from quarryline.functions.values import number_in

    assert frame(spark, "t string", [(text,)]).select(number_in(F.col("t")).alias("n")).first().n == number


def test_boolean_case_and_long_text(spark):
    rows = [("Yes", "Red", "x" * 10_001), ("1", "red", "y"), ("no", "blue", "z")]
    found = rules(frame(spark, "flag string, colour string, body string", rows))
    assert found["DQ_BOOLEAN_ENCODING", "flag"].evidence == "1,no,yes"
    assert found["DQ_CATEGORY_CASE", "colour"].detected_count == 1 and found["DQ_EXCESSIVE_TEXT", "body"].detected_count == 1


def test_cardinality_and_rare(spark):
    rows = [(f"u{i}", "common" if i else "odd") for i in range(200)]
    found = rules(frame(spark, "user_id string, category string", rows))
    assert found["DQ_HIGH_CARDINALITY", "user_id"].action == "Informational" and ("DQ_POTENTIAL_ID", "user_id") in found
    assert found["DQ_RARE_CATEGORIES", "category"].detected_count == 1


def test_non_finite_and_outliers(spark):
    rows = [(float(i),) for i in range(1, 25)] + [(1000.0,), (float("inf"),), (float("-inf"),)]
    df = frame(spark, "value double", rows)
    found = rules(df)
    assert found["DQ_NON_FINITE_NUMERIC", "value"].detected_count == 2 and found["DQ_NON_FINITE_NUMERIC", "value"].severity == "High"
    assert found["DQ_POTENTIAL_EXTREME_VALUES", "value"].detected_count == 1
    assert fences(df, "value")["method"] == "iqr"
    assert fences_of(frame(spark, "c double", [(1.0,)] * 30), {"c": 30}) == {}


def test_skewness_matches_the_bias_corrected_formula(spark):
    rows = [(1.0,), (2.0,), (3.0,), (10.0,), (None,)]
    got = P.numeric_profile(frame(spark, "v double", rows), ["v"]).first()
    x = [1.0, 2.0, 3.0, 10.0]
    mean = sum(x) / 4
    m2, m3 = sum((v - mean) ** 2 for v in x) / 4, sum((v - mean) ** 3 for v in x) / 4
    assert got.skewness == pytest.approx(m3 / m2**1.5 * (4 * 3) ** 0.5 / 2)
    assert got.missing == 1 and got.q1 == 1.75
    assert P.numeric_profile(frame(spark, "v double", [(5.0,)] * 4), ["v"]).first().skewness is None


def test_correlation_of_a_constant_is_null(spark):
    rows = [(float(i), 2.0 * i, 1.0) for i in range(50)]
    got = {(r.feature_a, r.feature_b): r.r for r in P.correlations(frame(spark, "a double, b double, c double", rows)).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] is None
    assert ("DQ_HIGH_CORRELATION", "a / b") in rules(frame(spark, "a double, b double, c double", rows))


def test_quantiles_agree_however_they_are_taken(spark):
    rows = [(float((i * 7919) % 5003) if i % 50 else None,) for i in range(20_000)]
    df = frame(spark, "x double", rows)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    direct = P.exact_quantiles(df, ["x"], probs)["x"]
    assert P.exact_quantiles(df, ["x"], probs, rows=P.DIRECT_ROWS + 1)["x"] == pytest.approx(direct)


def test_integer_domain(spark):
    rows = [(float(1 + i % 5),) for i in range(200)] + [(9.0,), (-3.0,)]
    got = sorted((r.value, r.n) for r in integer_domain(frame(spark, "v double", rows), "v").collect())
    assert got == [(-3.0, 1), (9.0, 1)]
    gaps = [(float(2 * (i % 5)),) for i in range(200)] + [(99.0,)]
    assert integer_domain(frame(spark, "v double", gaps), "v").count() == 0


def test_constraints(spark):
    rows = [(20, "a", -1.0), (150, "z", 2.0), (30, None, 3.0)]
    df = frame(spark, "age long, kind string, price double", rows)
    found = rules(df, {"age": {"min": 0, "max": 120}, "kind": {"allowed_values": ["a", "b"]}})
    assert found["DQ_CONSTRAINT_VIOLATION", "age"].action == "Fix" and found["DQ_CONSTRAINT_VIOLATION", "kind"].detected_rate == 0.5
    assert found["DQ_POTENTIAL_NON_NEGATIVE_VIOLATION", "price"].detected_count == 1
    stated = rules(df, {"price": {"non_negative": True}})
    assert ("DQ_CONSTRAINT_VIOLATION", "price") in stated and ("DQ_POTENTIAL_NON_NEGATIVE_VIOLATION", "price") not in stated


def test_target_and_index(spark):
    rows = [(i, "no" if i % 20 else "yes") for i in range(100)]
    df = frame(spark, "index long, target string", rows).withColumn("row_id", F.col("index"))
    found = rules(df, row_id="row_id")
    assert found["DQ_POTENTIAL_INDEX_COLUMN", "index"].confidence == "High"
    assert ("DQ_POTENTIAL_TARGET", "target") in found and found["DQ_POTENTIAL_CLASS_IMBALANCE", "target"].detected_rate == pytest.approx(0.95)


def test_duplicate_header():
    assert Q.header_duplicates(["a", "b", "a"]) == [("a", 2)]


def test_findings_do_not_depend_on_row_order(spark):
    rows = [(i % 13, f"v{i % 5} ", float(i * i % 101)) for i in range(300)]
    df = frame(spark, "k long, t string, x double", rows)
    assert rules(df) == rules(df.repartition(7, "x"))


def test_overlap(spark):
    train = frame(spark, "a string, b long", [("x", 1), ("x", 1), ("y", None), ("z", 3)])
    test = frame(spark, "a string, b long", [("x", 1), ("y", None), ("w", 4)])
    row = V.overlap_summary(train, test, ["a", "b"]).first()
    assert tuple(row) == (2, 2, 5)
    assert sorted(r.a for r in V.shared_rows(test, train, ["a", "b"]).collect()) == ["x", "y"]


@pytest.mark.parametrize(("name", "strength"), [("EntityId", "strong"), ("TicketCode", "weak"), ("row_number", None), ("userID", "strong"), ("price", None), ("Unnamed: 0", None), ("order_no", "weak")])
def test_identifier_names(name, strength):
    assert V.identifier_strength(name) == strength


def test_identifier_candidates(spark):
    rows = [(f"e{i}", f"t{i % 40}", "same") for i in range(100)]
    got = {r.column: r.confidence for r in V.identifier_candidates(frame(spark, "EntityId string, TicketCode string, other_id string", rows)).collect()}
    assert got == {"EntityId": "High", "TicketCode": "Medium"}


def test_hash_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    a, b = (sorted(map(tuple, V.hash_split(d, "id", 0.2).collect())) for d in (df.repartition(3), df.repartition(11)))
    assert a == b and 300 < sum(p == "test" for _, p in a) < 500


def test_case_folding_equals_that_of_python_for_every_character(spark):
    import unicodedata

    from quarryline.functions import values as V

    chars = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    rows = [(f"a{c}b",) for c in chars] + [("",), (None,), ("Weiß ẞ ΑΣ ΑΣα İı ﬃ",)]
    got = {r.x: r.f for r in spark.createDataFrame(rows, "x string").select("x", V.case_fold(F.col("x")).alias("f")).collect()}
    # folded texts may be spelled otherwise, but the same texts have to be one
    ours, pythons = {}, {}
    for x, f in got.items():
        if x is not None:
            ours.setdefault(f, set()).add(x)
            pythons.setdefault(x.casefold(), set()).add(x)
    assert got[None] is None and got["Weiß ẞ ΑΣ ΑΣα İı ﬃ"] == "weiss ss ασ ασα i̇ı ffi"
    assert {frozenset(v) for v in ours.values()} == {frozenset(v) for v in pythons.values()}


def test_mixed_types_of_variants(spark):
    rows = [(1, "1", "1"), (2, '"a"', "2"), (3, "null", "null"), (4, None, None), (5, "1.5", "3"), (6, '{"k": [1]}', "4"), (7, "true", "5")]
    df = spark.createDataFrame(rows, "i int, j string, k string").select("i", F.parse_json("j").alias("any"), F.parse_json("k").alias("one"))
    assert {r.column: (list(r.types), r.n) for r in Q.value_types(df, ["any", "one"]).collect()} == {"any": (["bool", "dict", "float", "int", "str"], 5), "one": (["int"], 5)}
    found = {(r.rule_id, r.column): r for r in Q.audit(df).collect()}
    assert found["DQ_MIXED_PYTHON_TYPES", "any"].detected_count == 5 and ("DQ_MIXED_PYTHON_TYPES", "one") not in found
    assert found["DQ_MISSING_VALUES", "any"].detected_count == 2


def test_correlation_is_to_be_reviewed_where_a_model_minds_it(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 7).alias("c"))
    flow = {"model_features": ["a", "b"], "models": [{"type": "LogisticRegression"}]}
    cases = ((None, "Informational"), (flow, "Review"), (flow | {"models": ["RandomForest"]}, "Informational"), (flow | {"model_features": ["a"]}, "Informational"))
    for known, action in cases:
        assert rules(df, flow=known)["DQ_HIGH_CORRELATION", "a / b"].action == action


def test_wide_tables_are_compared_whole(spark):
    """Identical columns and correlations of more columns than one aggregate takes."""
    df = spark.range(30).select(*((F.col("id") * (k + 2) % 31 + k).alias(f"c{k}") for k in range(203)), (F.col("id") * 2 % 31).alias("again"))
    assert [tuple(r) for r in D.identical_columns(df).collect()] == [("c0", "again")]
    some = [f"c{k}" for k in range(5)]
    few, many = ({(r.feature_a, r.feature_b): r.r for r in P.correlations(df, c).collect()} for c in (some, [*some, *(f"c{k}" for k in range(5, 12))]))
    assert len(few) == 10 and all(many[k] == pytest.approx(r, abs=1e-12) for k, r in few.items())


def test_dominant_values(spark):
    rows = [(None if i % 3 == 0 else 7, "a" if i > 3 else f"b{i}", i, None, float(i % 2), -(2**62) + i) for i in range(500)]
    df = spark.createDataFrame(rows, "half long, near string, many long, none string, two double, big long")
    got = {r.column: (r.non_null, r.constant, r.top_count) for r in P.dominance(df, df.columns).collect()}
    assert got["half"] == (333, True, 333) and got["near"] == (500, False, 496) and "none" not in got
    assert got["many"] == (500, False, None) == got["big"] and got["two"] == (500, False, 250)
    assert P.few_valued(df, ["half", "near", "many", "two"]) == ["half", "near", "two"]
