"""Findings, scores, lineage, artifacts, files and the registered queries."""

import os
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarryline.operators import artifacts as A
from quarryline.operators import findings as N
from quarryline.operators import lineage as L
from quarryline.operators import schemas as S
from quarryline.plans import registry
from quarryline.sources import csv_table as C

SCHEMA = "rule_id string, category string, severity string, confidence string, action string, score_impact double, issue_nature string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("R1", "A", "High", "High", "Fix", None, "Rule Violation"),
        ("R1", "A", "Low", "High", "Review", None, ""),
        ("R2", "A", "Medium", "Medium", "Review", None, ""),
        ("R3", "B", "Low", "High", "Informational", 0.0, ""),
    ] + [("R4", "B", "Low", "Low", "Review", None, "")] * 9
    return spark.createDataFrame(rows, SCHEMA)


def test_penalties_are_capped(found):
    per = {(r.category, r.rule_id): r.penalty for r in N.rule_penalties(found, N.DATA_WEIGHTS, 0.5, 2.0).collect()}
    assert per == {("A", "R1"): 8.5, ("A", "R2"): 3.5, ("B", "R4"): 2.75}
    assert N.bounded_penalty(found).first().penalty == 10 + 2.75
    assert N.report_score(found).first().score == 100 - (19 + 7 + 5)
    assert N.bounded_penalty(found.limit(0)).first().penalty == 0 and N.display_score(found.limit(0)).first().score == 100


def test_classes(found):
    got = sorted(r.result_class for r in N.with_class(N.with_status(found)).collect())
    assert got.count("confirmed_defect") == 1 and got.count("informational_observation") == 1 and got.count("needs_verification") == 11


def test_ids_are_stable_and_unique(found):
    a, b = (sorted(r.id for r in N.with_ids(d, "rule_id", "severity").collect()) for d in (found, found.repartition(5)))
    assert a == b and len(set(a)) == 13


def test_evaluation(spark):
    findings = spark.createDataFrame([("f1", "R", "x", "confirmed_error", "High", "12 rows"), ("f2", "R", "y", "needs_review", "Low", "none"), ("f3", "Q", "z", "needs_review", "Low", "")], "id string, rule_id string, location string, verification_status string, severity string, evidence string")
    truth = spark.createDataFrame([("t1", "R", "x", "confirmed_error", ["High"], "12"), ("t2", "R", "y", "confirmed_error", ["Low"], ""), ("t3", "R", "w", "confirmed_error", ["Low"], "")], "truth_id string, rule_id string, location string, verification_status string, severities array<string>, evidence string")
    assert tuple(N.evaluate(findings, truth).first()) == (1, 1, 2, 0.5, pytest.approx(1 / 3))
    assert N.evaluate(findings, truth.limit(0)).first().precision is None


def test_scores_of_lineage_groups(spark):
    scores = spark.createDataFrame([("raw", 30.0), ("train", 20.0), ("test", 25.0), ("alone", 35.0)], "file string, score double")
    edges = spark.createDataFrame([("raw", "train"), ("raw", "test")], "a string, b string")
    assert N.data_score(scores, L.components(edges, "a", "b")).first().data_score == 28  # the mean of 20 and 35, halves to even
    assert L.components(edges.limit(0), "a", "b").count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in L.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_paths_are_never_guessed(spark):
    files = spark.createDataFrame([("data/raw.csv",), ("other/raw.csv",), ("src/own.csv",), ("deep/x/y.csv",)], "file string")
    reads = spark.createDataFrame([("src/a.py", p) for p in ("data/raw.csv", "raw.csv", "own.csv", "x/y.csv", "z/y.csv", "no.csv", "y.csv", "/abs/y.csv")], "code string, path string")
    got = {r.path: (r.file, r.how) for r in L.resolve_paths(reads, files).collect()}
    assert got["data/raw.csv"] == ("data/raw.csv", "explicit_path") and got["own.csv"] == ("src/own.csv", "explicit_path")
    assert got["raw.csv"] == (None, "ambiguous_path") and got["x/y.csv"] == ("deep/x/y.csv", "project_relative_suffix")
    assert got["z/y.csv"] == (None, "not_imported") and got["no.csv"] == (None, "not_imported")
    assert got["y.csv"] == ("deep/x/y.csv", "unique_basename") and got["/abs/y.csv"] == ("deep/x/y.csv", "unique_basename")


def test_edges_and_roles(spark):
    reads = spark.createDataFrame([("s.py", "raw.csv"), ("t.py", None)], "code string, file string")
    writes = spark.createDataFrame([("s.py", "train.csv"), ("s.py", "raw.csv")], "code string, file string")
    assert [tuple(r) for r in L.lineage_edges(reads, writes).collect()] == [("raw.csv", "train.csv", "s.py")]
    rows = [("a/report.csv", ["precision", "Recall", "f1-score", "support"], 5, False), ("imp.csv", ["feature", "importance"], 20, False), ("x/train.csv", ["a"], 9, False), ("x.csv", ["a"], 9, True), ("raw/x.csv", ["a"], 9, False), ("strain.csv", ["a"], 9, False)]
    df = spark.createDataFrame(rows, "path string, columns array<string>, rows long, derived boolean")
    role = L.dataset_role(F.col("path"), F.col("columns"), F.col("rows"), F.col("derived"))
    assert [r.role for r in df.select(role["role"].alias("role")).collect()] == ["model_evaluation_report", "feature_importance_result", "train", "feature_engineering_result", "raw", "unassociated"]


def test_schema_comparison(spark):
    a, b = spark.createDataFrame([(1, 2)], "id long, value long"), spark.createDataFrame([(1, "x", 2)], "ID long, value string, extra long")
    got = {(r.rule_id, r.column, r.detail) for r in S.compare_schemas(S.schema_table(spark, {"a": a, "b": b}), "a").collect()}
    assert ("DQ_COLUMN_NAME_FORMAT", "ID", "id") in got and ("DQ_CROSS_FILE_DTYPE", "value", "bigint / string") in got
    assert ("DQ_SCHEMA_DIFFERENCE", "extra", "extra") in got and ("DQ_SCHEMA_DIFFERENCE", "id", "missing") in got


def test_near_pairs_are_those_of_difflib(spark):
    base = " ".join(f"step_{i} = load({i})" for i in range(60))
    rows = [(1, base), (2, base.replace("load(30)", "load(31)")), (3, base + " "), (4, "quite another text " * 9), (5, base[: len(base) // 2])]
    got = {(r.a, r.b): r.similarity for r in A.near_pairs(spark.createDataFrame(rows, "name long, text string"), "name", "text").collect()}
    plain = ["".join(t.split()) for _, t in rows]
    assert set(got) == {(1, 2)} and got[1, 2] == pytest.approx(SequenceMatcher(None, plain[0], plain[1], autojunk=False).ratio())
    exact = sorted(map(tuple, A.exact_groups(spark.createDataFrame(rows, "name long, text string"), "name", "text").collect()))
    assert exact == [(1, 1, 2), (3, 1, 2)]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x,flag,text,none,date\n1,1.5,True,NA,,2024-01-02\n2,inf,False,,,2024-01-03\n3,nan ,True,\" q \",,x\n", encoding="utf-8")
    df = C.scan_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "x": "string", "flag": "boolean", "text": "string", "none": "double", "date": "string", "row_id": "bigint"}
    rows = sorted(df.collect(), key=lambda r: r.row_id)
    assert [r.id for r in rows] == [1, 2, 3] and rows[0].text == "NA" and rows[1].text is None
    assert C.read_header(spark, str(tmp_path / "t.csv"))[:2] == ["id", "x"]


def test_row_ids_are_in_file_order(spark, tmp_path):
    """Files of rising sizes, some cut into pieces and some packed into a task: largest ones are read first."""
    at = 0
    for i, n in enumerate((3, 40, 7, 900, 1, 300)):
        (tmp_path / f"part {i}.csv").write_text("id,x\n" + "".join(f"{k},v{k}\n" for k in range(at, at + n)), encoding="utf-8")
        at += n
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        df = C.scan_csv(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # what comes after the scan may cut files elsewhere
        rows = df.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == at and all(r.id == r.row_id and r.x == f"v{r.id}" for r in rows)


def test_encodings(spark, tmp_path):
    for name, raw in {"a": "é中".encode(), "b": "中文字".encode("gb18030"), "c": b"\xff\xff\xff"}.items():
        (tmp_path / f"{name}.csv").write_bytes(raw)
    got = {os.path.basename(r.path): r.encoding for r in C.decodable(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "utf-8-sig", "b.csv": "gb18030", "c.csv": None}


def test_windows_over_a_stream_equal_those_over_the_table(spark, tmp_path):
    from quarryline.streaming.windows import windowed_profile

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_profile(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value")
    run = stream.writeStream.format("memory").queryName("profiled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("profiled").collect())) == sorted(map(tuple, windowed_profile(events, "ts", "event_type", "value").collect()))


def same(a, b):
    return (a == pytest.approx(b, rel=1e-9, abs=1e-9)) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents labels conversations pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple(map(repr, row))
    got, want = sorted((tuple(r) for r in df.select(*names).collect()), key=key), sorted(result.fetchall(), key=key)
    assert len(got) == len(want) and all(same(a, b) for r, s in zip(got, want, strict=True) for a, b in zip(r, s, strict=True))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_markdown_report(spark):
    from quarryline.operators import quality, report

    rows = [(None, "NA")] * 6 + [(float(i), f"v{i}|") for i in range(30)]
    text = report.markdown(quality.audit(spark.createDataFrame(rows, "value double, token string")), "T")
    assert text.startswith("# T\n\nScore: ") and "| Medium | DQ_MISSING_VALUES | value | 6 |" in text and "Minor findings: " in text
    assert report.markdown(quality.audit(spark.createDataFrame([], "a long"))).count("|") > 0


def test_split_findings(spark):
    from quarryline.operators import quality

    train = spark.createDataFrame([(f"e{i}", i % 3, i) for i in range(30)], "EntityId string, x long, y long")
    test = spark.createDataFrame([("e1", 1, 1), ("e2", 2, 99), ("z", 0, 77)], "EntityId string, x long, y long")
    found = {r.rule_id: r for r in quality.audit_split(train, test, ["x"]).collect()}
    assert set(found) == {"DQ_CROSS_SPLIT_DUPLICATES", "DQ_CROSS_SPLIT_FEATURE_COMBINATIONS", "DQ_CROSS_SPLIT_CANDIDATE_ID_OVERLAP"}
    assert found["DQ_CROSS_SPLIT_DUPLICATES"].detected_count == 2 and found["DQ_CROSS_SPLIT_CANDIDATE_ID_OVERLAP"].detected_count == 4
    named = {r.rule_id: r.severity for r in quality.audit_split(train, test, ["nope"], ["EntityId"]).collect()}
    assert named == {"DQ_CROSS_SPLIT_DUPLICATES": "High", "DQ_CROSS_SPLIT_ENTITY_ID_OVERLAP": "High"}


def test_encodings_of_booleans(spark):
    tokens = spark.createDataFrame([("a", "flag", ["0", "1"]), ("b", "Flag", ["yes", "no"]), ("b", "other", ["1"]), ("c", "flag", ["1"])], "file string, column string, tokens array<string>")
    assert [tuple(r) for r in S.compare_encodings(tokens, "a").collect()] == [("b", "DQ_CROSS_FILE_CATEGORY_ENCODING", "Flag", "0,1 / no,yes")]


def test_near_artifacts_against_difflib_on_all_pairs(spark):
    """Variants of a few texts, with changes spread over every word, and texts that only share a part."""
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    from quarryline.operators import artifacts as A

    rnd, rows = random.Random(8), []
    for g in range(6):
        base = [rnd.choice("abcdefghijklmnop") for _ in range(400)]
        for _ in range(9):
            text = list(base)
            for k in rnd.sample(range(400), rnd.choice([2, 8, 16, 24])):
                text[k] = rnd.choice("qrstuvwxyz")
            rows.append((len(rows), " ".join("".join(text[i : i + 7]) for i in range(0, 400, 7))))
    rows += [(100 + g, rows[9 * g][1][:230] + "".join(rnd.choice("ABCDEFGH") for _ in range(220))) for g in range(6)]
    plain = {d: "".join(t.split()) for d, t in rows}
    links = {(a, b) for a, b in combinations(plain, 2) if SequenceMatcher(None, plain[a], plain[b], autojunk=False).ratio() >= 0.95}
    up = {d: d for d in plain}
    for _ in plain:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.name: r.primary for r in A.near_groups(A.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")).collect()}
    assert len(links) > 50 and got == {d: p for d, p in up.items() if any(d in link for link in links)}
    assert A.near_pairs(spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_matching_is_that_of_difflib():
    """Texts of few letters, of repetitions and of moved parts; the last pair is too long for difflib's own search."""
    import random
    import time
    from difflib import SequenceMatcher

    from quarryline.operators import artifacts as A

    rnd = random.Random(3)
    for t in range(300):
        letters = "abcdefghijklmnopqrstuvwxyz é𝄞"[: rnd.choice([1, 2, 3, 30])]
        x = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 30, 200, 600])))
        x = x[: rnd.choice([5, 40, 600])] * rnd.choice([1, 1, 3, 9]) if t % 3 else x
        y = list(x)
        for _ in range(rnd.choice([0, 1, 5, 40])):
            k = rnd.randrange(len(y) + 1)
            y[k : k + rnd.choice([0, 1, 1, 30])] = rnd.choice(["", "#", x[: rnd.choice([1, 20, 90])]])
        y = "".join(y) or "a"
        m = SequenceMatcher(None, x, y, autojunk=False)
        blocks = sum(b.size for b in m.get_matching_blocks())
        assert A.matching(x, y, len(x)) == blocks <= A.common_order(x, y)
        for least in (0, blocks, len(x) - 3, len(y)):
            assert A.common_order(x, y, least) in ({A.common_order(x, y)} if least <= A.common_order(x, y) else {A.common_order(x, y), -1})
        for threshold in (0.5, 0.95):
            assert A.similarity(x, y, threshold) == (m.ratio() if m.ratio() >= threshold else None)
    x = "".join(rnd.choice("acgt") for _ in range(40_000))
    y = "".join("x" if k % 100 == 7 else c for k, c in enumerate(x))
    began = time.time()
    assert A.similarity(x, y, 0.95) == 0.99 and time.time() - began < 15
