"""Small expressions of reviews and files, value by value."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import review as W
from quarryline.sources import files as S


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(("path", "safe"), [("a/b.py", True), ("a\\b.py", True), ("", False), ("/etc/x", False), ("a/../b", False), ("C:/x", False), ("a//b", False), ("con.txt", False), ("x/NUL", False), ("a /b", False), ("a./b", False), ("a\x01b", False), ("console.py", True)])
def test_safe_paths(spark, path, safe):
    assert value(spark, S.is_safe, path) is safe


@pytest.mark.parametrize(("path", "private"), [(".git/x", True), ("a/.env.local", True), ("a/node_modules/b", True), ("a/b.env", False)])
def test_private_paths(spark, path, private):
    assert value(spark, S.is_private, path) is private


@pytest.mark.parametrize(("path", "kind"), [("A.PY", "code"), ("x/b.ipynb", "notebook"), (".csv", None), ("noext", None), ("d.csv", "data")])
def test_kinds(spark, path, kind):
    assert value(spark, S.kind_of, path) == kind


def test_budget(spark):
    files = spark.createDataFrame([(f"f{i}.py", 10) for i in range(101)], "path string, length long")
    assert tuple(S.within_budget(S.inspect_files(files)).first()) == (101, 1010, False)


def test_scan_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, raw in {"src/a.py": b"x = 1", "b.csv": b"a\x00b", "c.md": b"", "d.bin": b"1"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path: (r.kind, r.refused) for r in S.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("code", None), "b.csv": ("data", "binary"), "d.bin": (None, "unsupported")}


def test_notebook(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "execution_count": 3, "source": ["a = 1\n", "b = 2"]}, {"cell_type": "code", "execution_count": None, "source": "c"}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}}, indent=1))
    got = [tuple(r) for r in S.notebook_cells(spark, str(tmp_path)).orderBy("cell").collect()]
    assert got == [("n.ipynb", 1, 3, "a = 1\nb = 2"), ("n.ipynb", 2, None, "c")]


@pytest.mark.parametrize(("text", "pattern", "fits"), [("DQ_X", "DQ_*", True), ("dq_x", "DQ_*", False), ("a+b", "a+?", True), ("ab", "a[!b]", False), ("a\nb", "a*", True), ("xay", "a", False)])
def test_globs(spark, text, pattern, fits):
    assert value(spark, lambda c: W.glob_match(c, pattern), text) is fits


@pytest.mark.parametrize(("code", "shown"), [("api_key = 'abcdefghij'", "api_key = 'abc...hij'"), ('my_token: "abc"', 'my_token: "***"'), ("name = 'abcdefghij'", "name = 'abcdefghij'"), ("PASSWORD='abcdef'", "PASSWORD='***'")])
def test_redaction(spark, code, shown):
    assert value(spark, W.redacted, code) == shown


def test_payloads(spark):
    rows = [('{"id": "a", "n": 1}',), ('{"n": 1}',), ("{",), (None,)]
    got = [r.fault for r in W.parsed_payloads(spark.createDataFrame(rows, "t string"), "t", "id string, n long", ["id"]).collect()]
    assert got == [None, "missing id", "malformed", "malformed"]


@pytest.mark.parametrize(("name", "role"), [("X_valid_test", "validation"), ("test_train", "test"), ("train", "train"), ("data", None)])
def test_roles(spark, name, role):
    assert value(spark, W.split_role, name) == role


def test_csv_files_in_other_encodings_and_with_quoted_lines(spark, tmp_path):
    from quarryline.sources import csv_table

    (tmp_path / "a.csv").write_bytes('id,name,note\n1,表一,"two\nlines"\n2,"say ""hi""",plain\n'.encode("gb18030"))
    rows = csv_table.scan_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.name, r.note, r.row_id) for r in rows] == [(1, "表一", "two\nlines", 0), (2, 'say "hi"', "plain", 1)]
    assert csv_table.preview(spark, str(tmp_path)).count() >= 2
    other = tmp_path / "bad"
    other.mkdir()
    (other / "b.csv").write_bytes(b"id\n\xff\xfe\xff\n")
    with pytest.raises(ValueError):
        csv_table.scan_csv(spark, str(other))


def test_paths_and_bindings(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import lineage as L
    from quarryline.sources import files as S

    paths = ["a/./b", "a/../b", "../b", "/../b", "a\\b", "", "s3://x//y", ".", "a//b/"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", L.normal_path(F.col("p")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == ["a/b", "b", "../b", "/b", "a/b", None, "s3://x//y", ".", "a/b"]
    files = spark.createDataFrame([("z.zip!/d/x.csv",), ("d/x.csv",)], "file string")
    reads = spark.createDataFrame([("z.zip!/src/a.py", "../d/x.csv"), ("src/a.py", "./d/x.csv")], "code string, path string")
    assert {(r.code, r.file, r.how) for r in L.resolve_paths(reads, files).collect()} == {("z.zip!/src/a.py", "z.zip!/d/x.csv", "explicit_path"), ("src/a.py", "d/x.csv", "explicit_path")}
    named = S.inspect_files(spark.createDataFrame([("e\u0301.py", 3), ("x/Makefile", 3), ("__MACOSX/a.py", 3), ("a.txt", 3)], "path string, length long"))
    assert {(r.path, r.kind, r.refused) for r in named.collect()} == {("\u00e9.py", "code", None), ("x/Makefile", "build", None), ("__MACOSX/a.py", "code", "private"), ("a.txt", None, "unsupported")}


def test_a_split_with_missing_rows_is_not_quantified(spark):
    from quarryline.operators import overlap as V

    data = spark.range(5).withColumnRenamed("id", "row_id")
    assert V.restrict(data, spark.createDataFrame([(1,), (3,)], "row_id long"), "row_id").count() == 2
    assert V.restrict(data, spark.createDataFrame([(1,), (9,)], "row_id long"), "row_id") is None


def test_names_of_identifiers():
    from quarryline.operators.overlap import identifier_strength as strength

    assert [strength(c) for c in ("userID", "user_id", "IDCard", "CustomerKey", "x identifier")] == ["strong", "strong", None, "strong", "strong"]
    assert [strength(c) for c in ("TicketClass", "refCode", "PhoneNumber", "no", "order-no")] == ["weak"] * 5
    assert [strength(c) for c in ("index_id", "Unnamed: 0", "rowKey", "paid", "user2id", "", "_")] == [None] * 7


def test_sinks(spark, tmp_path):
    from quarryline.operators import report

    found = spark.createDataFrame([("R", "C", "x", "High", 3, 0.25, "Fix")], "rule_id string, category string, column string, severity string, detected_count long, detected_rate double, action string")
    for form in ("parquet", "json", "csv"):
        report.save(found, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert report.console(found) == "[High] R x: 3 (25.0%)"
    with pytest.raises(ValueError):
        report.save(found, str(tmp_path / "x"), "xml")


def test_overview_and_shown_tables(spark):
    from quarryline.operators import profile as P
    from quarryline.operators import quality as Q

    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 9), "x") for i in range(96)] + [(96, 9e6, "x"), (97, 8e6, "y")], "id long, value double, kind string")
    nulls = P.null_profile(df)
    found = Q.audit(df)
    far = sum(r.detected_count for r in found.where("category = 'Outliers'").collect())
    assert tuple(W.overview(nulls, found).first()) == (98, 3, pytest.approx(24 / 98 / 3), far) and far >= 2
    assert [tuple(r) for r in W.missing_table(nulls).collect()] == [("value", "24.49%"), ("id", "0.00%"), ("kind", "0.00%")]
    assert [tuple(r) for r in W.type_table(df).collect()] == [("id", "bigint", "numeric"), ("value", "double", "numeric"), ("kind", "string", "categorical")]
    shown = W.statistics_table(P.numeric_profile(df), 1).collect()
    assert [r.column for r in shown] == ["id", "value"] and shown[0]["mean"] == 48.5


def test_flows_of_several_files_are_one(spark):
    rows = [("p", "a.py", "train", "x", 1, 2), ("p", "a.py", "fit", "m", 1, 1), ("p", "b.py", "train", "y", 2, 1), ("p", "b.py", "train", "x", 2, 2), ("p", "b.py", "metric", "f1", 2, 3), ("p", "b.py", "fit", "n", 2, 4), ("q", "c.py", "source", "s", 1, 1)]
    events = spark.createDataFrame(rows, "project string, file string, kind string, label string, at_file int, at int")
    got = sorted(tuple(r) for r in W.merged_flows(events, ["at_file", "at"]).collect() if r.kind == "train")
    assert got == [("p", "train", 1, "a.py", "x"), ("p", "train", 2, "b.py", "y"), ("p", "train", 3, "b.py", "x")]
    summary = {r.project: r for r in W.flow_summary(events, ["at_file", "at"]).collect()}
    assert (summary["p"].files, summary["p"].primary, summary["p"].train, summary["p"].test, summary["p"].evaluation_detected) == (2, "b.py", ["x", "y"], [], True)
    assert (summary["q"].train, summary["q"].evaluation_detected) == ([], False)


def test_truths_that_no_finding_meets(spark):
    """They are counted without standing together; of two truths that one finding meets the first gets it."""
    from quarryline.operators import findings as N

    found = spark.createDataFrame([(1, "R", "a", "s", "High", "says so"), (2, "R", "b", "s", "Low", "says so"), (3, "R", "c", "s", "High", "no")], "id long, rule_id string, location string, verification_status string, severity string, evidence string")
    truth = [(k, "Q", f"z{k}", "s", ["High"], "so") for k in range(100, 140)] + [(1, "R", "a", "s", ["High"], "so"), (2, "R", "a", "s", ["High", "Low"], "says"), (3, "R", "b", "s", ["High"], "so"), (4, "R", None, "s", ["High"], "so")]
    row = N.evaluate(found, spark.createDataFrame(truth, "truth_id long, rule_id string, location string, verification_status string, severities array<string>, evidence string")).first()
    assert (row.tp, row.fn, row.fp) == (1, 43, 2) and row.precision == pytest.approx(1 / 3)


def test_white_space_inside_a_text_is_passed_once(spark):
    import time

    from quarryline.functions import values as V
    from quarryline.operators.artifacts import standard_lines

    long = "a" + " " * 200_000 + "b  "
    began = time.time()
    assert value(spark, V.strip, long) == long[:-2] and value(spark, standard_lines, long) == long[:-2]
    assert time.time() - began < 20
    assert [value(spark, V.strip, x) for x in ("  ", "　x\t", "", "x", " x y ")] == ["", "x", "", "x", "x y"]
    assert value(spark, standard_lines, "\r\n a \t\r b \n\n") == " a\n b"
