"""Reconciled findings, problems and facts on small tables."""

import json

from pyspark.sql import functions as F

from quarryline.operators import projection as J

FINDINGS = "id long, origin string, rule_id string, type string, category string, file string, cell int, line int, column string, severity string, action string, score_impact double, evidence string, snippet string, event string, verification_status string"


def rows(spark):
    made = [
        (1, "code", "R1", "t", "c", "a.py", 1, 5, None, "High", "Review", None, "e", "s", None, "confirmed_error"),
        (2, "code", "R1", "t", "c", "a.py", 1, 5, None, "Low", "Review", None, "e", "s", None, "static_risk"),  # the same place and evidence
        (3, "code", "R1", "t", "c", "a.py", None, 5, None, "Low", "Review", None, "e", "s", None, "static_risk"),
        (4, "data", "R2", "t", "c", "a.csv", None, None, "x", "Low", "Review", 0.0, "e", None, "shared", "static_risk"),
        (5, "data", "R3", "t", J.PROJECT_CATEGORY, "b.csv", None, None, None, "Low", "Fix", None, None, None, "shared", "no such state"),
        (6, "data", None, "t", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    issues = [(10, "code", "a.py", 1, 5, "odd", "R1"), (9, "code", "a.py", 1, 5, None, "R1"), (8, "code", "a.py", None, 5, None, "R1"), (7, "data", "a.csv", 3, 4, "x", "R2"), (6, "data", "a.csv", None, None, "y", "R2")]
    repairs = [(3, 1, "Proposed"), (2, 1, "Runtime Verified"), (1, 5, None), (0, 99, "Statically Validated")]
    return (
        spark.createDataFrame(made, FINDINGS),
        spark.createDataFrame(issues, "position long, origin string, file string, cell int, line int, column string, rule_id string"),
        spark.createDataFrame(repairs, "position long, id long, validation_status string"),
    )


def test_findings_meet_their_issues_and_repairs(spark):
    found = {r.id: r for r in J.finding_rows(*rows(spark)).collect()}
    assert {i: r.issue for i, r in found.items()} == {1: 9, 2: 9, 3: 8, 4: 7, 5: None, 6: None}
    assert {i: (r.repair, r.validated) for i, r in found.items() if r.repair is not None} == {1: (2, True), 5: (1, None)}
    assert {i: r.part for i, r in found.items()} == {1: "code", 2: "code", 3: "code", 4: "data", 5: "project", 6: "data"}
    assert found[1].problem == found[2].problem != found[3].problem and found[4].problem == found[5].problem
    assert len({r.problem for r in found.values()}) == 4 and all(r.problem.startswith("P-") and len(r.problem) == 18 for r in found.values())


def test_problems_and_conclusions(spark):
    findings, issues, repairs = rows(spark)
    told = spark.createDataFrame([(2, "c", "i", "r"), (3, "c", "", "r"), (4, None, "i", "r")], "id long, cause string, potential_impact string, recommendation string")
    found = J.finding_rows(findings, issues, repairs)
    problems = J.problem_rows(found, told)
    of = {r.id: r.problem for r in found.collect()}
    got = {r.problem: (r.n, r.result_class, r.verification_status, r.priority, r.explained) for r in problems.collect()}
    assert got[of[1]] == (2, "confirmed_defect", "static_risk", True, True)
    assert got[of[3]] == (1, "static_risk", "static_risk", False, False)
    assert got[of[4]] == (2, "needs_verification", "needs_review", True, False)
    assert got[of[6]][2] == "needs_review"
    c = J.conclusions(found, problems, repairs).first()
    assert (c.total, c.confirmed_error, c.static_risk, c.needs_review, c.actionable_total) == (4, 0, 2, 2, 1 + 2 + 2)
    assert (c.code_issues, c.code_notes, c.repairs, c.validated_repairs, c.explained) == (3, 0, 4, 2, 1)
    none = findings.where("id < 0")
    empty = J.finding_rows(none, issues, repairs)
    assert J.conclusions(empty, J.problem_rows(empty, told), repairs).first().total == 0


def test_display_numbers(spark):
    ids = spark.createDataFrame([(f"F-{k:03d}",) for k in range(12)], "id string")
    got = {r.id: r.display_id for r in J.display_numbers(ids.unionByName(ids), "id", "F").collect()}
    assert got["F-000"] == "F01" and got["F-008"] == "F09" and got["F-011"] == "F12" and len(got) == 12


def test_facts_are_the_same_in_any_order(spark):
    a = spark.range(200).select((F.col("id") % 3).alias("project"), "id", F.when(F.col("id") % 2 == 0, F.lit('quo"ted é')).alias("name"))
    b = spark.createDataFrame([(0, 1.5), (7, None)], "project long, x double")
    known = [{r.project: tuple(r) for r in J.facts({"a": x, "b": y}, "project").collect()} for x, y in ((a, b), (a.orderBy(F.desc("id")).repartition(7), b.repartition(2)))]
    assert known[0] == known[1] and set(known[0]) == {0, 1, 2, 7}
    document = json.loads(known[0][7][1])
    assert document == {"a": [], "b": [{"x": None}]} and json.loads(known[0][0][1])["b"] == [{"x": 1.5}]
    other = {r.project: r.fingerprint for r in J.facts({"a": a.where("id <> 5"), "b": b}, "project").collect()}
    assert other[2] != known[0][2][3] and other[0] == known[0][0][3]
