"""The final state of a review and the facts of projects, derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import projection as J
from quarryline.plans.registry import query, table

_ROWS = """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'code' ELSE 'data' END AS origin, 'R' || (event_id % 4) AS rule_id, event_type AS type, CASE WHEN event_id % 3 = 1 AND event_id % 7 = 0 THEN 'Multi-file Consistency' ELSE event_type END AS category,
'f' || (user_id % 9) AS file, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS cell, CASE WHEN event_id % 6 = 0 THEN event_id % 11 END AS line, CASE WHEN event_id % 3 > 0 THEN 'c' || (event_id % 13) END AS "column", CASE WHEN event_id % 10 = 0 THEN 'High' ELSE 'Low' END AS severity,
CASE WHEN event_id % 8 = 0 THEN 'Informational' WHEN event_id % 8 = 1 THEN 'Fix' ELSE 'Review' END AS action, CASE WHEN event_id % 9 = 0 THEN 0.0 END AS score_impact, 'k' || (event_id % 2) AS evidence, CASE WHEN event_id % 21 = 0 THEN 'e' || user_id END AS event,
CASE event_id % 5 WHEN 0 THEN 'confirmed_error' WHEN 1 THEN 'static_risk' WHEN 2 THEN 'odd' ELSE 'needs_review' END AS verification_status, user_id FROM events"""
#: Issues are every other finding's, and repairs every sixth's.
_PROJECTED = f"""WITH f AS ({_ROWS}), q AS (SELECT *, COALESCE(score_impact, 1.0) = 0 OR action = 'Informational' AS quiet FROM f),
c AS (SELECT *, CASE WHEN quiet THEN 4 WHEN verification_status = 'confirmed_error' THEN 1 WHEN verification_status = 'static_risk' THEN 2 ELSE 3 END AS k, severity = 'High' OR action = 'Fix' OR verification_status = 'confirmed_error' AS priority,
 COALESCE('e' || event, CONCAT_WS('|', 'o', rule_id, file, COALESCE(CAST(cell AS VARCHAR), '-'), COALESCE(CAST(line AS VARCHAR), '-'), COALESCE("column", '-'), evidence)) AS problem,
 CASE WHEN origin = 'code' THEN 'code' WHEN category = 'Multi-file Consistency' THEN 'project' ELSE 'data' END AS part,
 CASE WHEN origin = 'code' THEN CONCAT_WS('|', 'c', file, rule_id, COALESCE(CAST(cell AS VARCHAR), '-'), COALESCE(CAST(line AS VARCHAR), '-')) ELSE CONCAT_WS('|', 'd', file, rule_id, "column") END AS key FROM q),
i AS (SELECT key, MIN(id) AS issue FROM c WHERE id % 2 = 0 GROUP BY 1),
r AS (SELECT id - id % 6 AS id, MIN(id) AS repair, BOOL_OR(id % 4 = 0) AS validated FROM f WHERE id % 6 IN (0, 5) GROUP BY 1)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return table(spark, sf_dir, "events").select(
        key.alias("id"),
        F.when(key % 3 == 0, "code").otherwise("data").alias("origin"),
        text("R", key % 4).alias("rule_id"),
        F.col("event_type").alias("type"),
        F.when((key % 3 == 1) & (key % 7 == 0), J.PROJECT_CATEGORY).otherwise(F.col("event_type")).alias("category"),
        text("f", user % 9).alias("file"),
        F.when(key % 3 == 0, key % 5).alias("cell"),
        F.when(key % 6 == 0, key % 11).alias("line"),
        F.when(key % 3 > 0, text("c", key % 13)).alias("column"),
        F.when(key % 10 == 0, "High").otherwise("Low").alias("severity"),
        F.when(key % 8 == 0, "Informational").when(key % 8 == 1, "Fix").otherwise("Review").alias("action"),
        F.when(key % 9 == 0, 0.0).alias("score_impact"),
        text("k", key % 2).alias("evidence"),
        F.lit(None).cast("string").alias("snippet"),
        F.when(key % 21 == 0, text("e", user)).alias("event"),
        F.when(key % 5 == 0, "confirmed_error").when(key % 5 == 1, "static_risk").when(key % 5 == 2, "odd").otherwise("needs_review").alias("verification_status"),
    )


def _issues(found: DataFrame) -> DataFrame:
    return found.where("id % 2 = 0").select(F.col("id").alias("position"), "origin", "file", "cell", "line", "column", "rule_id")


def _repairs(found: DataFrame) -> DataFrame:
    state = F.when(F.col("id") % 4 == 0, "Runtime Verified").otherwise("Proposed")
    return found.where("id % 6 in (0, 5)").select(F.col("id").alias("position"), (F.col("id") - F.col("id") % 6).alias("id"), state.alias("validation_status"))


def _annotations(found: DataFrame) -> DataFrame:
    return found.select("id", F.when(F.col("id") % 7 == 0, "c").otherwise("").alias("cause"), F.lit("i").alias("potential_impact"), F.lit("r").alias("recommendation"))


@query(f"""{_PROJECTED}, p AS (SELECT problem, MIN(id) AS least FROM c GROUP BY 1)
SELECT id, part, least AS problem_of, priority, (['confirmed_defect', 'static_risk', 'needs_verification', 'informational_observation'])[k] AS result_class, issue, repair, validated, 'F' || CASE WHEN ROW_NUMBER() OVER (ORDER BY id) < 10 THEN '0' ELSE '' END || ROW_NUMBER() OVER (ORDER BY id) AS display_id
FROM c JOIN p USING (problem) LEFT JOIN i USING (key) LEFT JOIN r USING (id)""")
def projected_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with its problem (here its smallest finding), issue, repair and number."""
    found = _findings(spark, sf_dir)
    rows = J.finding_rows(found, _issues(found), _repairs(found))
    named = rows.groupBy("problem").agg(F.min("id").alias("problem_of"))
    return rows.join(named, "problem").join(J.display_numbers(found, "id", "F"), "id").select("id", "part", "problem_of", "priority", "result_class", "issue", "repair", "validated", "display_id")


@query(f"""{_PROJECTED}, g AS (SELECT problem, COUNT(*) AS n, MIN(k) AS k, MAX(CASE verification_status WHEN 'confirmed_error' THEN 1 WHEN 'static_risk' THEN 2 ELSE 3 END) AS s, BOOL_OR(priority) AS priority, BOOL_OR(id % 7 = 0) AS explained FROM c GROUP BY 1),
t AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (s = 1) AS confirmed_error, COUNT(*) FILTER (s = 2) AS static_risk, COUNT(*) FILTER (s = 3) AS needs_review, COUNT(*) FILTER (k = 1) AS confirmed_defect, COUNT(*) FILTER (k = 3) AS needs_verification, COUNT(*) FILTER (k = 4) AS informational_observation,
COUNT(*) FILTER (explained) AS explained, COUNT(*) FILTER (priority) AS priority FROM g)
SELECT t.*, confirmed_defect + static_risk + needs_verification AS actionable_total, (SELECT COUNT(*) FROM c WHERE part = 'code' AND NOT quiet) AS code_issues, (SELECT COUNT(*) FROM c WHERE part = 'code' AND quiet) AS code_notes,
(SELECT COUNT(*) FROM f WHERE id % 6 IN (0, 5)) AS repairs, (SELECT COUNT(*) FROM f WHERE id % 6 IN (0, 5) AND id % 4 = 0) AS validated_repairs FROM t""")
def conclusions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a final report."""
    found = _findings(spark, sf_dir)
    rows = J.finding_rows(found, _issues(found), _repairs(found))
    return J.conclusions(rows, J.problem_rows(rows, _annotations(found)), _repairs(found))


@query("""WITH b AS (SELECT user_id AS project, 'datasets' AS part, '{"file":"' || event_type || '","rows":' || COUNT(*) || ',"columns":' || COUNT(DISTINCT event_id % 5) || '}' AS body FROM events GROUP BY user_id, event_type
UNION ALL SELECT user_id, 'findings', '{"id":' || event_id || ',"rule_id":"R' || (event_id % 4) || '","column":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"c' || (event_id % 13) || '"' END || '}' FROM events WHERE event_type = 'error'
UNION ALL SELECT user_id, 'skipped', '{"path":"' || event_id || '.bin","reason":"binary"}' FROM events WHERE event_id % 97 = 0)
SELECT project, COUNT(*) AS n, sha256(SUM(('0x' || SUBSTR(sha256(part || ':' || body), 1, 15))::BIGINT) || ':' || COUNT(*)) AS fingerprint, sha256('{"datasets":[' || COALESCE(STRING_AGG(body, ',' ORDER BY body) FILTER (part = 'datasets'), '') || '],"findings":[' || COALESCE(STRING_AGG(body, ',' ORDER BY body) FILTER (part = 'findings'), '')
|| '],"skipped":[' || COALESCE(STRING_AGG(body, ',' ORDER BY body) FILTER (part = 'skipped'), '') || ']}') AS document_sha256 FROM b GROUP BY project""")
def project_facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as projects: the tables they have, what was found, what was left out."""
    events = table(spark, sf_dir, "events")
    key = F.col("event_id")
    datasets = events.groupBy("user_id", F.col("event_type").alias("file")).agg(F.count("*").alias("rows"), F.countDistinct(key % 5).alias("columns"))
    found = events.where("event_type = 'error'").select("user_id", key.alias("id"), F.concat(F.lit("R"), (key % 4).cast("string")).alias("rule_id"), F.when(key % 3 != 0, F.concat(F.lit("c"), (key % 13).cast("string"))).alias("column"))
    skipped = events.where("event_id % 97 = 0").select("user_id", F.concat(key.cast("string"), F.lit(".bin")).alias("path"), F.lit("binary").alias("reason"))
    known = J.facts({"datasets": datasets, "findings": found, "skipped": skipped}, "user_id")
    return known.select("project", "n", "fingerprint", F.sha2(F.col("document").cast("binary"), 256).alias("document_sha256"))
