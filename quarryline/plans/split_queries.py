"""Split leakage: rows and entities on both sides, identifier candidates, duplicate artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import artifacts as A
from quarryline.operators import overlap as V
from quarryline.operators import quality as Q
from quarryline.plans.profile_queries import rounded
from quarryline.plans.registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    return events.where("event_id % 4 <> 0"), events.where("event_id % 4 = 0")


def _overlap_sql(source: str, key: str, test: str) -> str:
    return f"""WITH c AS (SELECT {key}, COUNT(*) FILTER (NOT ({test})) AS tr, COUNT(*) FILTER ({test}) AS te FROM {source} GROUP BY {key})
SELECT COUNT(*) FILTER (tr + te > 1) AS duplicate_groups, COUNT(*) FILTER (tr > 0 AND te > 0) AS cross_split_duplicate_groups, COALESCE(SUM(tr + te) FILTER (tr > 0 AND te > 0), 0)::BIGINT AS shared_records FROM c"""


@query(_overlap_sql("events", "user_id", "event_id % 4 = 0"))
def cross_split_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlap_summary(*_events(spark, sf_dir), ["user_id"])


@query(_overlap_sql("documents", "text", "doc_id % 5 = 0"))
def cross_split_full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return V.overlap_summary(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), ["text"])


@query(_overlap_sql("(SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS cust FROM orders)", "o_orderstatus, o_orderpriority, cust", "o_orderkey % 10 = 0"))
def cross_split_feature_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("cust", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")))
    return V.overlap_summary(orders.where("o_orderkey % 10 <> 0"), orders.where("o_orderkey % 10 = 0"), ["o_orderstatus", "o_orderpriority", "cust"])


@query("""SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)""")
def cross_split_shared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return V.shared_rows(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), ["text"]).select("doc_id")


_CANDIDATES = """WITH u AS (SELECT COUNT(*) AS "rows", COUNT(user_id) AS n1, COUNT(DISTINCT user_id) AS u1, COUNT(event_id) AS n2, COUNT(DISTINCT event_id) AS u2 FROM events),
t AS (SELECT 'event_id' AS "column", 'strong' AS strength, u2 AS unique_values, u2 / n2 AS unique_ratio, 1 - n2 / "rows" AS missing_rate FROM u UNION ALL SELECT 'user_id', 'strong', u1, u1 / n1, 1 - n1 / "rows" FROM u)
SELECT "column", strength, unique_values, ROUND(unique_ratio, 6) AS unique_ratio, ROUND(missing_rate, 6) AS missing_rate, CASE WHEN unique_ratio >= 0.8 AND missing_rate <= 0.05 THEN 'High' ELSE 'Medium' END AS confidence FROM t WHERE unique_values > 1 AND unique_ratio >= 0.1 AND missing_rate <= 0.2"""


@query(_CANDIDATES)
def identifier_candidates_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.identifier_candidates(table(spark, sf_dir, "events")), "unique_ratio", "missing_rate", digits=6)


@query(f"""SELECT * FROM ({_CANDIDATES}) ORDER BY confidence = 'High' DESC, strength = 'strong' DESC, unique_ratio DESC, missing_rate, "column" LIMIT 1""")
def best_identifier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.best_candidate(V.identifier_candidates(table(spark, sf_dir, "events"))), "unique_ratio", "missing_rate", digits=6)


@query("""SELECT c_custkey, CASE WHEN ('0x' || SUBSTR(md5('0:' || c_custkey), 1, 8))::UBIGINT / 4294967296 < 0.2 THEN 'test' ELSE 'train' END AS part FROM customer""")
def hash_split_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native split: a row's part depends on its key alone."""
    return V.hash_split(table(spark, sf_dir, "customer"), "c_custkey", 0.2).select("c_custkey", "part")


@query(r"""WITH h AS (SELECT doc_id, REGEXP_REPLACE(REGEXP_REPLACE(REPLACE(REPLACE(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\f\v\x{A0}]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g') AS body FROM documents)
SELECT doc_id AS name, MIN(doc_id) OVER (PARTITION BY body) AS "primary", COUNT(*) OVER (PARTITION BY body) AS "size" FROM h QUALIFY COUNT(*) OVER (PARTITION BY body) > 1""")
def exact_artifacts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def near_artifacts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts of sequence similarity 0.95; tests hold the pairs against difflib."""
    return A.near_groups(A.near_pairs(table(spark, sf_dir, "documents"), "doc_id", "text"))


_SCOPES = (("DQ_CROSS_SPLIT_FEATURE_COMBINATIONS", "Low", "user_id, event_type"), ("DQ_CROSS_SPLIT_ENTITY_ID_OVERLAP", "High", "user_id"))


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{rule}' AS rule_id, '{fields}' AS "column", '{severity}' AS severity, COALESCE(SUM(tr + te) FILTER (tr > 0 AND te > 0), 0)::BIGINT AS detected_count FROM (SELECT {fields}, COUNT(*) FILTER (event_id % 4 <> 0) AS tr, COUNT(*) FILTER (event_id % 4 = 0) AS te FROM events GROUP BY {fields})) WHERE detected_count > 0""" for rule, severity, fields in _SCOPES))
def split_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (part.select("event_id", "user_id", "event_type") for part in _events(spark, sf_dir))
    return Q.audit_split(train, test, ["user_id", "event_type"], ["user_id"]).select("rule_id", "column", "severity", "detected_count")


_LEAKS = (("DQ_CROSS_SPLIT_DUPLICATES", "High", "High", "Confirmed Record Duplication", "order_key, event_type"), ("DQ_CROSS_SPLIT_CANDIDATE_ID_OVERLAP", "Medium", "Medium", "Candidate Entity Overlap", "order_key"))


@query(
    "WITH e AS (SELECT event_id // 2 AS order_key, event_type, event_id % 4 = 0 AS test FROM events) "
    + " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule_id, '{fields}' AS "column", '{severity}' AS severity, '{confidence}' AS confidence, '{nature}' AS issue_nature, SUM(tr + te)::BIGINT AS detected_count, ROUND(SUM(tr + te) / (SELECT COUNT(*) FROM e), 6) AS detected_rate, 'groups=' || COUNT(*) AS evidence
FROM (SELECT {fields}, COUNT(*) FILTER (NOT test) AS tr, COUNT(*) FILTER (test) AS te FROM e GROUP BY {fields}) WHERE tr > 0 AND te > 0 HAVING COUNT(*) > 0"""
        for rule, severity, confidence, nature, fields in _LEAKS
    )
)
def leak_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows, and the column that looks most like an identifier, on both sides of a split."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("order_key"), "event_type", (F.col("event_id") % 4 == 0).alias("test"))
    found = Q.audit_split(events.where("not test").drop("test"), events.where("test").drop("test"))
    return rounded(found.select("rule_id", "column", "severity", "confidence", "issue_nature", "detected_count", "detected_rate", "evidence"), "detected_rate", digits=6)


@query("""SELECT 'DQ_NON_FINITE_NUMERIC' AS rule_id, 'value' AS "column", CASE WHEN COUNT(*) FILTER (event_id % 40 = 0) / COUNT(*) >= 0.05 THEN 'High' ELSE 'Medium' END AS severity, COUNT(*) FILTER (event_id % 40 = 0) AS detected_count, ROUND(COUNT(*) FILTER (event_id % 40 = 0) / COUNT(*), 6) AS detected_rate FROM events
UNION ALL SELECT 'DQ_MISSING_VALUES', 'value', 'Low', COUNT(*) FILTER (event_id % 40 = 1), ROUND(COUNT(*) FILTER (event_id % 40 = 1) / COUNT(*), 6) FROM events
UNION ALL SELECT 'DQ_DUPLICATE_COLUMN_NAME', 'value', 'Medium', 2, NULL UNION ALL SELECT 'DQ_EMPTY_DATASET', NULL, 'High', 0, 1.0""")
def odd_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are infinite or no number, a header that names a column twice, and a table without rows."""
    key = F.col("event_id")
    odd = F.when(key % 40 == 0, F.when(key % 80 == 0, float("inf")).otherwise(float("-inf"))).when(key % 40 == 1, float("nan")).otherwise(F.col("value"))
    events = table(spark, sf_dir, "events").select("event_id", odd.alias("value"))
    rules = ("DQ_NON_FINITE_NUMERIC", "DQ_MISSING_VALUES", "DQ_DUPLICATE_COLUMN_NAME", "DQ_EMPTY_DATASET")
    found = Q.audit(events, header=["event_id", "value", "value"]).unionByName(Q.audit(events.where("event_id < 0")))
    return rounded(found.where(F.col("rule_id").isin(*rules)).select("rule_id", "column", "severity", "detected_count", "detected_rate"), "detected_rate", digits=6)
