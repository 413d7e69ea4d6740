"""Findings, scores, truth evaluation, schemas, paths and lineage.  The findings are derived from
events, so that their number grows with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import findings as N
from quarryline.operators import lineage as L
from quarryline.operators import schemas as S
from quarryline.operators.report import save
from quarryline.plans.profile_queries import rounded
from quarryline.plans.registry import query, table
from quarryline.sources.csv_table import typed
from quarryline.sources.scratch import scratch_path

_FINDINGS = """SELECT event_id, user_id, 'f' || (user_id % 12) AS file, event_type AS category, 'R' || (user_id % 6) AS rule_id, CASE WHEN event_id % 10 = 0 THEN 'High' WHEN event_id % 10 < 4 THEN 'Medium' ELSE 'Low' END AS severity,
CASE WHEN event_id % 2 = 0 THEN 'High' ELSE 'Medium' END AS confidence, CASE WHEN event_id % 8 = 0 THEN 'Informational' ELSE 'Review' END AS action, CASE WHEN event_id % 9 = 0 THEN 0.0 END AS score_impact, CASE WHEN event_id % 5 = 0 THEN 'Rule Violation' ELSE 'Needs Review' END AS issue_nature FROM events"""
_ACTIVE = "COALESCE(score_impact, 1.0) <> 0 AND action <> 'Informational'"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.concat(F.lit("f"), (F.col("user_id") % 12).cast("string")).alias("file"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("R"), (F.col("user_id") % 6).cast("string")).alias("rule_id"),
        F.when(key % 10 == 0, "High").when(key % 10 < 4, "Medium").otherwise("Low").alias("severity"),
        F.when(key % 2 == 0, "High").otherwise("Medium").alias("confidence"),
        F.when(key % 8 == 0, "Informational").otherwise("Review").alias("action"),
        F.when(key % 9 == 0, 0.0).alias("score_impact"),
        F.when(key % 5 == 0, "Rule Violation").otherwise("Needs Review").alias("issue_nature"),
    )


@query(f"""SELECT severity, COUNT(*) AS n FROM ({_FINDINGS}) WHERE {_ACTIVE} GROUP BY 1""")
def severity_counts_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.severity_counts(findings(spark, sf_dir))


_CLASS = f"""SELECT *, CASE WHEN NOT ({_ACTIVE}) THEN 4 WHEN issue_nature IN ('Confirmed Invalid', 'Rule Violation') AND confidence = 'High' THEN 1 ELSE 3 END AS k FROM ({_FINDINGS})"""
_NAME = "CASE k WHEN 1 THEN 'confirmed_defect' WHEN 2 THEN 'static_risk' WHEN 3 THEN 'needs_verification' ELSE 'informational_observation' END"


@query(f"""SELECT {_NAME} AS result_class, COUNT(*) AS n FROM ({_CLASS}) GROUP BY 1""")
def result_classes_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_class(N.with_status(findings(spark, sf_dir))).groupBy("result_class").agg(F.count("*").alias("n"))


@query(f"""SELECT problem, {_NAME} AS result_class, n FROM (SELECT file || '/' || category || '/' || rule_id AS problem, MIN(k) AS k, COUNT(*) AS n FROM ({_CLASS}) GROUP BY 1)""")
def problems_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.problems(N.with_class(N.with_status(findings(spark, sf_dir))), F.concat_ws("/", "file", "category", "rule_id"))


def _rules_sql(by: str, high: float, medium: float, low: float, step: float, most: float) -> str:
    return f"""SELECT {by}category, rule_id, MAX(CASE severity WHEN 'High' THEN {high} WHEN 'Medium' THEN {medium} ELSE {low} END) + LEAST({most}, (COUNT(*) - 1) * {step}) AS p FROM ({_FINDINGS}) WHERE {_ACTIVE} GROUP BY ALL"""


_PENALTY = f"""SELECT file, LEAST(35.0, SUM(p))::DOUBLE AS penalty FROM (SELECT file, category, LEAST(10.0, SUM(p)) AS p FROM ({_rules_sql('file, ', 8.0, 3.5, 0.75, 0.5, 2.0)}) GROUP BY 1, 2) GROUP BY 1"""


@query(_PENALTY)
def penalty_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.bounded_penalty(findings(spark, sf_dir), by=("file",))


@query(f"""SELECT file, category, GREATEST(0, ROUND_EVEN(100 - LEAST(100, SUM(p)), 0))::BIGINT AS score FROM ({_rules_sql('file, ', 18.0, 7.0, 2.0, 1.0, 3.0)}) GROUP BY 1, 2""")
def report_score_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.report_score(findings(spark, sf_dir), by=("file", "category"))


@query(f"""SELECT user_id, GREATEST(0, ROUND_EVEN(100 - LEAST(100, SUM(p)), 0))::BIGINT AS score FROM ({_rules_sql('user_id, ', 14.0, 6.0, 1.5, 0.5, 2.0)}) GROUP BY 1""")
def display_score_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each user's findings; that of all of them together is zero."""
    return N.display_score(findings(spark, sf_dir), by=("user_id",))


@query(f"""WITH s AS (SELECT file, GREATEST(0, 35 - penalty / 2) AS score FROM ({_PENALTY})), g AS (SELECT file, CASE WHEN CAST(SUBSTR(file, 2) AS INTEGER) % 4 = 3 THEN file ELSE 'g' || (CAST(SUBSTR(file, 2) AS INTEGER) // 4) END AS g, score FROM s)
SELECT ROUND_EVEN(AVG(low), 0)::BIGINT AS data_score FROM (SELECT g, MIN(score) AS low FROM g GROUP BY 1)""")
def lineage_min_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files f0-f2, f4-f6 and f8-f10 are derived from one another; the others stand alone."""
    found = N.bounded_penalty(findings(spark, sf_dir), by=("file",))
    scores = found.select("file", F.greatest(F.lit(0.0), 35 - F.col("penalty") / 2).alias("score"))
    n = F.substring("file", 2, 10).cast("int")
    edges = scores.where((n % 4 == 1) | (n % 4 == 2)).select(F.col("file").alias("child"), F.concat(F.lit("f"), (n - 1).cast("string")).alias("parent"))
    return N.data_score(scores, L.components(edges, "parent", "child"))


_TRUTH_OK = "(f.nature_ok = t.expect_ok AND (f.severity = 'High' OR f.severity = 'Medium'))"


_TRUTH = f"""WITH f AS (SELECT event_id, category, event_id % 3 > 0 AS there, severity, issue_nature = 'Rule Violation' AND confidence = 'High' AS nature_ok FROM ({_FINDINGS})), t AS (SELECT event_id, event_id % 20 = 0 AS expect_ok FROM events),
m AS (SELECT t.event_id, f.category, f.there AS found, f.there AND {_TRUTH_OK} AS ok FROM t JOIN f USING (event_id))"""


def _evaluated(spark: SparkSession, sf_dir: str, of: str | None = None) -> DataFrame:
    """Every event is a truth; a third of the findings is reported at another place."""
    found = N.with_status(findings(spark, sf_dir))
    place = F.concat(F.when(F.col("event_id") % 3 == 0, "elsewhere ").otherwise(""), F.col("event_id").cast("string"))
    found = found.select(F.col("event_id").alias("id"), F.lit("R").alias("rule_id"), place.alias("location"), "verification_status", "severity", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("evidence"), F.col("category").alias("of"))
    truth = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("truth_id"),
        F.lit("R").alias("rule_id"),
        F.col("event_id").cast("string").alias("location"),
        F.when(F.col("event_id") % 20 == 0, "confirmed_error").otherwise("needs_review").alias("verification_status"),
        F.array(F.lit("High"), F.lit("Medium")).alias("severities"),
        F.col("event_id").cast("string").alias("evidence"),
        F.col("event_type").alias("of"),
    )
    if of is not None:
        found, truth = found.where(F.col("of") == of), truth.where(F.col("of") == of)
    return N.evaluate(found.drop("of"), truth.drop("of"))


@query(f"""{_TRUTH}, c AS (SELECT COUNT(*) FILTER (ok) AS tp, COUNT(*) FILTER (found AND NOT ok) AS fp, COUNT(*) FILTER (NOT ok) AS fn FROM m)
SELECT tp, fp, fn, ROUND(tp / (tp + fp), 6) AS "precision", ROUND(tp / (tp + fn), 6) AS recall FROM c""")
def truth_match_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evaluated(spark, sf_dir), "precision", "recall", digits=6)


@query(f"""{_TRUTH}, c AS (SELECT category, COUNT(*) FILTER (ok) AS tp, COUNT(*) FILTER (found AND NOT ok) AS fp, COUNT(*) FILTER (NOT ok) AS fn FROM m GROUP BY 1)
SELECT COUNT(*) AS cases, SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn, ROUND(SUM(tp) / SUM(tp + fp), 6) AS "precision", ROUND(SUM(tp) / SUM(tp + fn), 6) AS recall,
ROUND(AVG(tp / NULLIF(tp + fp, 0)), 6) AS macro_precision, ROUND(AVG(tp / NULLIF(tp + fn, 0)), 6) AS macro_recall FROM c""")
def macro_average_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of event is a case."""
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    cases = None
    for kind in kinds:
        one = _evaluated(spark, sf_dir, kind).select(F.lit(kind).alias("case"), "tp", "fp", "fn")
        cases = one if cases is None else cases.unionByName(one)
    return rounded(N.macro_average(cases), "precision", "recall", "macro_precision", "macro_recall", digits=6)


_CODE_RULES = f"SELECT category, rule_id, MAX(CASE severity WHEN 'High' THEN 10.0 WHEN 'Medium' THEN 4.0 ELSE 1.25 END) + LEAST(2.0, (COUNT(*) - 1) * 0.5) AS p FROM ({_FINDINGS}) WHERE {_ACTIVE} AND user_id % 3 = 0 AND severity <> 'High' AND category = (SELECT MIN(event_type) FROM events) GROUP BY ALL"
_FILE_SCORES = f"SELECT file, 35 - LEAST(35.0, SUM(p))::DOUBLE AS score FROM (SELECT file, category, LEAST(10.0, SUM(p)) AS p FROM ({_rules_sql('file, ', 8.0, 3.5, 0.75, 0.5, 2.0)}) GROUP BY 1, 2) GROUP BY 1"


@query(f"""WITH c AS (SELECT ROUND_EVEN(35 - LEAST(35, COALESCE(SUM(p), 0))::DOUBLE, 0)::BIGINT AS code_score FROM (SELECT LEAST(14.0, SUM(p)) AS p FROM ({_CODE_RULES}) GROUP BY category)),
d AS (SELECT ROUND_EVEN(AVG(low), 0)::BIGINT AS data_score FROM (SELECT CAST(SUBSTR(file, 2) AS INTEGER) // 2 AS g, MIN(score) AS low FROM ({_FILE_SCORES}) GROUP BY 1))
SELECT code_score, data_score, 30::BIGINT AS completeness, code_score + data_score + 30 AS score FROM c, d""")
def project_score_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser findings of every third user, of the first type, are of code; each two files are
    derived from one another."""
    found = findings(spark, sf_dir)
    first = found.agg(F.min("category").alias("first"))  # one row
    code = found.where("user_id % 3 = 0 and severity <> 'High'").crossJoin(F.broadcast(first)).where("category = first").drop("first")
    scores = N.bounded_penalty(found, by=("file",)).select("file", (35 - F.col("penalty")).alias("score"))
    n = F.substring("file", 2, 10).cast("int")
    edges = scores.where(n % 2 == 1).select(F.col("file").alias("child"), F.concat(F.lit("f"), (n - 1).cast("string")).alias("parent"))
    return N.project_score(code, scores, L.components(edges, "parent", "child"), 3)


@query(f"""SELECT event_id, severity = 'High' OR (issue_nature = 'Rule Violation' AND confidence = 'High') AS priority FROM ({_FINDINGS})""")
def priorities_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_status(findings(spark, sf_dir)).select("event_id", N.is_priority().alias("priority"))


_NAMED = f"SELECT *, ['DQ_HIGH_CORRELATION', 'DQ_MISSING_VALUES', 'DQ_POTENTIAL_ID', 'DQ_BLANK_STRING', 'DQ_SINGLE_CATEGORY', 'DQ_DUPLICATE_ROWS'][CAST(SUBSTR(rule_id, 2) AS INTEGER) + 1] AS rule, ['train', 'model_evaluation_report', 'raw', 'feature_importance_result'][CAST(SUBSTR(file, 2) AS INTEGER) % 4 + 1] AS role FROM ({_FINDINGS})"


@query(f"""SELECT role, rule AS rule_id, CASE WHEN n THEN 'Low' ELSE severity END AS severity, CASE WHEN n THEN 'Informational' ELSE action END AS action, CASE WHEN n THEN 'Artifact Observation' ELSE issue_nature END AS issue_nature, COUNT(*) AS n
FROM (SELECT *, role IN ('model_evaluation_report', 'feature_importance_result') AND rule IN ('DQ_HIGH_CORRELATION', 'DQ_POTENTIAL_ID', 'DQ_SINGLE_CATEGORY') AS n FROM ({_NAMED})) GROUP BY ALL""")
def findings_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), n + 1)
    rules = ("DQ_HIGH_CORRELATION", "DQ_MISSING_VALUES", "DQ_POTENTIAL_ID", "DQ_BLANK_STRING", "DQ_SINGLE_CATEGORY", "DQ_DUPLICATE_ROWS")
    named = found.withColumn("rule_id", pick(rules, F.substring("rule_id", 2, 10).cast("int")))
    roles = found.select("file").distinct().withColumn("role", pick(("train", "model_evaluation_report", "raw", "feature_importance_result"), F.substring("file", 2, 10).cast("int") % 4))
    return N.by_role(named, roles).groupBy("role", "rule_id", "severity", "action", "issue_nature").agg(F.count("*").alias("n"))


@query(f"""SELECT category AS "Category", severity AS "Severity", rule_id AS "Rule", COALESCE(file, '-') AS "Column", 3::BIGINT AS "Count", '12.5%' AS "Rate", action AS "Action" FROM ({_FINDINGS}) WHERE category = (SELECT MIN(event_type) FROM events)""")
def issue_table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of one category, as it is shown."""
    found = findings(spark, sf_dir).withColumns({"column": F.col("file"), "detected_count": F.lit(3).cast("long"), "detected_rate": F.lit(0.125)})
    first = found.agg(F.min("category")).first()[0]
    return N.issue_table(N.category_view(found, (first,)))


@query(f"""SELECT severity, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids FROM ({_FINDINGS}) GROUP BY 1""")
def saved_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings written as JSON, as evidence is, and read again."""
    path = f"{scratch_path(spark)}/evidence-{uuid.uuid4().hex}"
    save(findings(spark, sf_dir), path, "json")
    return spark.read.schema("event_id long, severity string").json(path).groupBy("severity").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""SELECT f.event_id, i.issue FROM ({_FINDINGS}) f LEFT JOIN (SELECT file, rule_id, MIN(event_id) AS issue FROM ({_FINDINGS}) WHERE severity = 'High' GROUP BY 1, 2) i USING (file, rule_id)""")
def first_issues_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    issues = found.where("severity = 'High'").select(F.col("event_id").alias("position"), "file", "rule_id")
    return N.with_first_issue(found, issues).select("event_id", "issue")


@query(f"""SELECT file, category, rule_id, p AS penalty, ROW_NUMBER() OVER (PARTITION BY file ORDER BY p DESC, category, rule_id)::INTEGER AS place FROM (SELECT file, category, rule_id, p::DOUBLE AS p FROM ({_rules_sql('file, ', 8.0, 3.5, 0.75, 0.5, 2.0)}))""")
def ranked_penalties_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalties = N.rule_penalties(findings(spark, sf_dir), N.DATA_WEIGHTS, 0.5, 2.0, ("file",))
    return N.penalty_ranking(penalties).select("file", "category", "rule_id", "penalty", "place")


@query(f"""WITH d AS (SELECT event_id, SUBSTR(sha256('{{"file":"' || file || '","rule_id":"' || rule_id || '","user_id":' || user_id || '}}'), 1, 16) AS digest FROM ({_FINDINGS}))
SELECT digest, COUNT(*) AS n, 'F-' || digest || CASE WHEN COUNT(*) > 1 THEN '-' || COUNT(*) ELSE '' END AS last_id FROM d GROUP BY 1""")
def finding_ids_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings share an identity, and the id of the last of them."""
    ids = N.with_ids(findings(spark, sf_dir), "file", "rule_id", "user_id").select("id", F.split("id", "-")[1].alias("digest"))
    return ids.groupBy("digest").agg(F.count("*").alias("n"), F.max_by("id", F.coalesce(F.get(F.split("id", "-"), F.lit(2)).cast("int"), F.lit(1))).alias("last_id"))


#: Text columns of two related tables: name, and the text as SQL.
_SCHEMAS = {
    "customer": {"custkey": "CAST(c_custkey AS VARCHAR)", "name": "c_name", "nationkey": "CAST(c_nationkey AS VARCHAR)", "acctbal": "CAST(c_acctbal AS VARCHAR)", "mktsegment": "c_mktsegment"},
    "supplier": {"suppkey": "CAST(s_suppkey AS VARCHAR)", "Name": "s_name", "nationkey": "CASE WHEN s_suppkey % 9 = 1 THEN 'n' ELSE '' END || s_nationkey", "acctbal": "CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR)"},
}
_TYPE = r"""CASE WHEN COUNT(x) = 0 THEN 'double' WHEN BOOL_AND(REGEXP_FULL_MATCH(x, '[+-]?\d{1,18}')) THEN 'bigint' WHEN BOOL_AND(TRY_CAST(x AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END"""
_TYPED = " UNION ALL ".join(f"""SELECT '{file}' AS file, '{c}' AS c, {_TYPE} AS t FROM (SELECT {x} AS x FROM {file})""" for file, columns in _SCHEMAS.items() for c, x in columns.items())


@query(f"""WITH s AS ({_TYPED}), r AS (SELECT * FROM s WHERE file = 'customer'), o AS (SELECT * FROM s WHERE file <> 'customer')
SELECT 'supplier' AS file, 'DQ_SCHEMA_DIFFERENCE' AS rule_id, c AS "column", 'missing' AS detail FROM r WHERE c NOT IN (SELECT c FROM o) UNION ALL SELECT file, 'DQ_SCHEMA_DIFFERENCE', c, 'extra' FROM o WHERE c NOT IN (SELECT c FROM r)
UNION ALL SELECT o.file, 'DQ_COLUMN_NAME_FORMAT', o.c, r.c FROM o JOIN r ON LOWER(o.c) = LOWER(r.c) AND o.c <> r.c UNION ALL SELECT o.file, 'DQ_CROSS_FILE_DTYPE', o.c, r.t || ' / ' || o.t FROM o JOIN r ON LOWER(o.c) = LOWER(r.c) AND o.t <> r.t""")
def schema_diff_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as text, with the types that all their values have."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    customer = customer.select(*(F.col(f"c_{c}").cast("string").alias(c) for c in _SCHEMAS["customer"]))
    key = F.concat(F.when(F.col("s_suppkey") % 9 == 1, "n").otherwise(""), F.col("s_nationkey").cast("string"))
    supplier = supplier.select(F.col("s_suppkey").cast("string").alias("suppkey"), F.col("s_name").alias("Name"), key.alias("nationkey"), F.rint("s_acctbal").cast("long").cast("string").alias("acctbal"))
    return S.compare_schemas(S.schema_table(spark, {"customer": typed(customer), "supplier": typed(supplier)}), "customer")


_MARKS = """SELECT c_nationkey % 2 AS half, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no' END ELSE CAST(c_custkey % 2 AS VARCHAR) END AS flag FROM customer"""


@query(f"""WITH t AS (SELECT half, STRING_AGG(DISTINCT LOWER(flag), ',' ORDER BY LOWER(flag)) AS shown, BOOL_OR(flag IN ('0', '1')) AS digits FROM ({_MARKS}) GROUP BY 1)
SELECT 'b' AS file, 'DQ_CROSS_FILE_CATEGORY_ENCODING' AS rule_id, 'Flag' AS "column", x.shown || ' / ' || y.shown AS detail FROM t x JOIN t y ON x.half = 0 AND y.half = 1 AND x.digits <> y.digits""")
def encoding_diff_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of customers, one with words and one with digits for the same flag."""
    key = F.col("c_custkey")
    half = F.col("c_nationkey") % 2
    flag = F.when(half == 0, F.when(key % 3 == 0, "yes").otherwise("no")).otherwise((key % 2).cast("string"))
    marks = table(spark, sf_dir, "customer").select(F.when(half == 0, "a").otherwise("b").alias("file"), F.when(half == 0, "flag").otherwise("Flag").alias("column"), flag.alias("flag"))
    return S.compare_encodings(marks.groupBy("file", "column").agg(F.collect_set("flag").alias("tokens")), "a")


_READS = """SELECT DISTINCT 'src' || (doc_id % 7) || '/job' || (doc_id % 50) || '.py' AS code, CASE doc_id % 4 WHEN 0 THEN 'data/' || lang || '/' || source || '.csv' WHEN 1 THEN source || '.csv' WHEN 2 THEN lang || '/' || source || '.csv' ELSE 'lost' || (doc_id % 3) || '.csv' END AS path FROM documents"""


@query(f"""WITH f AS (SELECT DISTINCT 'data/' || lang || '/' || source || '.csv' AS file FROM documents UNION SELECT 'only.csv'), r AS ({_READS} UNION SELECT 'src0/main.py', 'x/only.csv' UNION SELECT 'src0/main.py', 'only.csv'),
c AS (SELECT code, path, file, CASE WHEN file = path OR file = regexp_extract(code, '^(.*)/[^/]*$', 1) || '/' || path THEN 1 WHEN path LIKE '%/%' AND file LIKE '%/' || path THEN 2 WHEN path NOT LIKE '%/%' AND (file = path OR file LIKE '%/' || path) THEN 3 END AS tier FROM r, f),
b AS (SELECT r.code, r.path, MIN(tier) AS best FROM r LEFT JOIN c ON r.code = c.code AND r.path = c.path AND tier IS NOT NULL GROUP BY 1, 2),
n AS (SELECT b.code, b.path, best, COUNT(c.file) AS k, MIN(c.file) AS file FROM b LEFT JOIN c ON b.code = c.code AND b.path = c.path AND c.tier = b.best GROUP BY 1, 2, 3)
SELECT code, path, CASE WHEN k = 1 THEN file END AS file, CASE WHEN best IS NULL THEN 'not_imported' WHEN k > 1 THEN 'ambiguous_path' WHEN best = 1 THEN 'explicit_path' WHEN best = 2 THEN 'project_relative_suffix' ELSE 'unique_basename' END AS how FROM n""")
def resolve_paths_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("data/"), "lang", F.lit("/"), "source", F.lit(".csv"))
    files = docs.select(own.alias("file")).distinct().union(spark.createDataFrame([("only.csv",)], "file string"))
    key = F.col("doc_id")
    path = F.when(key % 4 == 0, own).when(key % 4 == 1, F.concat("source", F.lit(".csv"))).when(key % 4 == 2, F.concat("lang", F.lit("/"), "source", F.lit(".csv"))).otherwise(F.concat(F.lit("lost"), (key % 3).cast("string"), F.lit(".csv")))
    code = F.concat(F.lit("src"), (key % 7).cast("string"), F.lit("/job"), (key % 50).cast("string"), F.lit(".py"))
    reads = docs.select(code.alias("code"), path.alias("path")).distinct().union(spark.createDataFrame([("src0/main.py", "x/only.csv"), ("src0/main.py", "only.csv")], "code string, path string"))
    return L.resolve_paths(reads, files)


_EDGES = """SELECT c_custkey AS a, c_custkey - c_custkey % 6 AS b FROM customer WHERE c_custkey % 6 > 0 UNION ALL SELECT c_custkey, c_custkey - 6 FROM customer WHERE c_custkey % 12 = 6"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT b, seen FROM r JOIN both_ways ON node = a)
SELECT node, MIN(seen) AS component FROM r GROUP BY 1""")
def lineage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    edges = customer.where(key % 6 > 0).select(key.alias("a"), (key - key % 6).alias("b")).union(customer.where(key % 12 == 6).select(key, key - 6))
    return L.components(edges, "a", "b")


@query("""WITH t AS (SELECT DISTINCT lang, source FROM documents), p AS (SELECT CASE CAST(SUBSTR(source, 4) AS INTEGER) % 6 WHEN 0 THEN 'data/raw/' WHEN 1 THEN 'data/train/' WHEN 2 THEN 'out/test-' WHEN 3 THEN 'x/feature_importance_' WHEN 4 THEN 'd/valid.' ELSE 'd/' END || lang || '_' || source || '.csv' AS path FROM t)
SELECT path, CASE WHEN path LIKE '%feature_importance%' THEN 'feature_importance_result' WHEN path LIKE 'data/train/%' THEN 'train' WHEN path LIKE 'out/test-%' THEN 'test' WHEN path LIKE 'd/valid.%' THEN 'validation' WHEN path LIKE 'data/raw/%' THEN 'raw' ELSE 'unassociated' END AS role FROM p""")
def dataset_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    folder = F.element_at(F.array(*map(F.lit, ("data/raw/", "data/train/", "out/test-", "x/feature_importance_", "d/valid.", "d/"))), F.substring("source", 4, 10).cast("int") % 6 + 1)
    named = files.select(F.concat(folder, "lang", F.lit("_"), "source", F.lit(".csv")).alias("path"))
    role = L.dataset_role(F.col("path"), F.array(F.lit("doc_id"), F.lit("text")), F.lit(1000), F.lit(False))
    return named.select("path", role["role"].alias("role"))


@query(f"""WITH w AS (SELECT DISTINCT 'src' || (doc_id % 7) || '/job' || (doc_id % 50) || '.py' AS code, 'out/' || lang || '.csv' AS child FROM documents), r AS (SELECT DISTINCT code, 'data/' || lang || '/' || source || '.csv' AS parent FROM (SELECT 'src' || (doc_id % 7) || '/job' || (doc_id % 50) || '.py' AS code, lang, source FROM documents WHERE doc_id % 4 = 0))
SELECT parent, child, code FROM r JOIN w USING (code)""")
def lineage_edges_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    code = F.concat(F.lit("src"), (key % 7).cast("string"), F.lit("/job"), (key % 50).cast("string"), F.lit(".py")).alias("code")
    read = F.when(key % 4 == 0, F.concat(F.lit("data/"), "lang", F.lit("/"), "source", F.lit(".csv")))
    return L.lineage_edges(docs.select(code, read.alias("file")), docs.select(code, F.concat(F.lit("out/"), "lang", F.lit(".csv")).alias("file")))


@query("""WITH r AS (SELECT user_id % 30 AS code, event_type || (user_id % 3) AS dataset, value IS NOT NULL AND user_id % 5 > 0 AS safe FROM events WHERE user_id % 30 >= 10 OR event_type = (SELECT MIN(event_type) FROM events)),
s AS (SELECT code, MIN(dataset) AS dataset FROM r GROUP BY 1 HAVING MIN(dataset) = MAX(dataset) AND BOOL_AND(safe)), m AS (SELECT dataset, code % 4 AS signature, MIN(1000 + code) AS flow FROM s GROUP BY 1, 2), c AS (SELECT dataset, COUNT(*) AS n, MIN(flow) AS flow FROM m GROUP BY 1)
SELECT dataset, CASE WHEN n = 1 THEN flow END AS flow, CASE WHEN n IS NULL THEN 'unassociated' WHEN n > 1 THEN 'several_flows' ELSE 'matched' END AS how FROM (SELECT DISTINCT dataset FROM r) LEFT JOIN c USING (dataset)""")
def bound_flows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as code that reads types of events; the first ten read one type only."""
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type").alias("least"))  # one row
    code = (F.col("user_id") % 30).alias("code")
    reads = events.crossJoin(F.broadcast(least)).where((F.col("user_id") % 30 >= 10) | (F.col("event_type") == F.col("least")))
    reads = reads.select(code, F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("dataset"), (F.col("value").isNotNull() & (F.col("user_id") % 5 > 0)).alias("replay_safe"))
    flows = events.select(code).distinct().select((F.col("code") + 1000).alias("flow"), "code", (F.col("code") % 4).alias("signature"))
    return L.bound_flows(reads, flows)


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a/./b/' || lang WHEN 1 THEN 'a\b\..\' || lang WHEN 2 THEN '../' || source WHEN 3 THEN '/../x//' || source WHEN 4 THEN 's3://b//' || lang ELSE './' END AS path FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN REPLACE(path, '/./', '/') WHEN 1 THEN REPLACE(path, '\b\..\', '/') WHEN 2 THEN path WHEN 3 THEN REPLACE(path, '/../x//', '/x/') WHEN 4 THEN path ELSE '.' END AS path FROM p""".replace("\\\\", "\\"))
def normal_paths_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id") % 6
    path = F.when(key == 0, F.concat(F.lit("a/./b/"), "lang")).when(key == 1, F.concat(F.lit("a\\b\\..\\"), "lang")).when(key == 2, F.concat(F.lit("../"), "source")).when(key == 3, F.concat(F.lit("/../x//"), "source")).when(key == 4, F.concat(F.lit("s3://b//"), "lang")).otherwise("./")
    return table(spark, sf_dir, "documents").select("doc_id", L.normal_path(path).alias("path"))
