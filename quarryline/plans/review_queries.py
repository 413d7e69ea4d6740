"""Samples, rankings, matches and roll-ups of an audit; files and notebooks as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import artifacts as A
from quarryline.operators import merging as M
from quarryline.operators import overlap as V
from quarryline.operators import packing as K
from quarryline.operators import profile as P
from quarryline.operators import quality as Q
from quarryline.operators import review as W
from quarryline.plans.audit_sql import audit_sql
from quarryline.plans.findings_queries import _ACTIVE, _FINDINGS, findings
from quarryline.plans.registry import query, table
from quarryline.sources import files as S
from quarryline.sources.quarantine import scan_with_refusals
from quarryline.sources.scratch import scratch_path


@query("""SELECT source AS "value", MIN(doc_id) AS first_row FROM documents GROUP BY 1 ORDER BY first_row LIMIT 5""")
def first_values_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_values(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 20""")
def affected_rows_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.affected_rows(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey")


@query(f"""SELECT event_id FROM ({_FINDINGS}) WHERE rule_id GLOB 'R[1-3]' AND file GLOB 'f1*'""")
def selected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.selected(findings(spark, sf_dir), {"rule_id": "R[1-3]", "file": "f1*"}).select("event_id")


@query("""SELECT c_custkey, 'P' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS display_id FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS n FROM customer)""")
def display_ids_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.display_ids(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(f"""SELECT category, rule_id AS type, COUNT(*) AS n FROM ({_FINDINGS}) WHERE {_ACTIVE} AND severity = 'Low' GROUP BY ALL""")
def low_roll_up_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.low_roll_up(findings(spark, sf_dir).withColumnRenamed("rule_id", "type"))


@query("""WITH f AS (SELECT p_brand AS title, p_name AS fragment, [LOWER(p_brand), LOWER(p_type), 'part', 'steel'] AS keywords FROM part),
s AS (SELECT title, fragment, 2 * LEN(list_intersect(keywords, ['part', 'steel', 'tin'])) + LEN(list_filter(list_intersect(keywords, ['part', 'steel', 'tin']), lambda k: CONTAINS(LOWER(fragment), k))) AS score FROM f),
b AS (SELECT fragment, MAX(score) AS score FROM s WHERE score > 0 GROUP BY 1) SELECT b.score, MIN(s.title) AS title, b.fragment FROM b JOIN s ON s.fragment = b.fragment AND s.score = b.score GROUP BY ALL ORDER BY b.score DESC, 2, 3 LIMIT 10""")
def ranked_fragments_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.array_distinct(F.array(F.lower("p_brand"), F.lower("p_type"), F.lit("part"), F.lit("steel")))
    fragments = table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.col("p_name").alias("fragment"), keywords.alias("keywords"))
    return W.ranked_fragments(fragments, ["part", "steel", "tin"]).withColumn("score", F.col("score").cast("long"))


@query("""WITH f AS (SELECT event_id AS id, event_type AS type, 'f' || (user_id % 5) || '.py' AS file FROM events), r AS (SELECT event_type AS type, 'f' || (value::BIGINT % 7) || '.py' AS file, MIN(event_id) AS repair FROM events GROUP BY 1, 2)
SELECT id, repair FROM f LEFT JOIN r USING (type, file)""")
def repairs_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"), F.lit(".py")).alias("file"))
    place = F.concat(F.lit("f"), (F.rint("value").cast("long") % 7).cast("string"), F.lit(".py:"), F.col("event_id").cast("string"))
    return W.repairs_of(found, events.select(F.col("event_id").alias("position"), F.col("event_type").alias("problem"), place.alias("location")))


@query("""WITH p AS (SELECT event_id, event_id % 4 = 0 AS priority, event_id % 3 > 0 AND event_type <> (SELECT MIN(event_type) FROM events) AS done FROM events)
SELECT COUNT(*) AS total, COUNT(*) FILTER (done) AS explained, COUNT(*) FILTER (NOT done) AS filled, COUNT(*) FILTER (priority) AS priority_total, COUNT(*) FILTER (priority AND NOT done) AS priority_filled FROM p""")
def review_coverage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    problems = events.select(F.col("event_id").alias("problem"), (F.col("event_id") % 4 == 0).alias("priority"))
    least = events.agg(F.min("event_type").alias("least"))  # one row
    cause = F.when((F.col("event_type") == F.col("least")) | (F.col("event_id") % 3 == 0), "").otherwise("c")
    notes = events.crossJoin(F.broadcast(least)).select(F.col("event_id").alias("problem"), cause.alias("cause"), F.lit("i").alias("potential_impact"), F.lit("r").alias("recommendation"))
    return W.coverage(problems, notes)


@query("""SELECT ROUND(AVG(r), 6) AS missing_rate FROM (SELECT AVG(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS r FROM lineitem UNION ALL SELECT AVG(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END) FROM lineitem)""")
def overall_missing_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, 1).alias("a"), F.when(F.col("l_orderkey") % 10 != 0, 1).alias("b"))
    return W.overall_missing(P.null_profile(dirty)).select(F.round("missing_rate", 6).alias("missing_rate"))


@query("""WITH n AS (SELECT c_nationkey, COUNT(*) AS "rows", CASE WHEN c_nationkey % 2 = 0 THEN 0.2 ELSE 15 END::DOUBLE AS size FROM customer GROUP BY 1),
t AS (SELECT c_nationkey, CASE WHEN size < 1 THEN CEIL("rows" * size) ELSE size END::BIGINT AS test_rows, CASE WHEN size < 1 THEN size ELSE size / "rows" END AS ratio FROM n)
SELECT c_nationkey, test_rows, ROUND(ratio, 6) AS test_ratio, test_rows < 20 OR ratio < 0.05 AS insufficient FROM t""")
def test_sample_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rows"))
    sized = n.select("c_nationkey", W.test_sample(F.col("rows"), F.when(F.col("c_nationkey") % 2 == 0, 0.2).otherwise(15.0)).alias("t"))
    return sized.select("c_nationkey", "t.test_rows", F.round("t.test_ratio", 6).alias("test_ratio"), "t.insufficient")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' WHEN 2 THEN 'train' WHEN 3 THEN 'validation' END AS role, CASE doc_id % 3 WHEN 0 THEN 'rmse' WHEN 1 THEN 'f1' END AS metric FROM documents""")
def roles_and_metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % n + 1).cast("int"))
    named = table(spark, sf_dir, "documents").select("doc_id", pick(["X_valid_test", "test_y", "X_train", "y_val", "data"], 5).alias("name"), pick(["root_mean_squared_error", "f1_score", "print"], 3).alias("call"))
    return named.select("doc_id", W.split_role(F.col("name")).alias("role"), W.metric_of(F.col("call"))["metric"].alias("metric"))


@query("""SELECT c_custkey, 'api_key = "' || CASE WHEN LENGTH(CAST(c_custkey AS VARCHAR)) <= 6 THEN '***' END || '"; db_password: ''' || SUBSTR(c_name, 1, 3) || '...' || RIGHT(c_name, 3) || '''; name = "' || c_name || '"' AS code FROM customer""")
def redacted_code_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit('api_key = "'), F.col("c_custkey").cast("string"), F.lit("\"; db_password: '"), "c_name", F.lit("'; name = \""), "c_name", F.lit('"'))
    return table(spark, sf_dir, "customer").select("c_custkey", W.redacted(code).alias("code"))


@query("""SELECT CASE WHEN event_id % 17 = 0 THEN 'malformed' ELSE 'none' END AS fault, COUNT(*) AS n FROM events GROUP BY 1""")
def payload_faults_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 17 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    return W.parsed_payloads(texts, "props", "map<string,string>", []).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, MIN(event_id) AS place, MAX_BY(value, event_id) AS value FROM events GROUP BY ALL""")
def last_of_each_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id FROM (SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b = event_type""")
def consecutive_repeats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.consecutive_repeats(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type").select("event_id")


@query("""WITH d AS (SELECT DISTINCT lang || '/' || source AS file, CAST(SUBSTR(source, 4) AS INTEGER) AS n, lang FROM documents), t AS (SELECT file, lang || '/src' || (n // 3 * 3) AS parent, 'job' || (n % 4) || lang AS consumer FROM d)
SELECT x.file AS a, y.file AS b FROM t x JOIN t y ON x.file < y.file AND (x.parent = y.parent OR x.consumer = y.consumer) WHERE x.parent <> y.file AND y.parent <> x.file""")
def comparable_pairs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 10).cast("int")
    parent = F.concat("lang", F.lit("/src"), (F.floor(n / 3) * 3).cast("string"))
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return W.comparable_pairs(d.select(F.concat("lang", F.lit("/"), "source").alias("file"), F.array(parent).alias("parents"), F.array(F.concat(F.lit("job"), (n % 4).cast("string"), "lang")).alias("consumers")))


_RATIOS = " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS k, COUNT(DISTINCT {c}) / COUNT({c}) AS ratio FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query(f"""SELECT "column" FROM ({_RATIOS}) WHERE NOT (k > 1 AND ratio < 0.98)""")
def unused_columns_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are the columns that vary and don't tell rows apart."""
    found = P.cardinality(P.value_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "customer").columns))
    return W.unused_columns(found.select("column"), found.where("n_distinct > 1 and unique_ratio < 0.98").select("column"))


_FILES = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/job' || doc_id || '.py' WHEN 1 THEN 'data/' || doc_id || '.CSV' WHEN 2 THEN '../up' || doc_id || '.py' WHEN 3 THEN '.git/c' || doc_id || '.py' WHEN 4 THEN 'bin/' || doc_id || '.exe' WHEN 5 THEN 'Note' || (doc_id // 18) || '.md'
WHEN 6 THEN 'note' || (doc_id // 18) || '.md' WHEN 7 THEN 'README' ELSE 'a/con.txt' END AS path, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 30000000 ELSE n_chars END AS length FROM documents"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    text, block = key.cast("string"), F.floor(key / 18).cast("string")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    cases = [join("src/job", text, ".py"), join("data/", text, ".CSV"), join("../up", text, ".py"), join(".git/c", text, ".py"), join("bin/", text, ".exe"), join("Note", block, ".md"), join("note", block, ".md"), F.lit("README"), F.lit("a/con.txt")]
    length = F.when(key % 11 == 0, 0).when(key % 13 == 0, 30_000_000).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*cases), (key % 9 + 1).cast("int")).alias("path"), length.alias("length"))


@query(f"""WITH f AS ({_FILES}), g AS (SELECT LOWER(path) AS folded, MIN(path) AS first_path FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 9 IN (2, 8) THEN 'unsafe_path' WHEN doc_id % 9 = 3 THEN 'private' WHEN doc_id % 9 IN (4, 7) THEN 'unsupported' WHEN length = 0 THEN 'empty' WHEN length > 25000000 THEN 'too_large' WHEN path <> first_path THEN 'name_conflict' END AS refused,
CASE WHEN doc_id % 9 IN (0, 2, 3) THEN 'code' WHEN doc_id % 9 = 1 THEN 'data' WHEN doc_id % 9 IN (5, 6) THEN 'document' END AS kind FROM f JOIN g ON folded = LOWER(path)""")
def inspected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inspect_files(_files(spark, sf_dir)).select("doc_id", "refused", "kind")


@query(f"""SELECT CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.csv' WHEN 2 THEN '.py' WHEN 3 THEN '.py' WHEN 4 THEN '.exe' WHEN 7 THEN '[no extension]' WHEN 8 THEN '.txt' ELSE '.md' END AS ending, COUNT(*) AS n FROM ({_FILES}) GROUP BY 1""")
def ending_counts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ending_counts(_files(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS cell, turn FROM conversations) SELECT cell, CASE WHEN turn % 3 > 0 THEN turn END AS execution_count, sha256(text) AS source_sha256, COUNT(*) AS n FROM t WHERE role = 'user' GROUP BY ALL""")
def notebook_cells_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as notebooks, user turns as code cells, and read again."""
    path = f"{scratch_path(spark)}/notebooks-{uuid.uuid4().hex}"
    cell = F.struct(F.when(F.col("role") == "user", "code").otherwise("markdown").alias("cell_type"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("execution_count"), F.array("text").alias("source"))
    books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", cell.alias("cell")))).alias("turns"))
    # one notebook a line and line-wise files: the reader takes many of them at once
    books.select(F.to_json(F.struct(F.transform("turns", lambda t: t["cell"]).alias("cells")))).write.text(path)
    cells = S.notebook_cells(spark, path, lines=True)
    return cells.groupBy("cell", "execution_count", F.sha2(F.col("source").cast("binary"), 256).alias("source_sha256")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT CASE WHEN event_id % 50 = 0 THEN -event_id WHEN event_id % 7 = 0 THEN event_id - 1 ELSE event_id END AS id, event_id AS note FROM events), c AS (SELECT id, COUNT(*) AS n FROM a GROUP BY 1)
SELECT note, CASE WHEN id NOT IN (SELECT event_id FROM events) THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'accepted' END AS verdict FROM a JOIN c USING (id)""")
def judged_annotations_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a finding and an annotation: some of the latter of no finding, some of one
    that has another."""
    events = table(spark, sf_dir, "events")
    key = F.col("event_id")
    notes = events.select(F.when(key % 50 == 0, -key).when(key % 7 == 0, key - 1).otherwise(key).alias("id"), key.alias("note"))
    return W.judged_annotations(events.select(key.alias("id")), notes).select("note", "verdict")


#: All white space of Unicode, as a class of SQL's patterns.
_SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""WITH f AS (SELECT doc_id AS file, 'R' || (n_chars % 3) AS rule_id, REGEXP_REPLACE(text, '{_SPACES}', '', 'g') AS snippet, MIN(doc_id) OVER (PARTITION BY text) AS artifact FROM documents)
SELECT artifact, rule_id, sha256(snippet) AS snippet_sha256, MIN(file) AS file, COUNT(*) AS n FROM f GROUP BY artifact, rule_id, snippet""")
def merged_findings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("file"), F.concat(F.lit("R"), (F.col("n_chars") % 3).cast("string")).alias("rule_id"), F.col("text").alias("snippet"))
    primary = docs.groupBy("text").agg(F.min("doc_id").alias("primary"), F.count("*").alias("n")).where("n > 1").select("text", "primary")
    merged = W.merged_findings(found, docs.join(primary, "text").select(F.col("doc_id").alias("name"), "primary"))
    return merged.select("artifact", "rule_id", F.sha2(F.col("snippet").cast("binary"), 256).alias("snippet_sha256"), "file", "n")


@query("""SELECT "column", null_rate FROM (SELECT 'l_tax' AS "column", ROUND(AVG(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END), 6) AS null_rate FROM lineitem UNION ALL SELECT 'l_quantity', ROUND(AVG(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END), 6) FROM lineitem UNION ALL SELECT 'l_orderkey', 0.0 FROM lineitem HAVING COUNT(*) < 0) WHERE null_rate > 0 ORDER BY 2 DESC, 1""")
def missing_ranking_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")).alias("l_tax"))
    return W.missing_ranking(P.null_profile(dirty)).select("column", F.round("null_rate", 6).alias("null_rate"))


@query("""SELECT MIN(place) AS place, user_id FROM (SELECT event_id AS place, user_id FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id + 1000000000, user_id FROM events WHERE event_id % 4 = 0) GROUP BY 2""")
def union_in_order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the train part in order, and behind them those that only the test part has."""
    events = table(spark, sf_dir, "events")
    parts = [events.where("event_id % 4 <> 0"), events.where("event_id % 4 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)]
    return W.union_in_order([p.select("event_id", "user_id") for p in parts], ["user_id"], "event_id").select(F.col("event_id").alias("place"), "user_id")


@query("""WITH f AS (SELECT conv_id AS flow, COUNT(*) AS steps, COUNT(*) FILTER (role = 'user') AS score FROM conversations GROUP BY 1), b AS (SELECT role, MAX(n) AS n FROM (SELECT role, conv_id, COUNT(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1)
SELECT b.role AS view, MIN(c.conv_id) AS flow, b.n AS score FROM b JOIN (SELECT role, conv_id, COUNT(*) AS n FROM conversations GROUP BY 1, 2) c ON c.role = b.role AND c.n = b.n GROUP BY 1, 3""")
def best_flows_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each role the conversation with most of its turns."""
    flows = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("score"))
    return W.best_flow(flows.select(F.col("role").alias("view"), F.col("conv_id").alias("flow"), "score"))


@query("""WITH s AS (SELECT event_id, user_id FROM events WHERE event_type <> (SELECT MAX(event_type) FROM events)), e AS (SELECT DISTINCT user_id % 40 AS k FROM events)
SELECT 'train' AS part, COUNT(*) FILTER (event_id % 4 <> 0 AND event_id IN (SELECT event_id FROM s)) AS known, COUNT(*) FILTER (event_id % 4 <> 0 AND event_id NOT IN (SELECT event_id FROM s)) AS missing, COUNT(*) FILTER (event_id % 4 <> 0 AND event_id NOT IN (SELECT event_id FROM s)) = 0 AS quantifiable FROM events
UNION ALL SELECT 'test', COUNT(*) FILTER (event_id % 4 = 0 AND event_id IN (SELECT event_id FROM s)), COUNT(*) FILTER (event_id % 4 = 0 AND event_id NOT IN (SELECT event_id FROM s)), COUNT(*) FILTER (event_id % 4 = 0 AND event_id NOT IN (SELECT event_id FROM s)) = 0 FROM events""")
def split_restriction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a split by row ids, against a table in which one type of event is absent."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_type").alias("last"))  # one row
    data = events.crossJoin(F.broadcast(last)).where("event_type <> last").select("event_id", "user_id")
    parts = {"train": events.where("event_id % 4 <> 0").select("event_id"), "test": events.where("event_id % 4 = 0").select("event_id")}
    out = None
    for name, ids in parts.items():
        one = V.restriction(data, ids, "event_id").select(F.lit(name).alias("part"), "known", "missing", "quantifiable")
        out = one if out is None else out.unionByName(one)
    return out


_MERGING = """SELECT event_id AS id, user_id AS file, user_id // 10 AS block, 'R' || (event_id % 3) AS rule_id, event_type AS kind, event_id % 3 AS tail FROM events"""


@query(f"""WITH f AS ({_MERGING}), g AS (SELECT DISTINCT block, MIN(file) OVER (PARTITION BY block) AS first_file, block % 2 = 0 AS exact FROM f WHERE block % 5 > 0),
s AS (SELECT f.*, g.first_file, COALESCE(g.exact, FALSE) AS exact, CASE WHEN g.block IS NULL THEN 'alone' || id WHEN exact THEN kind || tail ELSE kind END AS means FROM f LEFT JOIN g USING (block)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY block, rule_id, means, file ORDER BY id) AS turn FROM s)
SELECT MIN_BY(id, (file, id)) AS id, CASE WHEN exact THEN first_file ELSE MIN(file) END AS file, rule_id, COUNT(*) AS n, LIST_SORT(LIST(DISTINCT file)) AS files FROM r GROUP BY block, rule_id, means, turn, exact, first_file""")
def similar_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files, ten of them copies of one another, exact and near ones by turns; what an event
    says is similar where its type is the same, and equal where its tail is too."""
    key = F.col("event_id")
    events = table(spark, sf_dir, "events")
    block = F.floor(F.col("user_id") / 10)
    said = F.concat(F.lit("f["), F.repeat("event_type", 8), F.lit("] "), F.element_at(F.array(*map(F.lit, ("", "a", "B b"))), (key % 3 + 1).cast("int")))
    found = events.select(key.alias("id"), F.col("user_id").alias("file"), key.alias("position"), F.concat(F.lit("R"), (key % 3).cast("string")).alias("rule_id"), F.col("event_type").alias("type"), F.concat(F.lit("cause"), key.cast("string"), F.lit(":7")).alias("root"), said.alias("snippet"), F.lit(None).cast("int").alias("cell"))
    groups = events.where(block % 5 > 0).groupBy(block.alias("block")).agg(F.min("user_id").alias("primary"))
    named = events.select(F.col("user_id").alias("name"), block.alias("block")).distinct().join(groups, "block").select("name", "primary", (F.col("block") % 2 == 0).alias("exact"))
    return M.merged_by_similarity(found, named).select("id", "file", "rule_id", "n", "files")


@query(r"""SELECT p_partkey, sha256('x=''#' || p_name || '''y=' || REPEAT('"', 3) || 'a#' || p_brand || '"b\"#' || REPEAT('"', 3) || 'z=f(1,' || p_size || ')' || CASE p_partkey % 3 WHEN 0 THEN 'broken=''a#nocomment' WHEN 1 THEN 'print(r''\#'',x)' ELSE 'w=x' END) AS plain_sha256
FROM (SELECT p_partkey, REPLACE(p_name, ' ', '') AS p_name, p_brand, p_size FROM part)""")
def comment_free_code_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources, with comments, strings that look like comments, and some that don't parse."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    last = F.when(F.col("p_partkey") % 3 == 0, "broken = 'a # no comment\n").when(F.col("p_partkey") % 3 == 1, "print(r'\\#', x)  # the last\n").otherwise("w = x#\n")
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  # "), name, F.lit("'s\n"))).otherwise(F.concat(F.lit("# it's "), brand, F.lit("\n")))
    code = F.concat(note, F.lit("x = '# "), name, F.lit("'\ny = \"\"\"a#"), brand, F.lit("\n\"b\\\"#\"\"\"\nz = f(1,\n  # "), name, F.lit("\n  "), size, F.lit(")\n"), last)
    plain = A.without_comments(table(spark, sf_dir, "part").select("p_partkey", code.alias("code")), "code")
    return plain.select("p_partkey", F.sha2(F.regexp_replace("code", r"\s+", "").cast("binary"), 256).alias("plain_sha256"))


_FITS = " + ".join(f"CASE WHEN pos + {k} < n AND SUM(size) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) <= 4000 THEN 1 ELSE 0 END" for k in range(1, 8))


@query(f"""WITH RECURSIVE o AS (SELECT event_id AS id, 100 + (event_id * 7919) % 1301 AS size, ROW_NUMBER() OVER (ORDER BY event_type <> 'error', event_id) - 1 AS pos, COUNT(*) OVER () AS n FROM events),
e AS (SELECT pos, pos + 1 + {_FITS} AS until FROM o),
b AS (SELECT 0::BIGINT AS batch, pos, until FROM e WHERE pos = 0 UNION ALL SELECT b.batch + 1, e.pos, e.until FROM b JOIN e ON e.pos = b.until)
SELECT o.id, b.batch, (o.pos - b.pos)::BIGINT AS place FROM o ASOF JOIN b ON o.pos >= b.pos""")
def packed_findings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings, errors first, in batches of eight and of a size of 4000 at most."""
    key = F.col("event_id")
    found = table(spark, sf_dir, "events").select(key.alias("id"), (100 + (key * 7919) % 1301).alias("size"), "event_type")
    return K.pack(found, 8, 4000, F.col("event_type") == "error")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey // 50 AS part FROM customer), f AS (SELECT part, CASE part % 5 WHEN 3 THEN 'undecodable' WHEN 4 THEN 'other_header' END AS refused FROM (SELECT DISTINCT part FROM c)),
r AS (SELECT CASE WHEN k % 13 = 0 THEN 'too_many_fields' WHEN k % 17 = 0 THEN 'too_few_fields' ELSE 'good' END AS reason, COUNT(*) AS n FROM c JOIN f USING (part) WHERE refused IS NULL GROUP BY 1)
SELECT * FROM r UNION ALL SELECT refused, COUNT(*) FROM f WHERE refused IS NOT NULL GROUP BY 1""")
def refused_rows_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files of fifty rows, some of which can't be decoded or have another header,
    and some rows of which have a field too many or too few."""
    path = f"{scratch_path(spark)}/csv-{uuid.uuid4().hex}"
    key, part = F.col("c_custkey"), F.floor(F.col("c_custkey") / 50)
    line = F.concat_ws(",", key.cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', Ltd"')), F.when(key % 13 == 0, F.lit("a,b")).when(key % 17 == 0, F.lit(None)).otherwise("a"))
    header = F.when(F.col("part") % 5 == 4, "id,title,kind\n").otherwise("id,name,kind\n")
    odd = F.when(F.col("part") % 5 == 3, F.lit(b"\n1,\xff\x80,a").cast("string")).otherwise("")
    files = table(spark, sf_dir, "customer").groupBy(part.alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    files.select("part", F.concat(header, "lines", odd).alias("text")).write.partitionBy("part").text(path)
    rows, refused = scan_with_refusals(spark, path, short_rows=True)
    return rows.select(F.lit("good").alias("reason")).unionByName(refused.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SPREAD = "SELECT event_id, CASE WHEN event_id % 97 = 1 THEN value * 1000 WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events"


@query(f"""SELECT (SELECT COUNT(*) FROM events) AS rows, 2::BIGINT AS columns, (SELECT ROUND(AVG(CASE WHEN value IS NULL THEN 1 ELSE 0 END) / 2, 6) FROM ({_SPREAD})) AS missing_rate, COALESCE(SUM(detected_count) FILTER (category = 'Outliers'), 0)::BIGINT AS outliers FROM ({audit_sql(_SPREAD, ["event_id", "value"], [])})""")
def overview_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    spread = table(spark, sf_dir, "events").select("event_id", F.when(key % 97 == 1, F.col("value") * 1000).when(key % 10 != 0, F.col("value")).alias("value"))
    return W.overview(P.null_profile(spread), Q.audit(spread)).withColumn("missing_rate", F.round("missing_rate", 6))


@query("""SELECT 'l_quantity' AS "Column", PRINTF('%.2f%%', AVG(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) * 100) AS "Missing" FROM lineitem UNION ALL SELECT 'l_tax', PRINTF('%.2f%%', AVG(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END) * 100) FROM lineitem UNION ALL SELECT 'l_orderkey', '0.00%'""")
def missing_table_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")).alias("l_tax"))
    return W.missing_table(P.null_profile(dirty))


_FLOW_KINDS = "CASE event_id % 7 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'fit' WHEN 3 THEN 'metric' WHEN 4 THEN 'validation' ELSE 'source' END"


@query(f"""SELECT user_id % 20 AS project, {_FLOW_KINDS} AS kind, ROW_NUMBER() OVER (PARTITION BY user_id % 20, {_FLOW_KINDS} ORDER BY user_id, event_id) AS place, user_id AS file, event_type AS label FROM events""")
def merged_flows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files of twenty projects, their events as what the files do, in order."""
    return W.merged_flows(_flow_events(spark, sf_dir), ["file", "event_id"]).withColumn("place", F.col("place").cast("long"))


def _flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("train", "test", "fit", "metric", "validation", "source", "source"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("project"), F.col("user_id").alias("file"), kind.alias("kind"), F.col("event_type").alias("label"), "event_id")


@query(f"""WITH e AS (SELECT user_id % 20 AS project, user_id AS file, event_id, {_FLOW_KINDS} AS kind, event_type AS label FROM events), k AS (SELECT project, file, COUNT(DISTINCT kind) AS n FROM e GROUP BY 1, 2),
f AS (SELECT project, kind, label, MIN((file, event_id)) AS first_at FROM e GROUP BY 1, 2, 3)
SELECT project, (SELECT COUNT(*) FROM k WHERE k.project = p.project) AS files, (SELECT file FROM k WHERE k.project = p.project ORDER BY n DESC, file LIMIT 1) AS "primary", {", ".join(f"(SELECT COALESCE(STRING_AGG(label, ',' ORDER BY first_at), '') FROM f WHERE f.project = p.project AND kind = '{r}') AS {r}" for r in ("train", "validation", "test"))},
BOOL_OR(kind = 'metric') AS evaluation_detected FROM e p GROUP BY project""")
def flow_summary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.flow_summary(_flow_events(spark, sf_dir), ["file", "event_id"])
    return found.select("project", "files", "primary", *(F.array_join(r, ",").alias(r) for r in ("train", "validation", "test")), "evaluation_detected")
