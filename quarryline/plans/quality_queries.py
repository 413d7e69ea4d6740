"""Rules over text, domains and ranges.  The given tables are clean, so dirt is derived from them
by the same expressions here and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import values as V
from quarryline.operators import duplicates as D
from quarryline.operators import profile as P
from quarryline.operators import quality as Q
from quarryline.plans.audit_sql import audit_sql
from quarryline.plans.profile_queries import rounded
from quarryline.plans.registry import query, table

#: A customer table with blanks, missing-value words, outer white space and mixed case.
_DIRTY_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 13 = 0 THEN ' N/A' WHEN c_custkey % 17 = 0 THEN 'null' WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' ' WHEN c_custkey % 5 = 0 THEN LOWER(c_mktsegment) ELSE c_mktsegment END AS segment,
CASE WHEN c_custkey % 9 = 0 THEN 'n' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'Yes' WHEN c_custkey % 3 = 1 THEN 'no' ELSE '1' END AS flag FROM customer"""
#: The tokens that stand for a missing value, as SQL.
_TOKENS = "('na','n/a','null','none','?','-','--','unknown')"


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 11 == 0, "   ").when(key % 13 == 0, " N/A").when(key % 17 == 0, "null").when(key % 7 == 0, F.concat(segment, F.lit(" "))).when(key % 5 == 0, F.lower(segment)).otherwise(segment).alias("segment"),
        F.when(key % 9 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "no").otherwise("1").alias("flag"),
    )


@query(f"""WITH t AS ({_DIRTY_SQL}) SELECT 'segment' AS "column", COUNT(segment) AS n, COUNT(*) FILTER (TRIM(segment) = '') AS blank, COUNT(*) FILTER (segment <> TRIM(segment)) AS spaced, COUNT(*) FILTER (LENGTH(segment) > 10000) AS "long" FROM t
UNION ALL SELECT 'nation', COUNT(nation), COUNT(*) FILTER (TRIM(nation) = ''), COUNT(*) FILTER (nation <> TRIM(nation)), COUNT(*) FILTER (LENGTH(nation) > 10000) FROM t""")
def blank_and_spaced_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.text_metrics(dirty_customer(spark, sf_dir), ["segment", "nation"]).select("column", "n", "blank", "spaced", "long")


@query(f"""WITH t AS ({_DIRTY_SQL}) SELECT 'segment' AS "column", LOWER(TRIM(segment)) AS token, COUNT(*) AS n FROM t WHERE LOWER(TRIM(segment)) IN {_TOKENS} GROUP BY 2""")
def missing_tokens_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_tokens(Q.stripped_counts(dirty_customer(spark, sf_dir), ["segment", "nation"]))


@query(f"""WITH t AS ({_DIRTY_SQL}) SELECT 'segment' AS "column", LOWER(TRIM(segment)) AS folded, COUNT(DISTINCT TRIM(segment)) AS spellings FROM t GROUP BY 2 HAVING COUNT(DISTINCT TRIM(segment)) > 1""")
def case_variants_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.case_variants(Q.stripped_counts(dirty_customer(spark, sf_dir), ["segment"]))


@query("""SELECT 'text' AS "column", COUNT(*) FILTER (LENGTH(text) > 10000) AS "long" FROM documents""")
def long_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.text_metrics(table(spark, sf_dir, "documents").select("text"), ["text"]).select("column", "long")


@query(f"""WITH t AS ({_DIRTY_SQL}) SELECT COUNT(*) AS meaningful, COUNT(TRY_CAST(nation AS DOUBLE)) AS "numeric", ROUND(COUNT(TRY_CAST(nation AS DOUBLE)) / COUNT(*), 6) AS ratio FROM t""")
def numeric_parse_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.text_metrics(dirty_customer(spark, sf_dir), ["nation"])
    return found.select("meaningful", "numeric", F.round(F.col("numeric") / F.col("meaningful"), 6).alias("ratio"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN '2020-13-45' ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT COUNT(*) AS meaningful, COUNT(*) FILTER (REGEXP_MATCHES(d, '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}')) AS dated, COUNT(TRY_STRPTIME(d, '%Y-%m-%d')) AS parsed_dates FROM t""")
def datetime_parse_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 19 == 0, "2020-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return Q.text_metrics(orders, ["d"]).select("meaningful", "dated", "parsed_dates")


@query(f"""WITH t AS ({_DIRTY_SQL}) SELECT 'flag' AS "column", STRING_AGG(DISTINCT LOWER(flag), ',' ORDER BY LOWER(flag)) AS tokens FROM t""")
def boolean_encodings_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.boolean_encodings(Q.stripped_counts(dirty_customer(spark, sf_dir), ["flag", "nation"]))
    return found.select("column", F.array_join("tokens", ",").alias("tokens"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def domain_violations_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.domain_violations(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"]).select("c_custkey", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48""")
def range_violations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.range_violations(table(spark, sf_dir, "lineitem"), "l_quantity", 3, 48).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0""")
def non_negative_violations_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.range_violations(table(spark, sf_dir, "customer"), "c_acctbal", low=0).select("c_custkey", "c_acctbal")


@query("""WITH t AS (SELECT CASE WHEN event_id % 301 = 0 THEN 'odd' || (event_id % 5) ELSE event_type END AS kind FROM events), c AS (SELECT kind, COUNT(*) AS n FROM t GROUP BY 1)
SELECT 'kind' AS "column", kind AS "value", n FROM c WHERE n / (SELECT COUNT(*) FROM t) < 0.01""")
def rare_categories_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 301 == 0, F.concat(F.lit("odd"), (F.col("event_id") % 5).cast("string"))).otherwise(F.col("event_type")).alias("kind"))
    counts = P.value_counts(events, ["kind"])
    return Q.rare_values(counts, events.count())


@query("""SELECT 'fixed' AS "column", 1::BIGINT AS n_distinct, 1.0::DOUBLE AS dominant_rate FROM orders HAVING COUNT(*) > 0
UNION ALL SELECT 'nearly', COUNT(DISTINCT x), ROUND(COUNT(*) FILTER (x = 'a') / COUNT(*), 6) FROM (SELECT CASE WHEN o_orderkey % 251 = 1 THEN 'b' ELSE 'a' END AS x FROM orders)""")
def constant_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("x").alias("fixed"), F.when(F.col("o_orderkey") % 251 == 1, "b").otherwise("a").alias("nearly"), "o_orderpriority")
    found = P.cardinality(P.value_counts(orders, ["fixed", "nearly", "o_orderpriority"]))
    return rounded(found.where(f"n_distinct = 1 or dominant_rate >= {Q.NEAR_CONSTANT}").select("column", "n_distinct", "dominant_rate"), "dominant_rate", digits=6)


@query("""SELECT 'l_partkey' AS "left", 'part_copy' AS "right" FROM lineitem HAVING COUNT(*) FILTER (l_partkey IS DISTINCT FROM l_partkey) = 0""")
def identical_columns_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.identical_columns(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_partkey").alias("part_copy"), (F.col("l_suppkey") + 1).alias("moved")))


@query("""SELECT BOOL_AND(c_custkey = rn) AS "sequential" FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 + (SELECT MIN(c_custkey) FROM customer) AS rn FROM customer)""")
def sequential_index_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.operators.replay import with_positions

    keys = table(spark, sf_dir, "customer").select("c_custkey")
    start = keys.agg(F.min("c_custkey").alias("m"))
    placed = with_positions(keys, "c_custkey").crossJoin(F.broadcast(start)).select((F.col("c_custkey") - F.col("m")).alias("index"), F.col("_pos").alias("row_id"))  # start is one row
    return Q.sequential(placed, "index", "row_id")


@query("""WITH c AS (SELECT quality, COUNT(*) AS n FROM labels GROUP BY 1) SELECT COUNT(*) AS n_distinct, MAX(n) AS majority, ROUND(MAX(n) / SUM(n), 6) AS majority_rate FROM c""")
def target_balance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cardinality(P.value_counts(table(spark, sf_dir, "labels"), ["quality"]))
    return found.select("n_distinct", F.col("top_count").alias("majority"), F.round("dominant_rate", 6).alias("majority_rate"))


@query("""WITH t AS (SELECT text FROM documents), g AS (SELECT text, COUNT(*) AS n FROM t GROUP BY 1)
SELECT SUM(n)::BIGINT AS "rows", SUM(n - 1)::BIGINT AS duplicate_rows, COUNT(*) FILTER (n > 1) AS duplicate_groups, ROUND(SUM(n - 1) / SUM(n), 6) AS duplicate_rate FROM g""")
def duplicate_rows_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.duplicate_summary(table(spark, sf_dir, "documents"), ["text"]), "duplicate_rate", digits=6)


@query("""WITH g AS (SELECT text, COUNT(*) AS "size", MIN(doc_id) AS first_row, LIST(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING COUNT(*) > 1)
SELECT first_row, "size", ARRAY_TO_STRING(ids[1:10], ',') AS row_ids FROM g ORDER BY first_row LIMIT 20""")
def duplicate_groups_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return found.select("first_row", "size", F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("row_ids"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def keep_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_first(table(spark, sf_dir, "documents"), "doc_id", ["text"]).select("doc_id", "lang")


@query("""WITH t AS (SELECT CASE WHEN event_id % 401 = 0 THEN 'inf' WHEN event_id % 307 = 0 THEN '-inf' ELSE CAST(value AS VARCHAR) END::DOUBLE AS x FROM events) SELECT COUNT(*) FILTER (ISINF(x)) AS n FROM t""")
def non_finite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.when(key % 401 == 0, float("inf")).when(key % 307 == 0, float("-inf")).otherwise(F.col("value")).alias("x"))
    return x.where(F.col("x").isNotNull() & ~F.isnan("x") & V.finite(F.col("x")).isNull()).agg(F.count("*").alias("n"))


def _shown(found: DataFrame) -> DataFrame:
    return rounded(found.drop("evidence"), "detected_rate", digits=6)


@query(audit_sql(_DIRTY_SQL, ["c_custkey"], ["segment", "nation", "flag"], {"segment": ["BUILDING", "MACHINERY"]}))
def audit_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over a dirty customer table."""
    return _shown(Q.audit(dirty_customer(spark, sf_dir), {"segment": {"allowed_values": ["BUILDING", "MACHINERY"]}}))


@query(audit_sql(f"SELECT segment, nation, flag FROM ({_DIRTY_SQL})", [], ["segment", "nation", "flag"]))
def audit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over texts alone, many rows of which are equal."""
    return _shown(Q.audit(dirty_customer(spark, sf_dir).drop("c_custkey")))


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(audit_sql("SELECT * FROM lineitem", _LINES, ["l_returnflag", "l_linestatus", "l_shipdate"], bounds={"l_quantity": (2, 49), "l_tax": (0, None)}))
def audit_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(Q.audit(table(spark, sf_dir, "lineitem"), {"l_quantity": {"min": 2, "max": 49}, "l_tax": {"non_negative": True}}))


#: A table in which most rules find something: missing and odd values, copies, an index, a target.
_ODD_SQL = """SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS cust, NULL::DOUBLE AS nothing, 'x' AS fixed, CASE WHEN o_orderkey % 499 = 1 THEN 'b' ELSE 'a' END AS nearly, o_orderkey AS "index", CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS target,
CASE WHEN o_orderkey % 7 = 0 THEN '12x' ELSE CAST(o_custkey AS VARCHAR) END AS amount_text, CASE WHEN o_orderkey % 2 = 0 THEN 'abc' ELSE CAST(o_custkey AS VARCHAR) END AS mixed, CASE WHEN o_orderkey % 9 = 0 THEN '2020-13-45' ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS day,
'K' || o_orderkey AS ticket, CASE WHEN o_orderkey % 151 = 0 THEN 'odd' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN REPEAT('z', 10001) ELSE 'short' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'K' ELSE '' END || o_orderkey AS code,
CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice WHEN o_orderkey % 97 = 1 THEN o_totalprice * 1000 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 211 = 1 THEN 9 ELSE o_orderkey % 5 + 1 END AS grade, o_totalprice AS twin, o_totalprice AS copy FROM orders"""


@query(audit_sql(_ODD_SQL, ["cust", "nothing", '"index"', "target", "price", "grade", "twin", "copy"], ["fixed", "nearly", "amount_text", "mixed", "day", "ticket", "status", "note", "code"]).replace("'\"index\"", "'index").replace("index\"'", "index'").replace('"index" /', "index /").replace('/ "index"', "/ index"))
def audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over a table of orders that has much amiss."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.col("o_custkey").cast("string")
    odd = table(spark, sf_dir, "orders").select(
        F.when(key % 4 != 0, F.col("o_custkey")).alias("cust"),
        F.lit(None).cast("double").alias("nothing"),
        key.alias("index"),
        F.when(key % 20 == 0, 1).otherwise(0).alias("target"),
        F.when(key % 11 == 0, -price).when(key % 97 == 1, price * 1000).otherwise(price).alias("price"),
        F.when(key % 211 == 1, 9).otherwise(key % 5 + 1).alias("grade"),
        price.alias("twin"),
        price.alias("copy"),
        F.lit("x").alias("fixed"),
        F.when(key % 499 == 1, "b").otherwise("a").alias("nearly"),
        F.when(key % 7 == 0, "12x").otherwise(text).alias("amount_text"),
        F.when(key % 2 == 0, "abc").otherwise(text).alias("mixed"),
        F.when(key % 9 == 0, "2020-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.concat(F.lit("K"), key.cast("string")).alias("ticket"),
        F.when(key % 151 == 0, "odd").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 3 == 0, F.repeat(F.lit("z"), 10001)).otherwise("short").alias("note"),
        F.concat(F.when(key % 3 == 0, "K").otherwise(""), key.cast("string")).alias("code"),
    )
    return _shown(Q.audit(odd))


#: Events whose values are of several types, as texts, beside those of one type.
_VARIANT_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'text ' || (event_id % 4) WHEN 1 THEN 'true' WHEN 2 THEN '[1]' WHEN 3 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS anything, CAST(user_id AS VARCHAR) AS whole,
CASE event_id % 6 WHEN 0 THEN 'str' WHEN 1 THEN 'bool' WHEN 2 THEN 'list' ELSE 'int' END AS kind FROM events"""


@query(audit_sql(_VARIANT_SQL, ["event_id"], ["anything", "whole"], mixed={"anything": "kind"}))
def audit_variants_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over a table with columns of any type, as JSON gives them."""
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    anything = F.when(key % 6 == 0, F.concat(F.lit('"text '), (key % 4).cast("string"), F.lit('"'))).when(key % 6 == 1, "true").when(key % 6 == 2, "[1]").when(key % 6 == 3, F.when(key % 4 == 1, "null")).otherwise(user)
    return _shown(Q.audit(table(spark, sf_dir, "events").select("event_id", F.parse_json(anything).alias("anything"), F.parse_json(user).alias("whole"))))


@query("""WITH t AS (SELECT CASE p_partkey % 8 WHEN 0 THEN 'Straße ' WHEN 1 THEN 'STRASSE ' WHEN 2 THEN 'strasse ' WHEN 3 THEN 'ΟΔΟΣ ' WHEN 4 THEN 'οδος ' WHEN 5 THEN 'ﬁn ' WHEN 6 THEN 'Fin ' ELSE 'ısı ' END || p_brand AS x, CASE p_partkey % 8 WHEN 0 THEN 'strasse ' WHEN 1 THEN 'strasse ' WHEN 2 THEN 'strasse ' WHEN 3 THEN 'οδοσ ' WHEN 4 THEN 'οδοσ ' WHEN 5 THEN 'fin ' WHEN 6 THEN 'fin ' ELSE 'ısı ' END || LOWER(p_brand) AS folded FROM part)
SELECT 'name' AS "column", folded, COUNT(DISTINCT x) AS spellings FROM t GROUP BY folded HAVING COUNT(DISTINCT x) > 1""")
def folded_variants_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that only full case folding takes for one."""
    words = F.element_at(F.array(*map(F.lit, ("Straße ", "STRASSE ", "strasse ", "ΟΔΟΣ ", "οδος ", "ﬁn ", "Fin ", "ısı "))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return Q.case_variants(Q.stripped_counts(table(spark, sf_dir, "part").select(F.concat(words, "p_brand").alias("name")), ["name"]))


@query(f"""WITH t AS (SELECT 'nation' AS "column", nation AS x FROM ({_DIRTY_SQL}) UNION ALL SELECT 'flag', flag FROM ({_DIRTY_SQL}) UNION ALL SELECT 'segment', REGEXP_REPLACE(segment, '^\\s+|\\s+$', '', 'g') FROM ({_DIRTY_SQL}))
SELECT "column", STRING_AGG(DISTINCT kind, ',' ORDER BY kind) AS kinds, COUNT(*) AS n FROM (SELECT "column", CASE WHEN REGEXP_FULL_MATCH(x, '[+-]?\\d+') THEN 'whole number' ELSE 'text' END AS kind FROM t WHERE x <> '') GROUP BY 1""")
def representations_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.representations(dirty_customer(spark, sf_dir), ["nation", "flag", "segment"])


@query("""SELECT doc_id, CASE WHEN LENGTH(text) > 160 THEN SUBSTR(text, 1, 157) || '…' ELSE text END AS shown FROM documents""")
def sample_texts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.sample_text(F.col("text")).alias("shown"))
