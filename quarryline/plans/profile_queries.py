"""Profiles: scalars, distributions, quantiles, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import outliers as O
from quarryline.operators import profile as P
from quarryline.plans.registry import query, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _profile_sql(table_name: str, columns: list[str], where: str = "true") -> str:
    one = """SELECT '{c}' AS "column", COUNT(x) AS "count", COUNT(*) - COUNT(x) AS missing, ROUND(AVG(x), 4) AS mean, ROUND(STDDEV_SAMP(x), 4) AS std,
 ROUND(MIN(x), 4) + 0.0 AS "min", ROUND(QUANTILE_CONT(x, 0.25), 4) AS q1, ROUND(QUANTILE_CONT(x, 0.5), 4) AS median, ROUND(QUANTILE_CONT(x, 0.75), 4) AS q3,
 ROUND(MAX(x), 4) AS "max", ROUND(SKEWNESS(x), 4) + 0.0 AS skewness, COUNT(DISTINCT x) AS n_distinct
 FROM (SELECT CAST({c} AS DOUBLE) + 0.0 AS x FROM {t} WHERE {w})"""
    return " UNION ALL ".join(one.format(c=c, t=table_name, w=where) for c in columns)


def _profile(df: DataFrame, columns: list[str]) -> DataFrame:
    distinct = P.cardinality(P.value_counts(df.select(*((F.col(c).cast("double") + 0.0).alias(c) for c in columns)), columns)).select("column", "n_distinct")
    return rounded(P.numeric_profile(df, columns).join(distinct, "column"), "mean", "std", "min", "q1", "median", "q3", "max", "skewness")


@query(_profile_sql("lineitem", MEASURES))
def numeric_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "lineitem"), MEASURES)


@query(_profile_sql("customer", ["c_acctbal", "c_nationkey"]))
def numeric_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@query(_profile_sql("events", ["value"]))
def numeric_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "events"), ["value"])


@query("""SELECT 'l_quantity' AS "column", COUNT(*) AS "rows", COUNT(*) - COUNT(q) AS nulls, ROUND(1 - COUNT(q) / COUNT(*), 6) AS null_rate FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem)
UNION ALL SELECT 'l_tax', COUNT(*), COUNT(*) - COUNT(q), ROUND(1 - COUNT(q) / COUNT(*), 6) FROM (SELECT CASE WHEN l_orderkey % 10 > 0 THEN l_tax END AS q FROM lineitem)
UNION ALL SELECT 'l_returnflag', COUNT(*), COUNT(*) - COUNT(l_returnflag), ROUND(1 - COUNT(l_returnflag) / COUNT(*), 6) FROM lineitem""")
def null_profile_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_orderkey") % 10 > 0, F.col("l_tax")).alias("l_tax"), "l_returnflag"
    )
    return rounded(P.null_profile(dirty), "null_rate", digits=6)


CATEGORIES = ["o_orderstatus", "o_orderpriority"]
_COUNTS = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS "value", COUNT(*) AS n FROM orders GROUP BY {c}""" for c in CATEGORIES)


@query(_COUNTS)
def value_counts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(table(spark, sf_dir, "orders"), CATEGORIES)


@query(f"""SELECT "column", SUM(n)::BIGINT AS non_null, COUNT(*) AS n_distinct, MAX(n) AS top_count, ROUND(COUNT(*) / SUM(n), 6) AS unique_ratio, ROUND(MAX(n) / SUM(n), 6) AS dominant_rate FROM ({_COUNTS}) GROUP BY 1""")
def categorical_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.cardinality(P.value_counts(table(spark, sf_dir, "orders"), CATEGORIES)), "unique_ratio", "dominant_rate", digits=6)


@query("""SELECT p_type AS "value", COUNT(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def top10_part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(table(spark, sf_dir, "part"), ["p_type"]).orderBy(F.desc("n"), "value").limit(10).select("value", "n")


@query("""SELECT 'c_custkey' AS "column", COUNT(DISTINCT c_custkey) AS n_distinct, ROUND(COUNT(DISTINCT c_custkey) / COUNT(c_custkey), 6) AS unique_ratio FROM customer
UNION ALL SELECT 'c_name', COUNT(DISTINCT c_name), ROUND(COUNT(DISTINCT c_name) / COUNT(c_name), 6) FROM customer UNION ALL SELECT 'c_mktsegment', COUNT(DISTINCT c_mktsegment), ROUND(COUNT(DISTINCT c_mktsegment) / COUNT(c_mktsegment), 6) FROM customer""")
def cardinality_ratio_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cardinality(P.value_counts(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"]))
    return rounded(found.select("column", "n_distinct", "unique_ratio"), "unique_ratio", digits=6)


@query("""SELECT 'o_totalprice' AS "column", ROUND(q1, 4) AS q1, ROUND(q3, 4) AS q3, ROUND(q1 - 1.5 * (q3 - q1), 4) AS "low", ROUND(q3 + 1.5 * (q3 - q1), 4) AS high
FROM (SELECT QUANTILE_CONT(o_totalprice::DOUBLE, 0.25) AS q1, QUANTILE_CONT(o_totalprice::DOUBLE, 0.75) AS q3 FROM orders)""")
def iqr_fences_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    q1, q3 = P.exact_quantiles(orders, ["o_totalprice"], [0.25, 0.75])["o_totalprice"]
    found = O.fences(orders, "o_totalprice")
    return rounded(spark.createDataFrame([("o_totalprice", q1, q3, found["low"], found["high"])], "column string, q1 double, q3 double, low double, high double"), "q1", "q3", "low", "high")


_SPIKED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price FROM lineitem"


@query(f"""WITH t AS ({_SPIKED}), f AS (SELECT QUANTILE_CONT(price::DOUBLE, 0.25) AS q1, QUANTILE_CONT(price::DOUBLE, 0.75) AS q3 FROM t)
SELECT l_orderkey, l_linenumber, ROUND(price, 2) AS price FROM t, f WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    spiked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("price"))
    return rounded(O.outliers(spiked, "price"), "price", digits=2)


@query(f"""WITH t AS ({_SPIKED}), q AS (SELECT MEDIAN(price::DOUBLE) AS m FROM t), a AS (SELECT MEDIAN(ABS(price::DOUBLE - m)) AS mad FROM t, q)
SELECT l_orderkey, l_linenumber, ROUND(price, 2) AS price FROM t, q, a WHERE mad > 0 AND 0.6745 * ABS(price - m) / mad > 3.5""")
def mad_outliers_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    spiked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("price"))
    return rounded(O.outliers(spiked, "price", robust=True), "price", digits=2)


@query("""WITH t AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_discount::DOUBLE AS c, 2 * l_quantity::DOUBLE + 1 AS d FROM lineitem)
SELECT 'quantity' AS feature_a, 'price' AS feature_b, ROUND(CORR(a, b), 4) + 0.0 AS r FROM t UNION ALL SELECT 'quantity', 'discount', ROUND(CORR(a, c), 4) + 0.0 FROM t UNION ALL SELECT 'quantity', 'double', ROUND(CORR(a, d), 4) FROM t
UNION ALL SELECT 'price', 'discount', ROUND(CORR(b, c), 4) + 0.0 FROM t UNION ALL SELECT 'price', 'double', ROUND(CORR(b, d), 4) + 0.0 FROM t UNION ALL SELECT 'discount', 'double', ROUND(CORR(c, d), 4) + 0.0 FROM t""")
def corr_matrix_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (2 * F.col("l_quantity") + 1).alias("double"))
    return rounded(P.correlations(t), "r")


@query("""WITH t AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, 3 * l_extendedprice::DOUBLE - 7 AS c FROM lineitem)
SELECT * FROM (SELECT 'quantity' AS feature_a, 'price' AS feature_b, ROUND(CORR(a, b), 4) AS r FROM t UNION ALL SELECT 'quantity', 'tripled', ROUND(CORR(a, c), 4) FROM t UNION ALL SELECT 'price', 'tripled', ROUND(CORR(b, c), 4) FROM t) WHERE ABS(r) >= 0.95""")
def high_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (3 * F.col("l_extendedprice") - 7).alias("tripled"))
    return rounded(P.correlations(t).where(F.abs("r") >= 0.95), "r")


@query("""WITH t AS (SELECT CASE WHEN l_orderkey % 211 = 0 THEN 9 ELSE LEAST(l_linenumber, 7) END::DOUBLE AS x FROM lineitem), c AS (SELECT x AS "value", COUNT(*) AS n FROM t GROUP BY 1),
s AS (SELECT SUM(n) AS total, GREATEST(3, CEIL(SUM(n) * 0.01)) AS support FROM c), d AS (SELECT c."value", n, c."value" - LAG(c."value") OVER (ORDER BY c."value") AS step FROM c, s WHERE n >= support),
g AS (SELECT MIN(d."value") AS low, MAX(d."value") AS high, COUNT(*) AS many, BOOL_AND(step IS NULL OR step = 1) AS gapless, SUM(n) AS covered FROM d)
SELECT c."value", c.n FROM c, s, g WHERE total >= 50 AND n < support AND many >= 2 AND gapless AND covered / total >= 0.95 AND (c."value" < low OR c."value" > high)""")
def integer_domain_linenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 211 == 0, 9).otherwise(F.least(F.col("l_linenumber"), F.lit(7))).alias("x"))
    return O.integer_domain(t, "x")


@query("""SELECT "column", kind FROM (VALUES ('l_quantity', CASE WHEN (SELECT COUNT(DISTINCT l_quantity) <= 20 AND COUNT(DISTINCT l_quantity) / COUNT(*) <= 0.10 FROM lineitem) THEN 'count-like' WHEN (SELECT COUNT(DISTINCT l_quantity) <= 10 AND COUNT(DISTINCT l_quantity) / COUNT(*) <= 0.05 FROM lineitem) THEN 'low-cardinality numeric categorical' ELSE 'continuous numeric' END),
('l_linenumber', 'count-like'), ('l_extendedprice', 'continuous numeric'), ('l_tax', CASE WHEN (SELECT COUNT(DISTINCT l_tax) <= 10 AND COUNT(DISTINCT l_tax) / COUNT(*) <= 0.05 FROM lineitem) THEN 'low-cardinality numeric categorical' ELSE 'continuous numeric' END)) AS v("column", kind)""")
def numeric_classes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_linenumber", "l_extendedprice", "l_tax"]
    return P.numeric_classes(table(spark, sf_dir, "lineitem"), columns).select("column", "kind")


@query("""SELECT ROUND(QUANTILE_CONT(l_extendedprice::DOUBLE, 0.05), 4) AS p05, ROUND(QUANTILE_CONT(l_extendedprice::DOUBLE, 0.5), 4) AS p50, ROUND(QUANTILE_CONT(l_extendedprice::DOUBLE, 0.95), 4) AS p95 FROM lineitem""")
def bracketed_quantiles_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-pass quantiles of large tables, forced here by stating a large row count."""
    found = P.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], [0.05, 0.5, 0.95], rows=P.DIRECT_ROWS + 1)
    return rounded(spark.createDataFrame([tuple(found["l_extendedprice"])], "p05 double, p50 double, p95 double"), "p05", "p50", "p95")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type AS "key", COUNT(*) AS "rows", COUNT(*) - COUNT(value) AS nulls, ROUND(AVG(value), 4) + 0.0 AS mean FROM events GROUP BY 1, 2""")
def windowed_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.streaming.windows import windowed_profile

    return rounded(windowed_profile(table(spark, sf_dir, "events"), "ts", "event_type", "value"), "mean")
