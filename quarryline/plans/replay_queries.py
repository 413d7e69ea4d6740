"""Replayed dataframe steps, row loss, CSV scans, notebook-like execution order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import replay as R
from quarryline.operators.review import execution_gaps
from quarryline.plans.profile_queries import rounded
from quarryline.plans.registry import query, table
from quarryline.sources.csv_table import preview, read_header, scan_csv
from quarryline.sources.files import scan_folder, within_budget
from quarryline.sources.texts import text_files
from quarryline.sources.scratch import scratch_path


def _keyed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table with ``row_id``: its positions in the order of the key, from 0."""
    return R.with_positions(table(spark, sf_dir, name), key).withColumnRenamed("_pos", R.ROW)


def _dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn(R.ROW, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return lines.select(R.ROW, "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("l_tax"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem WHERE l_linenumber = 3 OR l_orderkey % 7 = 0""")
def removed_rows_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _dirty_lineitem(spark, sf_dir)
    frames = R.replay([{"operation": "load", "path": "raw", "output": "raw"}, {"operation": "dropna", "input": "raw", "output": "clean"}], {"raw": raw}, ["clean"])
    return R.removed_rows(raw, frames["clean"].data).select(R.ROW)


@query("""SELECT COUNT(*) AS "before", COUNT(*) FILTER (NOT gone) AS "after", COUNT(*) FILTER (gone) AS removed, ROUND(COUNT(*) FILTER (gone) / COUNT(*), 6) AS removed_rate FROM (SELECT l_linenumber = 3 OR l_orderkey % 7 = 0 AS gone FROM lineitem)""")
def dropna_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _dirty_lineitem(spark, sf_dir)
    return rounded(R.row_loss(raw, R.drop_null_rows(R.load(raw)).data), "removed_rate", digits=6)


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, TRUNC(p_retailprice)::BIGINT AS p_retailprice, 7 AS batch FROM part""")
def replay_select_drop_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        {"operation": "load", "path": "part.csv", "output": "raw"},
        {"operation": "column_selection", "input": "raw", "output": "a", "columns": ["p_partkey", "p_name", "p_size", "p_retailprice"]},
        {"operation": "observe", "input": "a", "output": "seen"},
        {"operation": "drop_columns", "input": "a", "output": "b", "columns": ["p_name"]},
        {"operation": "unsupported", "input": "b", "output": "lost"},
        {"operation": "astype", "input": "b", "output": "c", "dtype": {"p_size": "str", "p_retailprice": "int64"}},
        {"operation": "set_column", "input": "c", "output": "d", "column": "batch", "value": 7},
    ]
    return R.replay(steps, {"part.csv": _keyed(spark, sf_dir, "part", "p_partkey")}, ["d"])["d"].data.drop(R.ROW)


@query("""SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_partkey % 6 > 0 THEN TRY_CAST(p_name AS BIGINT) ELSE p_partkey END AS p_name FROM part""")
def replay_astype_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single columns in another type; texts that spell no number become null."""
    part = _keyed(spark, sf_dir, "part", "p_partkey").select(R.ROW, "p_partkey", "p_size", F.when(F.col("p_partkey") % 6 > 0, F.col("p_name")).otherwise(F.col("p_partkey").cast("string")).alias("p_name"))
    steps = [
        {"operation": "load", "path": "part.csv", "output": "raw"},
        {"operation": "astype_column", "input": "raw", "output": "a", "column": "p_size", "dtype": "float64"},
        {"operation": "astype_column", "input": "a", "output": "b", "column": "p_name", "dtype": "int64"},
    ]
    return R.replay(steps, {"part.csv": part}, ["b"])["b"].data.drop(R.ROW)


_POS = "SELECT *, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer"


@query(f"""SELECT c_custkey, c_name FROM ({_POS}) WHERE pos >= 10 AND pos < 110 AND (pos - 10) % 3 = 0""")
def replay_row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slice_rows(R.load(_keyed(spark, sf_dir, "customer", "c_custkey")), 10, 110, 3).data.select("c_custkey", "c_name")


@query(f"""SELECT c_custkey, c_name FROM ({_POS}) WHERE pos BETWEEN 5 AND 19""")
def replay_iloc_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        {"operation": "load", "path": "c", "output": "raw"},
        {"operation": "loc_selection", "input": "raw", "output": "a", "rows": slice(5, 30)},
        {"operation": "iloc_selection", "input": "a", "output": "b", "rows": slice(0, 15)},
        {"operation": "column_selection", "input": "b", "output": "c", "columns": ["c_custkey", "c_name"]},
    ]
    return R.replay(steps, {"c": _keyed(spark, sf_dir, "customer", "c_custkey")}, ["c"])["c"].data.drop(R.ROW)


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "status_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "status_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "status_P" FROM orders""")
def replay_get_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(R.ROW), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return R.one_hot(R.load(orders), ["status"]).data.drop(R.ROW)


@query("""SELECT p_partkey, ROUND((p_retailprice - (SELECT AVG(p_retailprice) FROM part)) / (SELECT STDDEV_POP(p_retailprice) FROM part), 6) + 0.0 AS p_retailprice FROM part""")
def replay_standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(R.ROW), "p_partkey", "p_retailprice")
    return rounded(R.standard_scale(R.load(part), ["p_retailprice"]).data.drop(R.ROW), "p_retailprice", digits=6)


@query("""SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def replay_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(R.ROW), "doc_id", "lang", "source")
    return R.drop_duplicate_rows(R.load(docs), ["lang", "source"]).data.select("doc_id")


@query(f"""SELECT c_custkey, pos >= (SELECT COUNT(*) FROM customer) - 30 AS test FROM ({_POS})""")
def replay_slice_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.load(_keyed(spark, sf_dir, "customer", "c_custkey"))
    train, test = R.slice_rows(f, None, -30), R.slice_rows(f, -30)
    return train.data.select("c_custkey", F.lit(False).alias("test")).unionByName(test.data.select("c_custkey", F.lit(True).alias("test")))


@query()
def replay_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded shuffle split; a test holds its members against NumPy's permutation."""
    steps = [
        {"operation": "load", "path": "c", "output": "raw"},
        {"operation": "dropna", "input": "raw", "output": "clean", "subset": ["c_acctbal"]},
        {"operation": "train_test_split", "input": "clean", "outputs": ["train", "test"], "test_size": 0.2, "random_state": 42},
    ]
    frames = R.replay(steps, {"c": _keyed(spark, sf_dir, "customer", "c_custkey")}, ["train", "test"])
    return frames["train"].data.select("c_custkey", F.lit("train").alias("part")).unionByName(frames["test"].data.select("c_custkey", F.lit("test").alias("part")))


@query("""SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, ROUND(c_acctbal, 4) AS c_acctbal, c_mktsegment, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer""")
def csv_scan_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table, written as CSV by Spark and scanned with inferred types and row ids."""
    path = f"{scratch_path(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").orderBy("c_custkey").write.option("header", True).csv(path)
    if read_header(spark, path) != table(spark, sf_dir, "customer").columns:
        raise ValueError("the header isn't the table's")
    return rounded(scan_csv(spark, path), "c_acctbal")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 > 0 THEN (turn * 7) % 4 END AS count FROM conversations),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, count) AS place, LAG(count) OVER (PARTITION BY conv_id ORDER BY turn, role, count) AS prev, MAX(count) OVER (PARTITION BY conv_id ORDER BY turn, role, count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t)
SELECT conv_id, COUNT(*) FILTER (count <= prev) AS non_increasing, MIN(place) FILTER (count <= prev) AS first_offender, COUNT(*) FILTER (count IS NULL AND top IS NOT NULL) AS unexecuted_after_executed FROM w GROUP BY 1""")
def execution_gaps_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notebook cells: execution counts that don't rise, and cells never executed behind
    executed ones."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 5 > 0, (F.col("turn") * 7) % 4).alias("count"))
    return execution_gaps(turns, "conv_id", ["turn", "role", F.col("count").asc_nulls_last()], "count")


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer ORDER BY customer.c_custkey LIMIT 10""")
def csv_preview_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a CSV file in GB18030, with fields that a preview shows as missing."""
    path = f"{scratch_path(spark)}/csv-{uuid.uuid4().hex}"
    segment = F.when(F.col("c_custkey") % 3 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("segment")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", segment, F.lit("表").alias("mark"))
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")  # Spark writes this one only where asked to
    try:
        customer.orderBy("c_custkey").coalesce(1).write.option("header", True).option("encoding", "GB18030").csv(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return preview(spark, path).where("mark = '表'").drop("mark")


@query("""SELECT s_nationkey AS nation, sha256(STRING_AGG(s_name, chr(10) ORDER BY s_suppkey) || chr(10)) AS text_sha256, 'utf-8-sig' AS encoding FROM supplier GROUP BY 1""")
def whole_texts_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation, read whole."""
    files = F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("int")
    return text_files(spark, _supplier_files(spark, sf_dir)).select(files.cast("long").alias("nation"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "encoding")


def _supplier_files(spark: SparkSession, sf_dir: str) -> str:
    path = f"{scratch_path(spark)}/files-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "s_name")
    lines.write.partitionBy("s_nationkey").csv(path)
    return path


@query("""SELECT COUNT(*) AS files, SUM(size)::BIGINT AS bytes, COUNT(*) <= 100 AND SUM(size) <= 104857600 AS accepted FROM (SELECT SUM(LENGTH(s_name) + 1) AS size FROM supplier GROUP BY s_nationkey)""")
def folder_budget_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_budget(scan_folder(spark, _supplier_files(spark, sf_dir)))


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'O' AS DOUBLE) AS "s-O", CAST(o_orderstatus = 'P' AS DOUBLE) AS "s-P", 0.0::DOUBLE AS "s-nan" FROM orders""")
def replay_get_dummies_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummies with all options, and steps that leave a frame as it is."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(R.ROW), "o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    steps = [
        {"operation": "load", "path": "o", "output": "raw"},
        {"operation": "assign", "input": "raw", "output": "a"},
        {"operation": "get_dummies", "input": "a", "output": "b", "columns": ["status"], "prefix": "s", "prefix_sep": "-", "drop_first": True, "dummy_na": True, "dtype": "float64", "input_columns": ["o_orderkey", "status"]},
        {"operation": "preprocess_transform", "input": "b", "output": "c", "preprocessor": "MinMaxScaler", "columns": ["o_orderkey"]},
        {"operation": "observe", "input": "c", "output": "d"},
    ]
    frame = R.replay(steps, {"o": orders}, ["c"])["c"]
    if frame.partial != {"o_orderkey"}:
        raise ValueError("the scaled column's values aren't known")
    return frame.data.drop(R.ROW)


@query("""SELECT c_nationkey, COUNT(*) AS n, ABS(COUNT(*) * 0.25 - k) < 1 AS proportional FROM customer JOIN (SELECT c_nationkey, COUNT(*) AS n, ROUND_EVEN(COUNT(*) * 0.25, 0) AS k FROM customer GROUP BY 1) USING (c_nationkey) GROUP BY c_nationkey, k""")
def replay_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split by nation: every nation's share of the test part is its share of the rows, to
    one row; a test holds the members against plain Python."""
    rows = _keyed(spark, sf_dir, "customer", "c_custkey")
    train, test = R.random_split(R.load(rows), 0.25, 7, "c_nationkey")
    both = train.data.select("c_nationkey", F.lit(0).alias("test")).unionByName(test.data.select("c_nationkey", F.lit(1).alias("test")))
    per = both.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("test").alias("k"))
    return per.select("c_nationkey", "n", (F.abs(F.col("n") * 0.25 - F.col("k")) < 1).alias("proportional"))
