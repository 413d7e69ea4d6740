"""Comparison of the columns of related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(file, position, column, dtype, name): the columns of each table; ``name`` is the spelling
    that columns are matched by."""
    rows = [(file, i, c, t, c.strip().casefold()) for file, df in tables.items() for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "file string, position int, column string, dtype string, name string")


def compare_schemas(schemas: DataFrame, reference: str) -> DataFrame:
    """(file, rule_id, column, detail) of every other file against the reference file: missing and
    extra columns, the same name spelt differently, and different types."""
    ref = schemas.where(F.col("file") == reference).select(F.col("column").alias("ref_column"), F.col("dtype").alias("ref_dtype"), F.col("name").alias("ref_name"))
    other = schemas.where(F.col("file") != reference)
    files = other.select("file").distinct()
    missing = (
        files.crossJoin(F.broadcast(ref))  # columns of one schema by files
        .join(other.select("file", F.col("column").alias("ref_column")), ["file", "ref_column"], "left_anti")
        .select("file", F.lit("DQ_SCHEMA_DIFFERENCE").alias("rule_id"), F.col("ref_column").alias("column"), F.lit("missing").alias("detail"))
    )
    extra = other.join(ref, F.col("column") == F.col("ref_column"), "left_anti").select("file", F.lit("DQ_SCHEMA_DIFFERENCE").alias("rule_id"), "column", F.lit("extra").alias("detail"))
    same = other.join(ref, F.col("name") == F.col("ref_name"))
    spelt = same.where("column <> ref_column").select("file", F.lit("DQ_COLUMN_NAME_FORMAT").alias("rule_id"), "column", F.col("ref_column").alias("detail"))
    typed = same.where("dtype <> ref_dtype").select("file", F.lit("DQ_CROSS_FILE_DTYPE").alias("rule_id"), "column", F.concat_ws(" / ", "ref_dtype", "dtype").alias("detail"))
    return missing.unionByName(extra).unionByName(spelt).unionByName(typed)


def compare_encodings(tokens: DataFrame, reference: str) -> DataFrame:
    """(file, rule_id, column, detail) of boolean columns that one file codes with 0 and 1 and
    the reference file without, or the other way round.  ``tokens`` has (file, column, tokens array)."""
    digits = F.array(F.lit("0"), F.lit("1"))
    coded = tokens.select("file", "column", F.lower(F.trim("column")).alias("name"), F.arrays_overlap("tokens", digits).alias("numeric"), F.array_join(F.array_sort("tokens"), ",").alias("shown"))
    ref = coded.where(F.col("file") == reference).select("name", F.col("numeric").alias("ref_numeric"), F.col("shown").alias("ref_shown"))
    met = coded.where(F.col("file") != reference).join(ref, "name").where("numeric <> ref_numeric")
    return met.select("file", F.lit("DQ_CROSS_FILE_CATEGORY_ENCODING").alias("rule_id"), "column", F.concat_ws(" / ", "ref_shown", "shown").alias("detail"))
