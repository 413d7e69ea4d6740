"""CSV files of which some, or some of their rows, can't be read: what is good, and what is refused and why."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.scratch import written
from quarryline.sources.texts import decodable, first_look

#: Reasons for which a whole file is refused.
UNDECODABLE, OTHER_HEADER = "undecodable", "other_header"
#: Reasons for which a row is refused.
TOO_MANY, TOO_FEW, MALFORMED = "too_many_fields", "too_few_fields", "malformed"


def fields_in(line: Column) -> Column:
    """How many fields a CSV line has; commas inside quotes separate none."""
    return F.regexp_count(F.regexp_replace(line, '"(?:[^"]|"")*"', "q"), F.lit(",")) + 1


def scan_with_refusals(spark: SparkSession, path: str, short_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of the CSV files below a folder, from one scan of their fields.

    ``rows`` has the columns of the header, as texts, and ``file``; ``refused`` is (file, reason, line),
    ``line`` null where the whole file is refused.  The header is that of the first file by name;
    files with another one, and files that aren't UTF-8, whether GB18030 (told as ``gb18030``, which
    :func:`~quarryline.sources.texts.in_utf8` can decode) or neither, are refused.  A row with more
    fields than the header has is refused; one with fewer is filled up with nulls, unless
    ``short_rows`` refuses it.  Spark's file source leaves empty files out.
    """
    looked = written(first_look(spark, path), "looked")
    kept = looked.where("utf8").agg(F.min_by("header", "file").alias("header"), F.coalesce(F.bool_or("quoted_lines"), F.lit(False)).alias("quoted")).first()
    encodings = decodable(spark, path).withColumnRenamed("path", "file") if not looked.where("not utf8").isEmpty() else None
    bad = looked.where("not utf8").join(encodings, "file").select("file", F.coalesce("encoding", F.lit(UNDECODABLE)).alias("reason")) if encodings else spark.createDataFrame([], "file string, reason string")
    bad = bad.unionByName(looked.where("utf8").where(F.col("header") != (kept["header"] or "")).select("file", F.lit(OTHER_HEADER).alias("reason")))
    bad = written(bad, "refused-files")
    names = next(csv.reader([kept["header"] or ""]), [])
    raw, file = "_raw", "_metadata.file_path"
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + f", {raw} string"
    text = spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="", multiLine=bool(kept["quoted"]), escape='"', recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord=raw)
    # all columns are written, as fields are only counted where all of them are asked for
    read = written(text.select("*", F.col(file).alias("file")), "rows").join(bad.select("file"), "file", "left_anti")
    n = fields_in(F.col(raw))
    reason = F.when(n > len(names), TOO_MANY).when(n < len(names), TOO_FEW).otherwise(MALFORMED)
    broken = F.col(raw).isNotNull() if short_rows else F.col(raw).isNotNull() & (n >= len(names))
    refused = read.where(broken).select("file", reason.alias("reason"), F.col(raw).alias("line")).unionByName(bad.withColumn("line", F.lit(None).cast("string")))
    return read.where(~broken).drop(raw), refused
