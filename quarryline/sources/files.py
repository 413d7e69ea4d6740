"""Folders of files as tables: what can be taken in, what is refused and why, notebooks as cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one file and of a project.
FILE_BYTES, PROJECT_FILES, PROJECT_BYTES = 25 << 20, 100, 100 << 20
#: Endings that are read, and what each is read as.
KINDS = {".py": "code", ".ipynb": "notebook", ".csv": "data", ".md": "document"}
#: Names of files, without an ending of these, that are read.
BUILD_NAMES = ("makefile",)
#: Folders that are never read.
PRIVATE = (".git", ".venv", "venv", "__pycache__", "node_modules", "__macosx")


def suffix(path: Column) -> Column:
    """The lower-cased ending with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_safe(path: Column) -> Column:
    """Relative, without empty, dot or drive parts, control characters, or spaces and dots at an
    end of a part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = p.rlike(r"(?i)^/|^$|//|/$|(^|/)\.{1,2}(/|$)|:|[\x00-\x1f]|[ .](/|$)|(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)")
    return F.coalesce(~bad, F.lit(False))


def is_private(path: Column) -> Column:
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.exists(parts, lambda p: p.isin(*PRIVATE) | p.startswith(".env"))


def composed(path: Column) -> Column:
    """The path with plain slashes and composed characters (Unicode NFC); ASCII needs no change."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(nfc(plain))


def kind_of(path: Column) -> Column:
    """What a file is read as, null where it isn't."""
    ending, name = suffix(path), F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    return F.coalesce(*(F.when(ending == e, k) for e, k in KINDS.items()), F.when(name.isin(*BUILD_NAMES), "build"))


def inspect_files(files: DataFrame) -> DataFrame:
    """``files`` (path, length, content optional) with ``kind`` and ``refused``, the first reason
    not to read a file: unsafe_path, private, unsupported, empty, too_large, binary, name_conflict.
    Names are composed first; one file of names that differ in case only is read, the first in order."""
    files = files.withColumn("path", composed(F.col("path")))
    folded = files.groupBy(F.lower("path").alias("_folded")).agg(F.min("path").alias("_first"))
    binary = F.contains("content", F.lit(b"\x00")) if "content" in files.columns else F.lit(False)
    reason = (
        F.when(~is_safe(F.col("path")), "unsafe_path")
        .when(is_private(F.col("path")), "private")
        .when(F.col("kind").isNull(), "unsupported")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > FILE_BYTES, "too_large")
        .when(binary, "binary")
        .when(F.col("path") != F.col("_first"), "name_conflict")
    )
    joined = files.join(folded, F.lower("path") == F.col("_folded")).withColumn("kind", kind_of(F.col("path")))
    return joined.withColumn("refused", reason).drop("_folded", "_first")


def within_budget(inspected: DataFrame) -> DataFrame:
    """One row (files, bytes, accepted): is what would be read within the limits of a project?"""
    table = inspected.where("refused is null").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return table.withColumn("accepted", (F.col("files") <= PROJECT_FILES) & (F.col("bytes") <= PROJECT_BYTES))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, inspected; ``path`` is relative to it.  Spark's file source leaves
    empty files out."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", root.removeprefix("file://"), -1)
    return inspect_files(files.select(name.alias("path"), "length", "content"))


def ending_counts(files: DataFrame) -> DataFrame:
    """(ending, n); files without an ending are counted under [no extension]."""
    ending = suffix(F.col("path"))
    return files.select(F.when(ending == "", "[no extension]").otherwise(ending).alias("ending")).groupBy("ending").agg(F.count("*").alias("n"))


def notebook_cells(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(notebook, cell, execution_count, source) of the code cells of JSON notebooks, one a file
    or, with ``lines``, one a line; ``cell`` is 0-based among all cells of the notebook."""
    schema = "cells array<struct<cell_type:string,execution_count:bigint,source:string>>"
    books = spark.read.schema(schema).json(path, multiLine=not lines).select(F.col("_metadata.file_name").alias("notebook"), F.posexplode("cells").alias("cell", "c"))
    text = F.col("c.source")
    joined = F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), "")).otherwise(text)
    return books.where("c.cell_type = 'code'").select("notebook", F.col("cell").cast("long").alias("cell"), F.col("c.execution_count").alias("execution_count"), joined.alias("source"))
