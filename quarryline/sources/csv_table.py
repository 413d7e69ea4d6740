"""CSV scans: every field read as text, types inferred from all values, rows numbered."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.values import NUMBER_TEXT
from quarryline.sources.scratch import written
from quarryline.sources.texts import decodable, in_utf8  # noqa: F401

#: Fields that a preview shows as missing; a scan keeps them.
PREVIEW_MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_text_table(spark: SparkSession, path: str, quoted_lines: bool = False) -> DataFrame:
    """All columns as strings; only an empty field is null.  Quotes inside quotes are doubled.  With
    ``quoted_lines`` a quoted field may hold line ends, and a file is then read by one task."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="", emptyValue="", multiLine=quoted_lines, enforceSchema=False, escape='"', recursiveFileLookup=True)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The raw header, before duplicate names are told apart."""
    first = spark.read.csv(path, header=False, inferSchema=False, escape='"', recursiveFileLookup=True).first()
    return ["" if x is None else x for x in first] if first else []


def column_types(df: DataFrame) -> dict[str, str]:
    """The type that all values of each text column have: bigint, double, boolean or string; a
    column without values is double.  One pass over the table."""
    whole = r"^\s*[+-]?\d{1,18}\s*$"
    if not df.columns:
        return {}

    def all_match(c: str, pattern: str):  # noqa: ANN202
        return F.coalesce(F.bool_and(F.col(c).rlike(pattern)), F.lit(True))

    row = df.agg(
        *(
            m
            for i, c in enumerate(df.columns)
            for m in (F.count(c).alias(f"n{i}"), all_match(c, whole).alias(f"i{i}"), all_match(c, NUMBER_TEXT).alias(f"d{i}"), all_match(c, "^(True|False|TRUE|FALSE|true|false)$").alias(f"b{i}"))
        )
    ).first()
    return {
        c: "double" if not row[f"n{i}"] else "boolean" if row[f"b{i}"] else "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "string"
        for i, c in enumerate(df.columns)
    }


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The text columns, all or the given ones, in their inferred types; dates stay text."""
    types = column_types(df if columns is None else df.select(*columns))
    number = lambda c: F.regexp_replace(F.trim(F.col(c)), "(?i)^([+-]?)inf(inity)?$", "$1Infinity")
    kinds = {c: types.get(c) for c in df.columns}
    return df.select(*((number(c) if t in ("double", "bigint") else F.col(c)).cast(t).alias(c) if t else F.col(c) for c, t in kinds.items()))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based positions in file order of rows read from files: files by their paths, the rows of each
    as they follow one another.  Spark deals the largest pieces of files out first, and packs several
    into a task, so rows are counted for each piece, not for each task.  They are written once: another
    read may be cut into other pieces."""
    piece = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    marked = written(df.select("*", piece.alias("_piece"), F.monotonically_increasing_id().alias("_id")), "csv-rows")
    # one row a piece
    pieces = marked.groupBy("_piece").agg(F.min("_id").alias("low"), F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(pieces, key=lambda r: (unquote(r["_piece"]["file"]), r["_piece"]["start"])):
        starts.append((r["_piece"], total - r["low"]))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_piece struct<file: string, start: bigint>, _shift long")
    return marked.join(F.broadcast(first), "_piece").withColumn(name, F.col("_shift") + F.col("_id")).drop("_piece", "_id", "_shift")


def has_quoted_lines(spark: SparkSession, path: str) -> bool:
    """Does a line hold an odd number of quotes, as those do where a quoted field goes on?"""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.option("recursiveFileLookup", "true").text(path).where(quotes % 2 == 1).isEmpty()


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None, quoted_lines: bool | None = None) -> DataFrame:
    """A typed table with ``row_id``.  What isn't stated is found by a look at the files: whether they
    are in UTF-8 (``encoding`` may say so) or have to be decoded first, and whether quoted fields hold
    line ends; only then a file isn't split over tasks."""
    path = path if (encoding or "").upper() == "UTF-8" else in_utf8(spark, path)
    text = read_text_table(spark, path, has_quoted_lines(spark, path) if quoted_lines is None else quoted_lines)
    return typed(with_row_id(text), text.columns)


def preview(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows as a person would see them: NA, NaN and null read as missing too."""
    text = read_text_table(spark, in_utf8(spark, path))
    return text.limit(n).select(*(F.when(~F.col(c).isin(*PREVIEW_MISSING), F.col(c)).alias(c) for c in text.columns))
