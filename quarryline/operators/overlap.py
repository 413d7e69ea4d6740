"""Rows and entities that occur in both parts of a split."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_summary(train: DataFrame, test: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row (duplicate_groups, cross_split_duplicate_groups, shared_records) for the values of
    ``fields``, nulls equal to each other: values with more than one row in all, values in both
    parts, and the rows of the latter.  One shuffle of pre-aggregated counts."""
    tagged = train.select(*fields, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).unionByName(test.select(*fields, F.lit(0).alias("_tr"), F.lit(1).alias("_te")))
    counts = tagged.groupBy(*fields).agg(F.sum("_tr").alias("_tr"), F.sum("_te").alias("_te"))
    both = (F.col("_tr") > 0) & (F.col("_te") > 0)
    return counts.agg(
        F.count(F.when(F.col("_tr") + F.col("_te") > 1, 1)).alias("duplicate_groups"),
        F.count(F.when(both, 1)).alias("cross_split_duplicate_groups"),
        F.coalesce(F.sum(F.when(both, F.col("_tr") + F.col("_te"))), F.lit(0)).alias("shared_records"),
    )


def shared_rows(part: DataFrame, other: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of ``part`` whose fields occur in ``other``."""
    keys = other.select(*(F.col(f).alias(f"_k{i}") for i, f in enumerate(fields))).distinct()
    return part.join(keys, [part[f].eqNullSafe(keys[f"_k{i}"]) for i, f in enumerate(fields)], "left_semi")


#: Words of identifier names.
STRONG_ENDINGS = ("id", "identifier", "key")
WEAK_WORDS, WEAK_ENDINGS = ("ticket", "code", "reference", "ref"), ("number", "no")
POSITION_WORDS = ("unnamed", "index", "row")
#: A word of a name: capitals up to the one that begins the next word, or lower case and digits.
_WORD = re.compile("[A-Z]+(?![a-z])[a-z0-9]*|[A-Z]?[a-z0-9]+")


def identifier_strength(column: str) -> str | None:
    """``strong`` or ``weak`` where the name speaks of an identifier, and not of a position; a name
    is read word by word, in snake case as in camel case."""
    words = [w.lower() for w in _WORD.findall(column)]
    match words:
        case [first, *_] if first in POSITION_WORDS:
            return None
        case [*_, last] if last in STRONG_ENDINGS:
            return "strong"
        case [*_, last] if last in WEAK_ENDINGS or not set(words).isdisjoint(WEAK_WORDS):
            return "weak"
    return None


def identifier_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, strength, unique_values, unique_ratio, missing_rate, confidence) of columns whose
    name and values both look like an identifier."""
    named = [(c, identifier_strength(c)) for c in (columns or df.columns)]
    named = [(c, s) for c, s in named if s]
    empty = "column string, strength string, unique_values bigint, unique_ratio double, missing_rate double, confidence string"
    if not named:
        return df.sparkSession.createDataFrame([], empty)
    row = df.agg(F.count("*").alias("rows"), *(m for i, (c, _) in enumerate(named) for m in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"u{i}"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(s).alias("strength"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("unique_values"), F.col("rows")) for i, (c, s) in enumerate(named)))
    table = row.select(F.explode(cells).alias("c")).select("c.*")
    ratio = F.when(F.col("n") > 0, F.col("unique_values") / F.col("n")).otherwise(0.0)
    missing = F.when(F.col("rows") > 0, 1 - F.col("n") / F.col("rows")).otherwise(1.0)
    table = table.withColumns({"unique_ratio": ratio, "missing_rate": missing}).where("unique_values > 1 and unique_ratio >= 0.10 and missing_rate <= 0.20")
    sure = (F.col("strength") == "strong") & (F.col("unique_ratio") >= 0.80) & (F.col("missing_rate") <= 0.05)
    return table.withColumn("confidence", F.when(sure, "High").otherwise("Medium")).select("column", "strength", "unique_values", "unique_ratio", "missing_rate", "confidence")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate ahead by confidence, strength, ratio and completeness; ties by name."""
    rank = F.struct((F.col("confidence") == "High").cast("int"), (F.col("strength") == "strong").cast("int"), F.col("unique_ratio"), -F.col("missing_rate"))
    return candidates.orderBy(rank.desc(), "column").limit(1)


def restriction(data: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """One row (known, missing, quantifiable): how many of a part's row ids the data holds, and
    whether it holds all; otherwise what is found of the part can't be quantified."""
    marked = ids.select(row_id).join(data.select(row_id, F.lit(1).alias("_there")), row_id, "left")
    table = marked.agg(F.count("_there").alias("known"), F.count(F.when(F.col("_there").isNull(), 1)).alias("missing"))
    return table.withColumn("quantifiable", F.col("missing") == 0)


def restrict(data: DataFrame, ids: DataFrame, row_id: str) -> DataFrame | None:
    """The rows of ``data`` with one of the row ids; None where one is missing."""
    if not restriction(data, ids, row_id).first()["quantifiable"]:
        return None
    return data.join(ids.select(row_id), row_id, "left_semi")


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``part`` (train or test), decided by a digest of the key alone: a row keeps its
    part however the table is partitioned or grows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
    return df.withColumn("part", F.when(u < test_share, "test").otherwise("train"))
