"""Exact duplicate rows and identical columns, on the real values rather than on hashes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group, and groups, that a report shows.
SHOWN_ROWS, SHOWN_GROUPS = 10, 20


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, duplicate_rows, duplicate_groups, duplicate_rate): rows that repeat an
    earlier one, and the different rows that do; nulls are equal to each other."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("_n"))
    table = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_groups"),
    )
    return table.withColumn("duplicate_rate", F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows")).otherwise(0.0))


def duplicate_groups(df: DataFrame, row_id: str, columns: Sequence[str], groups: int = SHOWN_GROUPS, rows: int = SHOWN_ROWS) -> DataFrame:
    """(first_row, size, row_ids): the duplicate groups with the smallest first rows, each with
    its first ``rows`` row ids."""
    sized = df.groupBy(*columns).agg(F.count("*").alias("size"), F.min(row_id).alias("first_row")).where("size > 1")
    shown = sized.orderBy("first_row").limit(groups)
    same = [df[c].eqNullSafe(shown[c]) for c in columns]
    members = df.join(F.broadcast(shown), same).select("first_row", "size", F.col(row_id).alias("_row"))  # at most ``groups`` rows
    rank = F.row_number().over(Window.partitionBy("first_row").orderBy("_row"))
    return members.withColumn("_k", rank).where(F.col("_k") <= rows).groupBy("first_row", "size").agg(F.array_sort(F.collect_list("_row")).alias("row_ids"))


def keep_first(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """The rows that don't repeat an earlier one, by ``row_id``.  The first of each group is found
    by a pre-aggregated minimum, so a value that very many rows hold is no hot window."""
    first = df.groupBy(*columns).agg(F.min(row_id).alias(row_id))
    return df.join(first.select(row_id), row_id, "left_semi")


#: Columns whose fingerprints, and pairs whose values, are one aggregate.
FUSED = 200


def identical_columns(df: DataFrame) -> DataFrame:
    """(left, right) pairs of columns of one type that agree in every row, nulls included.  Columns
    with different fingerprints are ruled out in one pass for each FUSED of them; the rest is
    compared value by value."""
    kinds = dict(df.dtypes)
    if len(df.columns) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string")
    prints: dict = {}
    for at in range(0, len(df.columns), FUSED):
        part = list(enumerate(df.columns))[at : at + FUSED]
        prints |= df.agg(*(F.sum(F.xxhash64(F.col(c).isNull(), F.col(c)).cast("decimal(38,0)")).alias(f"h{i}") for i, c in part)).first().asDict()
    alike: dict[tuple, list[str]] = {}
    for i, c in enumerate(df.columns):
        alike.setdefault((kinds[c], prints[f"h{i}"]), []).append(c)
    pairs = [p for same in alike.values() for p in combinations(same, 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string")
    same = []
    for at in range(0, len(pairs), FUSED):
        part = pairs[at : at + FUSED]
        row = df.agg(*(F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias(f"s{k}") for k, (a, b) in enumerate(part))).first()
        same += [p for k, p in enumerate(part) if row[f"s{k}"]]
    return df.sparkSession.createDataFrame(same, "left string, right string")
