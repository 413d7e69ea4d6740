"""Rows outside a column's fences, and values outside its dominant integer domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.values import finite
from quarryline.operators.profile import exact_quantiles

#: Finite values that a column needs before fences are drawn.
MIN_VALUES = 20
#: Distance from the quartiles in interquartile ranges, and the robust z-score, that are too far.
REACH, ROBUST_Z = 1.5, 3.5


def fences_of(df: DataFrame, counts: dict[str, int]) -> dict[str, dict]:
    """column -> {method, low, high} for columns with their numbers of finite values, all at once:
    interquartile fences where the range is positive, else the robust z-score.  Columns with too
    few values, or without any deviation, are left out."""
    columns = [c for c, n in counts.items() if n >= MIN_VALUES]
    most = max(counts.values(), default=0)
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], most)
    out = {c: {"method": "iqr", "low": q1 - REACH * (q3 - q1), "high": q3 + REACH * (q3 - q1)} for c, (q1, q3) in quartiles.items() if q3 > q1}
    return out | robust_fences(df, [c for c in columns if c not in out], most)


def robust_fences(df: DataFrame, columns: list[str], rows: int | None = None) -> dict[str, dict]:
    """column -> {method, low, high} at a robust z-score of ROBUST_Z around the median."""
    medians = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], rows).items() if q[0] is not None}
    away = df.select(*(F.abs(finite(F.col(c)) - m).alias(c) for c, m in medians.items()))
    spread = {c: q[0] for c, q in exact_quantiles(away, list(medians), [0.5], rows).items() if q[0]}
    reach = {c: ROBUST_Z * mad / 0.6745 for c, mad in spread.items()}
    return {c: {"method": "mad", "low": medians[c] - r, "high": medians[c] + r} for c, r in reach.items()}


def fences(df: DataFrame, column: str, robust: bool = False) -> dict | None:
    """The fences of one column, None where none can be drawn."""
    if robust:
        return robust_fences(df, [column]).get(column)
    n = df.agg(F.count(finite(F.col(column))).alias("n")).first()["n"]
    return fences_of(df, {column: n}).get(column)


def outliers(df: DataFrame, column: str, robust: bool = False) -> DataFrame:
    """The rows whose finite value lies outside the fences (with ``robust``, always those around
    the median); no rows where none can be drawn."""
    found = fences(df, column, robust)
    if found is None:
        return df.where("false")
    x = finite(F.col(column))
    return df.where((x < found["low"]) | (x > found["high"]))


def integer_domains(counts: DataFrame) -> DataFrame:
    """(column, value, n) of the rare integers outside each column's dominant, gapless integer
    domain, of the value counts (column, value double, n) of finite values.

    Applies to 50 or more finite values, all integers, of 4 to 20 different ones.  A value is
    dominant with a share of at least 1 % and at least three occurrences; the dominant ones have
    to be two or more, without gaps, and cover 95 % of the values.
    """
    facts = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.bool_and(F.abs(F.col("value") - F.round("value")) < 1e-9).alias("whole"))
    facts = facts.where("total >= 50 and whole and kinds between 4 and 20").select("column", "total")
    # at most 20 rows a column are left
    checked = counts.join(facts, "column").withColumn("support", F.greatest(F.lit(3), F.ceil(F.col("total") * 0.01)))
    dominant = checked.where("n >= support").withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("column").orderBy("value")))
    domain = dominant.groupBy("column").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("many"), F.coalesce(F.bool_and(F.abs(F.col("step") - 1) < 1e-9), F.lit(False)).alias("gapless"), (F.sum("n") / F.max("total")).alias("covered")
    )
    domain = domain.where("many >= 2 and gapless and covered >= 0.95")
    return checked.where("n < support").join(domain, "column").where("value < low or value > high").select("column", "value", "n")


def integer_domain(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of :func:`integer_domains` for one column."""
    values = df.select(finite(F.col(column)).alias("value")).where("value is not null")
    return integer_domains(values.groupBy(F.lit(column).alias("column"), "value").agg(F.count("*").alias("n"))).select("value", "n")
