"""Column profiles: one fused aggregate for scalars, one keyed aggregate for values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.values import corrected_skewness, finite

#: Columns whose metrics go into one aggregate; wider tables take several.
FUSED = 40
#: Rows up to which exact percentiles are taken directly.  Their state grows with the distinct
#: values, so a larger table first narrows each percentile down to a bracket.
DIRECT_ROWS = 100_000


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans count as categorical."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in set(numeric_columns(df))]


def _stacked(metrics: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of ``<position>_<metric>`` cells -> one row a column."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{i}_{n}").alias(n) for n in names)) for i, c in enumerate(columns)))
    return metrics.select(F.explode(rows).alias("r")).select("r.*")


def _chunked(df: DataFrame, columns: Sequence[str], metrics: dict) -> DataFrame:
    """``metrics``: name -> function of a column name, evaluated for all columns in one pass for
    each FUSED of them."""
    out = None
    for at in range(0, len(columns), FUSED):
        part = list(columns[at : at + FUSED])
        row = df.agg(*(f(c).alias(f"{i}_{n}") for i, c in enumerate(part) for n, f in metrics.items()))
        table = _stacked(row, part, list(metrics))
        out = table if out is None else out.unionByName(table)
    return out


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, nulls, null_rate); NaN counts as null."""
    kinds = dict(df.dtypes)

    def missing(c: str):  # noqa: ANN202
        return F.col(c).isNull() | F.isnan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).isNull()

    table = _chunked(df, columns or df.columns, {"rows": lambda c: F.count("*"), "nulls": lambda c: F.count(F.when(missing(c), 1))})
    return table.withColumn("null_rate", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value string, n): how often each value of each column occurs, nulls left out.

    All columns share one shuffle of pre-aggregated pairs, instead of one DISTINCT each.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def cardinality(counts: DataFrame) -> DataFrame:
    """(column, non_null, n_distinct, unique_ratio, top_count, dominant_rate) of value counts."""
    table = counts.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("n_distinct"), F.max("n").alias("top_count"))
    return table.withColumns({"unique_ratio": F.col("n_distinct") / F.col("non_null"), "dominant_rate": F.col("top_count") / F.col("non_null")})


#: Different values up to which those of a column are counted one by one; approximate numbers of
#: them, good to a twentieth, tell the columns.
FEW_VALUES = 64
#: Share of the rows that a value has to have to be told as a column's dominant one.
VARIED = 0.98


def few_valued(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with about FEW_VALUES different values at most, certainly those with half as many."""
    if not columns:
        return []
    row = df.agg(*(F.approx_count_distinct(c).alias(f"k{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[f"k{i}"] <= FEW_VALUES]


def dominance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, non_null, constant, top_count): how many values each column has, whether they are all
    equal, and how often the one in the middle occurs when hashes of values are sorted.

    A value that most rows have is always that one, so its share is exact; two passes, without a
    shuffle of values, tell it of columns of any number of different values.  A column of so many that
    no value can have VARIED of the rows isn't looked at closer; its ``top_count`` is null.
    """
    columns = list(columns)
    sizes = df.agg(*(m for i, c in enumerate(columns) for m in (F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"k{i}")))).first()
    closer = [c for i, c in enumerate(columns) if sizes[f"n{i}"] and sizes[f"k{i}"] <= max(FEW_VALUES, 2 * (1 - VARIED) * sizes[f"n{i}"])]
    out = [(c, sizes[f"n{i}"], False, None) for i, c in enumerate(columns) if sizes[f"n{i}"] and c not in closer]
    # 52 bits, which approximate quantiles keep
    h = [F.when(F.col(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(c), 12)) for c in closer]
    if closer:
        row = df.agg(*(F.percentile_approx(x, 0.5, F.lit(100)).alias(f"m{i}") for i, x in enumerate(h))).first()
        found = df.agg(*(m for i, x in enumerate(h) for m in ((F.min(x) == F.max(x)).alias(f"same{i}"), F.count(F.when(x == F.lit(row[f"m{i}"]), 1)).alias(f"top{i}")))).first()
        out += [(c, sizes[f"n{columns.index(c)}"], found[f"same{i}"], found[f"top{i}"]) for i, c in enumerate(closer)]
    return df.sparkSession.createDataFrame(out, "column string, non_null long, constant boolean, top_count long")


#: Share of the rows on either side of a quantile that its bracket takes in, and the accuracy of
#: the approximate quantiles that are its ends.
SLACK, ACCURACY = 0.002, 2000


def bracket_ends(column: str, probs: Sequence[float]) -> Column:
    """The approximate quantiles around each of ``probs``, low and high by turns."""
    wide = [x for p in probs for x in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    return F.percentile_approx(column, F.array(*map(F.lit, wide)), F.lit(ACCURACY))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], rows: int | None = None, ends: Mapping[str, tuple] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the finite values, exact at every size.

    Beyond DIRECT_ROWS a first pass brackets each quantile by approximate ones, a second counts
    what lies below, and a third takes the exact order statistics inside the brackets only.  A
    caller that has passed over the table may give the number of rows, and for each column the
    number of its finite values and their :func:`bracket_ends`.
    """
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    values = df.select(*(finite(F.col(c)).alias(str(i)) for i, c in enumerate(columns)))
    n = values.count() if rows is None else rows
    if n <= DIRECT_ROWS:
        row = values.agg(*(F.percentile(F.col(str(i)), F.array(*map(F.lit, probs))).alias(str(i)) for i in range(len(columns)))).first()
        return {c: list(row[str(i)] or [None] * len(probs)) for i, c in enumerate(columns)}
    if ends is None:
        first = values.agg(*(m for i in range(len(columns)) for m in (F.count(str(i)).alias(f"n{i}"), bracket_ends(str(i), probs).alias(f"q{i}")))).first()
    else:
        first = {f"{k}{i}": x for i, c in enumerate(columns) for k, x in zip("nq", ends[c], strict=True)}
    brackets = {(i, k): (first[f"q{i}"][2 * k], first[f"q{i}"][2 * k + 1]) for i in range(len(columns)) for k in range(len(probs)) if first[f"q{i}"]}
    second = values.agg(
        *(
            m
            for (i, k), (low, high) in brackets.items()
            for m in (F.count_if(F.col(str(i)) < low).alias(f"b{i}_{k}"), F.count_if(F.col(str(i)).between(low, high)).alias(f"c{i}_{k}"))
        )
    ).first()
    third, plan = [], {}
    for (i, k), (low, high) in brackets.items():
        rank = (first[f"n{i}"] - 1) * probs[k]
        inside = second[f"c{i}_{k}"]
        share = (rank - second[f"b{i}_{k}"]) / max(1, inside - 1)
        plan[i, k] = 0 <= share <= 1
        x = F.when(F.col(str(i)).between(low, high), F.col(str(i))) if plan[i, k] else F.col(str(i))
        third.append(F.percentile(x, F.lit(share if plan[i, k] else probs[k])).alias(f"v{i}_{k}"))
    last = values.agg(*third).first() if third else None
    return {c: [last[f"v{i}_{k}"] if (i, k) in brackets else None for k in range(len(probs))] for i, c in enumerate(columns)}


QUARTILES = (0.25, 0.5, 0.75)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, missing, mean, std, min, q1, median, q3, max, skewness) of finite values.
    The moments and the brackets of the quartiles are one pass; the quartiles come from
    :func:`exact_quantiles`, whose state is bounded on large tables."""
    columns = list(columns or numeric_columns(df))
    prepared = df.select(*(finite(F.col(c)).alias(c) for c in columns), *(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).alias(f"_missing_{c}") for c in columns))
    moments = _chunked(
        prepared,
        columns,
        {
            "count": lambda c: F.count(F.col(c)),
            "missing": lambda c: F.count(F.col(f"_missing_{c}")),
            "mean": lambda c: F.avg(F.col(c)),
            "std": lambda c: F.stddev_samp(F.col(c)),
            "min": lambda c: F.min(F.col(c)),
            "max": lambda c: F.max(F.col(c)),
            "skewness": lambda c: corrected_skewness(F.col(c)),
            "rows": lambda c: F.count("*"),
            "ends": lambda c: bracket_ends(c, QUARTILES),
        },
    ).collect()  # a row a column
    rows = max((m["rows"] for m in moments), default=0)
    quartiles = exact_quantiles(df, columns, QUARTILES, rows, {m["column"]: (m["count"], m["ends"]) for m in moments})
    names = ("column", "count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skewness")
    out = [tuple(({**m.asDict(), **dict(zip(("q1", "median", "q3"), quartiles[m["column"]], strict=True))})[k] for k in names) for m in moments]
    return df.sparkSession.createDataFrame(out, ", ".join(f"{n} {'string' if n == 'column' else 'long' if n in ('count', 'missing') else 'double'}" for n in names))


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, skewness) of finite values, without the quantiles of a whole profile."""
    prepared = df.select(*(finite(F.col(c)).alias(c) for c in columns))
    return _chunked(prepared, list(columns), {"skewness": lambda c: corrected_skewness(F.col(c))})


#: Columns whose correlations are one aggregate of built-in functions.
FEW_CORRELATED = 6


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature_a, feature_b, r) for the pairs of columns in order.

    The pairs of a few columns are built-in aggregates.  Of more columns a task adds up, for a batch of rows at a time, the matrices of products of all columns, less
    the columns' means, over the rows in which both are set; a few matrices a task reach the sum,
    whatever the number of rows.  Columns without a mean have no correlations.
    """
    columns = list(columns or numeric_columns(df))
    names = [f"c{i}" for i in range(len(columns))]
    prepared = df.select(*(finite(F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)))
    if len(columns) <= FEW_CORRELATED:
        pairs = list(combinations(range(len(columns)), 2))
        if not pairs:
            return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")

        def correlation(x: Column, y: Column) -> Column:
            both = x.isNotNull() & y.isNotNull()
            return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))

        row = prepared.agg(*(correlation(F.col(names[i]), F.col(names[j])).alias(f"r{i}_{j}") for i, j in pairs))
        cells = F.array(*(F.struct(F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs))
        return row.select(F.explode(cells).alias("c")).select("c.*")
    means = prepared.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names)).first()
    centre = np.array([means[n] for n in names])
    kinds = ("n", "xy", "x", "xx")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(names), len(names)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centre
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0)
            # of the pair (i, j): rows with both, sum of x y, of x and of x squared over these
            total += [there.T @ there, x.T @ x, x.T @ there, np.square(x).T @ there]
        i, j = np.indices(total.shape[1:], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), *(pa.array(t.ravel()) for t in total)], ["i", "j", *kinds])

    part = prepared.mapInArrow(products, "i int, j int, n double, xy double, x double, xx double")
    cells = part.groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in kinds))
    mirrored = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = cells.where("i < j").join(mirrored, ["i", "j"])
    spread = F.greatest(F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0)), F.greatest(F.col("n") * F.col("yy") - F.col("y") * F.col("y"), F.lit(0.0))
    # what is left of a constant column is rounding
    varies = [s > F.col("n") * F.col(k) * 1e-13 for s, k in zip(spread, ("xx", "yy"), strict=True)]
    r = F.when(varies[0] & varies[1], (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread[0]) / F.sqrt(spread[1]))
    listed = F.array(*map(F.lit, columns))
    return both.select(F.element_at(listed, F.col("i") + 1).alias("feature_a"), F.element_at(listed, F.col("j") + 1).alias("feature_b"), r.alias("r"))


#: Fixed value: what columns of counts are named after.
COUNT_NAME = "count|times?|number|num|visits?|years?|months?"
#: Kinds of numeric columns in order, with the most different values, and the largest
#: share of different values, that each has.
KINDS = {"binary": (2, 1.0), "count-like": (20, 0.10), "low-cardinality numeric categorical": (10, 0.05), "discrete integer": (20, 0.10)}


def with_kind(facts: DataFrame) -> DataFrame:
    """``facts`` (column, n, n_distinct, low, integer_like, zero_one) with ``kind``, how a numeric
    column is read before outliers are judged; a null number of different values means many."""
    share = F.col("n_distinct") / F.greatest(F.col("n"), F.lit(1))
    few = {kind: F.coalesce((F.col("n_distinct") <= most) & (share <= of), F.lit(False)) for kind, (most, of) in KINDS.items()}
    counted = F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "_").rlike(COUNT_NAME) & F.coalesce(F.col("n_distinct") <= KINDS["count-like"][0], F.lit(False))
    holds = {
        "binary": F.col("zero_one") & few["binary"],
        "count-like": F.col("integer_like") & (F.col("low") >= 0) & (counted | few["count-like"]),
        "low-cardinality numeric categorical": few["low-cardinality numeric categorical"],
        "discrete integer": F.col("integer_like") & few["discrete integer"],
    }
    return facts.withColumn("kind", F.coalesce(*(F.when(holds[kind], kind) for kind in KINDS), F.lit("continuous numeric")))


def numeric_classes(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None, many: Sequence[str] = ()) -> DataFrame:
    """(position, column, n, n_distinct, low, integer_like, zero_one, kind), a row for each numeric
    column.  ``counts`` may give the value counts of the finite values, where they are known; of the
    columns in ``many`` it needn't, as they are known to have more than any kind asks for, and their
    number of different values is told as null."""
    columns = list(columns or numeric_columns(df))
    prepared = df.select(*(finite(F.col(c)).alias(c) for c in columns))
    facts = _chunked(
        prepared,
        columns,
        {
            "position": lambda c: F.lit(columns.index(c)),
            "n": lambda c: F.count(F.col(c)),
            "low": lambda c: F.min(F.col(c)),
            "integer_like": lambda c: F.coalesce(F.bool_and(F.abs(F.col(c) - F.round(F.col(c))) < 1e-9), F.lit(False)),
            "zero_one": lambda c: F.coalesce(F.bool_and(F.col(c).isin(0.0, 1.0)), F.lit(True)),
        },
    )
    distinct = cardinality(value_counts(prepared, columns) if counts is None else counts).select("column", "n_distinct")
    of = F.when(F.col("column").isin(*many), F.lit(None)).otherwise(F.coalesce("n_distinct", F.lit(0)))
    return with_kind(facts.join(distinct, "column", "left").withColumn("n_distinct", of))
