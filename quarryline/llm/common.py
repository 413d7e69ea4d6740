"""What the training-data operators share: the shared scratch folder, table reads, components.

Nothing here collects an unbounded set of rows to the driver.  Intermediate tables are written
as Parquet under ``spark.checkpoint.dir``, so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose texts a Python worker turns into objects at once.
SLICE_ROWS = 512
#: ASCII letters lower-cased, every other byte kept.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The six ASCII white-space bytes: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_FALLBACK: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a local master: on a
    cluster such a folder would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quarryline-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the scratch folder, wherever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: The innermost block's tables; each thread of a driver has its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("temporary_tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written inside, but for those written with
    ``keep``.  What leaves the block may depend on kept tables only.  Blocks may be in one another,
    and several threads of a driver may each have theirs."""
    written: list[str] = []
    outer = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in written:
            delete_path(spark, path)


#: Spark's setting to delete a query's shuffle files when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files.  A value that the user has set stays."""
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, the rows survive
    the loss of any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    scope = _SCOPE.get()
    if scope is not None and not keep:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table that :func:`materialise` wrote, before its block ends: nothing may depend on it."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, not copied: what is made of their texts, and returned, stays
    small, however many rows Spark sends at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def left_join_set(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A left join in which the rows without a key, which may be many, take no part in the
    shuffle: hashed, they would all land in one task."""
    met = left.where(F.col(left_key).isNotNull()).join(right, F.col(left_key) == F.col(right_key), "left")
    return met.unionByName(left.where(F.col(left_key).isNull()), allowMissingColumns=True)


#: Places of a sieve: 2**26 bits, which are 2048 rows of 4 KB at most, whatever it is made of.
SIEVE_BITS = 26


def _sieve(key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """A bitmap of the hashes of ``ids`` (a column ``key``) to be broadcast, of 8 MB at most, and
    the condition under which a row's key may be among them."""

    def place(c: str) -> tuple[Column, Column]:
        at = F.shiftrightunsigned(F.xxhash64(c), 64 - SIEVE_BITS)
        return F.shiftright(at, 15).cast("int"), at.bitwiseAND(F.lit(32767)).cast("int")

    row, bit = place(key)
    # dealt by row first, so that a row of the bitmap is made once, not in every task
    marks = ids.select(row.alias("_row"), bit.alias("_bit")).repartition("_row")
    sieve = F.broadcast(marks.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return sieve, (row == F.col("_row")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1)


def with_texts(texts: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``key``, …), a written table, joined with the rows of ``texts`` of the same key.

    Where few of many wide texts are wanted, a plain join would shuffle all of them.  So a bitmap
    of the wanted keys' hashes is broadcast first; rows that it rules out stay where they are, and
    the join decides on the others.  A bitmap that very many keys have filled rules out little, but
    loses nothing.  As ``wanted`` grows with the texts it is never broadcast itself, however small
    it is, so the plan is the same at every size.
    """
    sieve, may = _sieve(key, wanted.select(key))
    return texts.join(sieve, may, "left_semi").join(wanted.hint("merge"), key)


def rows_with(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids``; otherwise as :func:`with_texts`."""
    sieve, may = _sieve(key, ids)
    return df.join(sieve, may, "left_semi").join(ids.hint("merge"), key, "left_semi")


def rows_without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't among ``ids``, or null; otherwise as :func:`with_texts`."""
    sieve, may = _sieve(key, ids)
    return df.join(sieve, may, "left_anti").unionByName(df.join(sieve, may, "left_semi").join(ids.hint("merge"), key, "left_anti"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an undirected edge list with the smallest node it reaches.

    Alternating large-star and small-star rounds.  The smallest neighbours are found by minima
    with map-side combining, and written: the join with them then has shuffles of its own on both
    sides, in which adaptive execution splits the edges of a hub.  The loop ends when a round
    changes nothing, which takes about the logarithm of the longest path.  An empty edge list
    gives an empty table.
    """
    cur = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    while True:
        # large star: every neighbour above u is tied to the smallest node around u
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "edges")
        # small star: every neighbour below u, and u itself, is tied to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, "edges")
        # unchanged when both edge sets agree; the sums are order-free fingerprints of the sets
        mark = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
        if new.agg(*mark).first() == cur.agg(*mark).first():
            break
        cur = new
    stars = new.groupBy("u").agg(F.min("v").alias("m"))
    return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
        stars.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("component"))
    )
