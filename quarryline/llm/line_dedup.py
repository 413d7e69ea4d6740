"""Line dedup over levelled sorted runs of line hashes.

What is known of earlier lines is a set of runs: tables of (line hash, smallest document), sorted
and bucketed by the hash, no hash in two of them.  A new batch of documents brings its distinct
line hashes; they are merge-joined with every run, bucket by bucket, the ones found nowhere become
a new run of level 0, and as soon as a level has ``FANOUT`` runs they are merged into one run of
the next level.  Batches come in the order of the document ids, so the first holder of a line is
the smallest one.  A line is dropped where its document isn't the first holder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_LOWER, ASCII_SPACE, delete_path, fresh, in_slices, left_join_set, materialise, rows_without, scratch_path, utf8, with_texts

#: Runs of one level that are compacted into one run of the next.
FANOUT = 3
#: Code points that a line's key needs to be compared.
MIN_CHARS = 10


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits for the line's key, or nothing for a key that is too short to compare."""
    key = line.strip(ASCII_SPACE)
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h binary, doc_id): each document's distinct line hashes; rows without an id hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, out = [], []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {line_hash(line, min_chars) for line in x.as_py().translate(ASCII_LOWER).split(b"\n")}
                found.discard(None)
                ids += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "h binary, doc_id long")


class LineRuns:
    """The levelled runs; ``add`` takes the documents of one batch and returns what to drop."""

    def __init__(self, spark: SparkSession, buckets: int, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.buckets, self.min_chars = spark, buckets, min_chars
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, keys: DataFrame) -> str:
        """A run: bucketed and sorted by the hash, in the shared folder, so that a later merge
        reads it without a shuffle."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "line-run")
        (
            keys.repartition(self.buckets, "h")
            .write.format("parquet")
            .bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def _push(self, name: str, level: int = 0) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for t in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            self._push(self._write(merged), level + 1)
            for t in old:
                self._drop(t)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drops the runs, also those of a batch that failed, with their files."""
        self.levels = []
        for name in list(self.paths):
            self._drop(name)

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, h): the lines of the batch that an earlier or smaller document holds.  The
        batch's ids must be above those of all batches before."""
        lines = line_keys(docs, self.min_chars)
        # one row a line for each task before the shuffle, however many documents hold it
        seen = lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        for i, t in enumerate(self.tables()):
            run = self.spark.table(t).select("h", F.col("first").alias(f"run{i}")).hint("merge")
            seen = seen.join(run, "h", "left")
        known = [F.col(f"run{i}") for i in range(len(self.tables()))]
        owner = F.coalesce(*known, F.col("first"))
        seen = materialise(seen.select("h", "first", "last", owner.alias("owner"), (F.coalesce(*known, F.lit(None)).isNull()).alias("new")), "batch-lines")
        self._push(self._write(seen.where("new").select("h", "first")))
        shared = seen.where("last > owner").select("h", "owner")
        return materialise(lines.join(shared, "h").where("doc_id > owner").select("doc_id", "h"), "line-drops")


def batches_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` in ranges of about as many rows, ascending by id, with no id in two of them."""
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)]), F.lit(1000)).alias("q")).first().q
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs.where(F.col("doc_id").isNotNull())
        part = part if low is None else part.where(F.col("doc_id") > low)
        out.append(part if high is None else part.where(F.col("doc_id") <= high))
    return out


def line_drops(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(_doc, _dropped array<binary>): the hashes of the lines that each document loses, for
    ``docs`` (doc_id, raw)."""
    spark = docs.sparkSession
    runs = LineRuns(spark, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), min_chars)
    try:
        parts = [runs.add(b) for b in batches_by_id(docs, batches)]
    finally:
        runs.close()
    drops = parts[0]
    for p in parts[1:]:
        drops = drops.unionByName(p)
    return drops.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("h").alias("_dropped"))


def keep_lines(raw: bytes, dropped: list[bytes], min_chars: int) -> tuple[bytes, int]:
    """The text without the dropped lines, and how many those are."""
    gone = set(dropped)
    keep = [line for line in raw.split(b"\n") if line_hash(line.translate(ASCII_LOWER), min_chars) not in gone]
    return b"\n".join(keep), raw.count(b"\n") + 1 - len(keep)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``.

    Texts are split at line feeds; a null or empty text is one empty line.  A key is the line
    without ASCII white space at both ends and with ASCII letters lower-cased; keys of fewer than
    ``min_chars`` code points are never dropped.  Rows of one id are one document: none of them
    makes another lose a line.  A row with a null id keeps all its lines and takes none from
    others.  Repeated rows are reported one by one, further columns ignored; an empty table gives
    none.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches_):
            n_lines, n_dropped, kept = [], [], []
            for x, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = x.as_py()
                text, n = keep_lines(raw, gone, min_chars) if gone else (raw, 0)
                n_lines.append(raw.count(b"\n") + 1)
                n_dropped.append(n)
                kept.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    drops = line_drops(rows, min_chars, batches)
    return left_join_set(rows, drops, "doc_id", "_doc").select("doc_id", "raw", "_dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with every text reduced to its kept lines; all columns stay, and all rows.

    With ``drop_emptied`` rows that lost lines go if nothing but white space is left of them: all
    they held is in smaller documents.  Texts that were empty or blank before lose no line and
    stay.  A null text stays null; see :func:`line_report` for the other edge cases.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches_):
            texts = batch.column(at)
            kept, stay = [], []
            for t, gone in zip(texts.to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                left = keep_lines(t.encode("utf-8", "replace"), gone, min_chars)[0] if gone else None
                kept.append(t if left is None else left.decode("utf-8", "replace"))
                stay.append(not drop_emptied or left is None or bool(left.strip(ASCII_SPACE)))
            out = pa.RecordBatch.from_arrays([pa.array(kept, texts.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)], names=names)
            yield out.filter(pa.array(stay, pa.bool_()))

    names = docs.columns
    at = names.index(text_col)
    drops = line_drops(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")), min_chars, batches)
    gone = fresh(docs, "_dropped")
    drops = materialise(drops.select(F.col("_doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_dropped").alias(gone)), "dropped-lines")
    # texts that lose no line stay where they are
    cut = with_texts(docs, id_col, drops).select(*names, gone).mapInArrow(run, docs.schema)
    return rows_without(docs, id_col, drops.select(id_col)).select(names).unionByName(cut)
