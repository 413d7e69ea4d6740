"""Benchmark decontamination: a broadcast hash set of test n-grams against training windows.

Benchmark items are cut into windows of ``n`` consecutive normalised words (an item of fewer words
is one window).  The windows are dealt into blocks of bounded size; each block becomes a hash set
that is broadcast, and every document's words are scanned against it.  A window is looked up only
where all its words occur in the benchmark, and a hit is an equality of all its words, not of a
hash.  Benchmarks of the usual size are one block, and then documents are scanned once, without a
shuffle; a larger benchmark costs one scan a block, and the hits of all blocks meet by the digest of
the text, so the results are the same however many blocks there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import ASCII_LOWER, fresh, in_slices, materialise, rows_with, rows_without, utf8

#: Words are ASCII letters (lower-cased), digits and everything beyond ASCII.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in ASCII_LOWER)
#: Windows, and bytes of them, that one broadcast block holds at most.
BLOCK_WINDOWS = 400_000
BLOCK_BYTES = 64_000_000
#: Holders of one window that one row lists, on average; a window of more has several rows.
ROW_ITEMS = 1000


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def windows_of(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words binary, part int, items array<long>): the distinct windows of all items and who holds
    them, in as many rows as ROW_ITEMS asks for.

    Items with a null id or without words have no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw)
                found = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else ()
                ids += [item] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item_id", "words"])

    cut = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), utf8(text_col).alias("raw"))
    held = materialise(cut.mapInArrow(run, "item_id long, words binary"), "item-windows")
    # a window that very many items hold is dealt out before they are gathered
    parts = materialise(held.groupBy("words").agg(F.ceil(F.count("*") / ROW_ITEMS).cast("int").alias("parts")).where("parts > 1"), "popular-windows")
    dealt = held.join(parts, "words", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("item_id"), F.col("parts")), F.lit(0)).cast("int"))
    return dealt.groupBy("words", "part").agg(F.collect_set("item_id").alias("items"))


def blocks_of(windows: DataFrame) -> list[Broadcast]:
    """The windows as broadcast dictionaries, each within BLOCK_WINDOWS and about BLOCK_BYTES."""
    spark = windows.sparkSession
    windows = materialise(windows, "windows")
    total = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words") + 8 * F.size("items")), F.lit(0)).alias("size")).first()
    # with hashing, a block of half the bound on average stays within it
    parts = 1 if total.n <= BLOCK_WINDOWS and total.size <= BLOCK_BYTES else 1 + 2 * max(total.n // BLOCK_WINDOWS, total.size // BLOCK_BYTES)
    out = []
    for k in range(parts):
        part = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("words", "part"), F.lit(parts)) == k)
        block: dict[bytes, list[int]] = {}
        for r in part.select("words", F.col("items").alias("items_")).toLocalIterator():
            block.setdefault(bytes(r.words), []).extend(r.items_)
        out.append(spark.sparkContext.broadcast(block))
    return out


class Scanner:
    """Finds a block's windows in documents."""

    def __init__(self, windows: dict[bytes, list[int]]) -> None:
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        for text, items in windows.items():
            ids = [self.number.setdefault(w, len(self.number)) for w in text.split(b" ")]
            self.windows.setdefault(len(ids), {})[np.array(ids, np.int32).tobytes()] = items

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """The positions of the words that lie in an occurrence of a window, and the items."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        cover = np.zeros(len(words) + 1, np.int32)
        items: set[int] = set()
        for n, table in self.windows.items():
            for at in np.flatnonzero(known[n:] - known[:-n] == n).tolist() if len(words) >= n else ():
                if found := table.get(ids[at : at + n].tobytes()):
                    items.update(found)
                    cover[at] += 1
                    cover[at + n] -= 1
        return np.flatnonzero(np.cumsum(cover[:-1])), items


_LAST: list = [None, None]


def scanner(block: Broadcast) -> Scanner:
    """The scanner of a block; a Python worker keeps the one it used last."""
    if _LAST[0] is not block:
        _LAST[:] = [block, Scanner(block.value)]
    return _LAST[1]


def _scan(rows: DataFrame, block: Broadcast, met_only: bool = False) -> DataFrame:
    """(key, n_words, hits, items) of ``rows`` (key, raw) by one block; with ``met_only`` of those
    that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(block).scan
        for batch in in_slices(batches):
            n_words, hits, items = [], [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                at, of = find(words)
                n_words.append(len(words))
                hits.append(at)
                items.append(sorted(of))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                [key, "n_words", "hits", "items"],
            )
            yield out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_())) if met_only else out

    key, kind = rows.dtypes[0]
    return rows.mapInArrow(run, f"{key} {kind}, n_words long, hits array<int>, items array<long>")


def _mark(raw):  # noqa: ANN001, ANN202
    return F.unhex(F.sha2(raw, 256))


def _hits_of_texts(raws: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """(mark, hits, items) of the texts ``raws`` (raw) that are hit, by the digest of the text; the
    blocks are scanned one after the other, so a task holds one of them."""
    parts = [_scan(raws.select(_mark("raw").alias("mark"), "raw"), b, met_only=True) for b in blocks]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # equal texts have equal hits, so a set holds one list a block
    merged = union.groupBy("mark").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "items")))
    return materialise(merged, "hits")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items): for every row of ``docs`` the positions of its words that
    lie inside a benchmark window, ascending, and the items that have an occurring window.

    Null or empty texts have no words and no hits; a null id stays null; repeated rows are
    reported one by one; further columns of any name in either table are ignored; with an empty
    benchmark nothing is hit, and an empty ``docs`` gives no rows.
    """
    blocks = blocks_of(windows_of(benchmark, n))
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    if len(blocks) == 1:
        return _scan(cols, blocks[0])
    found = _hits_of_texts(cols, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(words_of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), batch.column(2)], ["doc_id", "n_words", "mark"])

    counted = cols.withColumn("mark", _mark("raw")).mapInArrow(run, "doc_id long, n_words long, mark binary")
    none = {"hits": F.coalesce("hits", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<long>"))}
    return counted.join(found, "mark", "left").withColumns(none).select("doc_id", "n_words", "hits", "items")


def remove_words(raw: bytes, positions: list[int]) -> bytes:
    """The text without the words at ``positions``: consecutive ones go with what lies between."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    out, at, last = [], 0, -2
    for p in positions:
        start, end = spans[p]
        if p != last + 1:
            out.append(raw[at:start])
        at, last = end, p
    return b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents (``mode="documents"``), or with only the
    contaminated spans cut from their texts (``mode="spans"``): all words that lie in an occurrence
    of a window, and what stands between them.

    All columns are kept as they are.  Null and empty texts are never contaminated; ids don't
    matter, and repeated rows are judged one by one; an empty table or benchmark changes nothing.
    With a benchmark of one block documents are filtered where they are read, without a shuffle; of
    several blocks, only texts that may be hit are shuffled.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    if not isinstance(schema[at].dataType, T.StringType):
        raise TypeError(f"{text_col} must be a string")
    spans = mode == "spans"
    blocks = blocks_of(windows_of(benchmark, n))
    names, first = docs.columns, blocks[0]

    def cut(batch: pa.RecordBatch, hits: list[np.ndarray]) -> pa.RecordBatch:
        texts = batch.column(at)
        out = [remove_words(t.encode("utf-8", "replace"), h.tolist()).decode("utf-8", "replace") if len(h) else t for t, h in zip(texts.to_pylist(), hits, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out, texts.type) if i == at else batch.column(i) for i in range(len(names))], names=names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(first).scan
        for batch in in_slices(batches):
            hits = [find(words_of((t.as_py() or "").encode("utf-8", "replace")))[0] for t in batch.column(at)]
            yield cut(batch, hits) if spans else batch.filter(pa.array([not len(h) for h in hits], pa.bool_()))

    if len(blocks) == 1:
        return docs.mapInArrow(clean, schema)
    found = _hits_of_texts(docs.select(utf8(text_col).alias("raw")), blocks)
    mark, where = fresh(docs, "_mark"), fresh(docs, "_hits")
    marked, marks = docs.withColumn(mark, _mark(utf8(text_col))), found.select(F.col("mark").alias(mark))
    others = rows_without(marked, mark, marks).drop(mark)
    if not spans:
        return others

    def clean_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield cut(batch, [np.asarray(x.values) for x in batch.column(len(names))])

    met = rows_with(marked, mark, marks).join(found.select(F.col("mark").alias(mark), F.col("hits").alias(where)), mark)
    return others.unionByName(met.select(*docs.columns, where).mapInArrow(clean_met, schema))
