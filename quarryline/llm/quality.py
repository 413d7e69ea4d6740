"""Quality classifier: a factorisation machine over hashed words, the shape of the text and metadata.

A document is a sparse vector: its hashed words (damped counts, unit length), a few dense
statistics of its structure, and of the metadata the number of characters that the table states,
with how far it is off.  The machine has a weight for each feature and a short
vector for each; two features interact by the product of their vectors.  The sum over all pairs is
half of (square of the sum less sum of the squares), coordinate by coordinate, so a document is
scored in time linear in its features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import in_slices, utf8
from quarryline.llm.decontaminate import WORD_BYTES

#: Buckets of hashed words.
BUCKETS = 4096
#: Length of a feature's interaction vector.
RANK = 8
#: Labelled documents that training takes at most.  With the buckets above this bounds what the
#: driver gathers (at most 128 MB, in practice a tenth of that).
MAX_TRAINING_ROWS = 4000
#: Texts whose features a task holds at once.
SLICE = 128
#: Words whose bucket a Python worker remembers.
CACHE_WORDS = 100_000

STATISTICS = ("bytes", "words", "lines", "word_length", "upper", "digit", "symbol", "space", "distinct", "top_word", "repeated_next", "repeated_line", "marked_word", "wide", "stated", "misstated")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
#: Bytes of UTF-8 that don't begin a character.
_INSIDE = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_PLAIN = bytes(b for b in range(128) if chr(b).isalnum()) + _SPACE + b".,;'" + bytes(range(128, 256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = k = zlib.crc32(word) % BUCKETS
        return k


_BUCKET = _Buckets()


def features(raw: bytes, stated: int | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values, and the statistics, of a whole text; ``stated`` is the number of
    characters that the table states, and that of the text itself where it states none."""
    words = raw.translate(WORD_BYTES).split()
    n, size = len(words), max(1, len(raw))
    chars = len(raw.translate(None, _INSIDE))
    counts = Counter(map(_BUCKET.__getitem__, words))
    idx = np.fromiter(counts.keys(), np.int32, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(val):
        val /= np.sqrt(val @ val)
    parts = raw.split()
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    stats = [
        np.log1p(len(raw)),
        np.log1p(n),
        np.log1p(len(lines)),
        sum(map(len, words)) / max(1, n),
        share(_UPPER),
        share(_DIGIT),
        len(raw.translate(None, _PLAIN)) / size,
        share(_SPACE),
        len(counts) / max(1, min(n, BUCKETS)),
        max(counts.values(), default=0) / max(1, n),
        same / max(1, n),
        1 - len(set(lines)) / len(lines),
        sum(1 for p in parts if p[-1] in b"!#$%&*|") / max(1, len(parts)),
        share(bytes(range(128, 256))),
        np.log1p(max(0, chars if stated is None else stated)),
        0.0 if stated is None else abs(stated - chars) / max(1, chars, stated),
    ]
    return idx, val, stats


@dataclass
class Machine:
    """A trained factorisation machine; plain arrays, a few hundred kilobytes."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and row starts of a batch; statistics are standardised, cut at
        five spreads, and follow the buckets."""
        stats = np.clip((np.array([f[2] for f in found]) - self.mean) / self.spread, -5, 5)
        own = np.arange(BUCKETS, BUCKETS + len(STATISTICS), dtype=np.int32)
        idx = np.concatenate([x for f in found for x in (f[0], own)])
        val = np.concatenate([x for f, s in zip(found, stats, strict=True) for x in (f[1], s)])
        starts = np.cumsum([0] + [len(f[0]) + len(own) for f in found[:-1]])
        return idx, val, starts

    def margin(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        v = self.vectors[idx] * val[:, None]
        total = np.add.reduceat(v, starts, axis=0)
        pairs = 0.5 * (np.square(total) - np.add.reduceat(np.square(v), starts, axis=0)).sum(1)
        return self.bias + np.add.reduceat(self.weights[idx] * val, starts) + pairs

    def score(self, texts: Iterable[bytes], stated: Iterable[int | None] | None = None) -> np.ndarray:
        """A score for each text; features are held for SLICE texts at a time."""
        out, todo = [np.zeros(0)], iter(zip(texts, repeat(None) if stated is None else stated))  # noqa: B905
        while found := [features(raw, chars) for raw, chars in islice(todo, SLICE)]:
            out.append(1 / (1 + np.exp(-np.clip(self.margin(*self.rows(found)), -30, 30))))
        return np.concatenate(out)


def fit(found: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, Adam, fixed seed.  With no rows every score is one half."""
    size, rng = BUCKETS + len(STATISTICS), np.random.default_rng(seed)
    if not len(labels):
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    stats = np.array([f[2] for f in found])
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), stats.mean(0), np.maximum(stats.std(0), 1e-3))
    p = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(p / (1 - p)))
    params = np.concatenate([machine.weights[:, None], machine.vectors], axis=1)
    m, s, step = np.zeros_like(params), np.zeros_like(params), 0
    mb = sb = 0.0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            idx, val, starts = machine.rows([found[i] for i in chosen])
            machine.weights, machine.vectors = params[:, 0], params[:, 1:]
            v = machine.vectors[idx] * val[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            margin = machine.bias + np.add.reduceat(machine.weights[idx] * val, starts) + 0.5 * (np.square(total) - np.add.reduceat(np.square(v), starts, axis=0)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            of = np.repeat(np.arange(len(chosen)), np.diff([*starts, len(idx)]))
            grad = np.zeros_like(params)
            each = np.concatenate([(error[of] * val)[:, None], error[of][:, None] * val[:, None] * (total[of] - v)], axis=1)
            for k in range(RANK + 1):
                grad[:, k] = np.bincount(idx, each[:, k], size)
            grad += decay * params
            step += 1
            m += 0.1 * (grad - m)
            s += 0.001 * (np.square(grad) - s)
            params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            mb += 0.1 * (error.sum() - mb)
            sb += 0.001 * (error.sum() ** 2 - sb)
            machine.bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    machine.weights, machine.vectors = params[:, 0].copy(), params[:, 1:].copy()
    return machine


def held_out(doc_id: str = "doc_id", folds: int = 5):  # noqa: ANN201
    """Is crc32 of the id as text divisible by ``folds``?  False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def _stated(docs: DataFrame, size_col: str):  # noqa: ANN202
    """The stated number of characters; null where the table has no such column."""
    return (F.col(size_col) if size_col in docs.columns else F.lit(None)).cast("long").alias("stated")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size_col: str = "n_chars") -> Machine:
    """A machine learnt from the labelled rows that aren't held out.

    At most ``max_rows`` labelled ids are taken, in the order of a hash of the id, so the sample
    is the same at every run.  Their features are made by the executors; the driver gets one sparse
    vector an id.  Null labels and ids are left out; an id with several labels takes the highest,
    one with several texts the longest of them, and of these the last in order.
    """
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .where(~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).distinct().join(labelled, "_id")
    sample = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [features(x.as_py(), n) for x, n in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                ["_id", "_label", "idx", "val", "stats"],
            )

    # at most max_rows rows of two numbers are broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), utf8(text_col).alias("raw"), _stated(docs, size_col))
    taken = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max(F.struct(F.length("raw"), "raw", "stated")).alias("t"), F.max("_label").alias("_label")).select("_id", "t.raw", "_label", "t.stated")
    table = taken.mapInArrow(run, "_id long, _label int, idx array<int>, val array<float>, stats array<double>").toArrow()
    table = table.sort_by([("_id", "ascending")])
    found = [
        (np.asarray(i.values, np.int32), np.asarray(v.values, np.float64), list(s.as_py()))
        for i, v, s in zip(table["idx"], table["val"], table["stats"], strict=True)
    ]
    return fit(found, np.array(table["_label"].to_pylist(), np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``predicted`` is 1 where the score is at least ``threshold``.  Null and empty texts get the
    score of a text without words; a null id stays null and isn't held out; repeated rows are
    scored one by one; further columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            scores = shared.value.score((x.as_py() for x in batch.column(2)), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), utf8(text_col).alias("raw"), _stated(docs, size_col))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns as they are.

    Null and empty texts get the score of a text without words; ids don't matter, and repeated rows
    are judged one by one; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            stated = None if size is None else batch.column(size).to_pylist()
            scores = shared.value.score(((t.as_py() or "").encode("utf-8", "replace") for t in batch.column(at)), stated)
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
