"""Hard negatives of embeddings, by exact integer inner products.

Every anchor is scored against every row.  Vectors become whole numbers, so scores are exact and
ties are ties.  Anchors are dealt to tiles and rows to blocks; a task holds one tile of anchors and
lets the rows of one block stream past it, a tile of candidates at a time.  The two tiles are
multiplied by Strassen's recursion: seven products of half the size in place of eight, with odd
sizes padded by zeros, down to leaves that are multiplied directly.  Whole numbers of 64 bits lose
nothing by its additions, as sums wrap around and come back.

What a task keeps of its scores are heaps of bounded size: for each anchor its best positives, and,
in a second pass, when those are known over all blocks, for each anchor and positive the best
negatives of the window of scores that the positive opens.  Heaps of two blocks merge to the heap of
both, so blocks need not see one another.  The first pass only compares rows of one label, the
second all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialise

#: Anchors in a tile and rows in a block, on average, and candidates that are multiplied at once.  What
#: is shuffled of n rows with m anchors is about n m / TILE + n m / BLOCK vectors.
TILE, BLOCK, STRIP = 4096, 8192, 512
#: Size below which Strassen's recursion multiplies directly.
LEAF = 32
#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Whole components of at least this size can't be multiplied within 64 bits.
LARGEST = 2**26


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of whole numbers, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    (i, j, h) = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    top = strassen(a11 + a12, b22, leaf)
    down = strassen(a21 - a11, b11 + b12, leaf)
    up = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:i, :h] = both + left - top + up
    out[:i, h:] = right + top
    out[i:, :h] = low + left
    out[i:, h:] = both - low + right + down
    return out


class Heaps:
    """The best ``size`` entries of each of many owners: highest score first, ties by smaller id."""

    def __init__(self, owners: int, size: int) -> None:
        self.size = size
        self.scores, self.ids = np.zeros((owners, size), np.int64), np.zeros((owners, size), np.int64)
        self.filled = np.zeros(owners, np.int64)

    def may_enter(self, scores: np.ndarray) -> np.ndarray:
        """Which of the scores (owners x candidates) are no worse than their owner's last entry."""
        return (self.filled < self.size)[:, None] | (scores >= self.scores[:, -1:])

    def push(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds entries, no entry twice."""
        if not len(owner):
            return
        touched = np.unique(owner)
        slot = np.arange(self.size)[None, :] < self.filled[touched][:, None]
        owner = np.concatenate([owner, np.broadcast_to(touched[:, None], slot.shape)[slot]])
        score = np.concatenate([score, self.scores[touched][slot]])
        ids = np.concatenate([ids, self.ids[touched][slot]])
        order = np.lexsort((ids, np.invert(score), owner))
        owner, score, ids = owner[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        best = rank < self.size
        self.scores[owner[best], rank[best]], self.ids[owner[best], rank[best]] = score[best], ids[best]
        self.filled[touched] = np.minimum(np.diff(np.append(first, len(owner))), self.size)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, id, score) of all entries."""
        owner, slot = np.nonzero(np.arange(self.size)[None, :] < self.filled[:, None])
        return owner, self.ids[owner, slot], self.scores[owner, slot]


def whole_vectors(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part, one of each id: ``v`` as whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < (LARGEST // scale)))
    rows = rows.where("id is not null and label is not null and v is not null").where(finite)
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    return materialise(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "whole-vectors")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The rows as one matrix, shorter vectors padded with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.asarray(vectors.flatten())
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of any widths."""
    width = min(a.shape[1], b.shape[1])
    return strassen(a[:, :width], np.ascontiguousarray(b[:, :width].T))


def _deal(anchors: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Anchors (side 0) before rows (side 1), for each group, tile and block.

    A tile's anchors are copied to all blocks of their group, and a row to all of its tiles, so a
    task's share is bounded however many rows a group has.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).join(anchors.groupBy(group).agg(F.count("*").alias("m")), group)
    sizes = materialise(sizes.select(group, F.ceil(F.col("m") / TILE).cast("int").alias("tiles"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "grid")
    tile = F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    every = {"tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
    key = [F.col(group).alias("group"), "tile", "block"]
    own = anchors.join(sizes, group).withColumn("tile", tile).withColumn("block", every["block"])
    met = rows.join(sizes, group).withColumn("block", block).withColumn("tile", every["tile"])
    dealt = own.select(*key, F.lit(0).alias("side"), "id", "label", "v", "opened").unionByName(met.select(*key, F.lit(1).alias("side"), "id", "label", "v", F.lit(None).cast("array<struct<id:long,score:long>>").alias("opened")))
    return dealt.repartition("group", "tile", "block").sortWithinPartitions("group", "tile", "block", "side", "id")


Tile = tuple[np.ndarray, np.ndarray, np.ndarray, list]  # ids, labels, vectors, opened


def _tiles(batches: Iterator[pa.RecordBatch], strip: int) -> Iterator[tuple[tuple, int, Tile]]:
    """(key, side, tile): the rows of one key and side, in strips."""
    for batch in batches:
        keys = [np.asarray(batch.column(k).cast(pa.int64())) for k in range(4)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else np.zeros(0, int)
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            for at in range(low, high, strip):
                part = batch.slice(at, min(strip, high - at))
                *key, side = (int(k[at]) for k in keys)
                yield tuple(key), side, (np.asarray(part.column(4)), np.asarray(part.column(5)), _matrix(part.column(6)), part.column(7).to_pylist() if not side else [])


def _joined(tiles: list[Tile]) -> Tile:
    width = max(t[2].shape[1] for t in tiles)
    wide = [np.pad(t[2], ((0, 0), (0, width - t[2].shape[1]))) for t in tiles]
    return np.concatenate([t[0] for t in tiles]), np.concatenate([t[1] for t in tiles]), np.concatenate(wide), [o for t in tiles for o in t[3]]


def _streamed(meet: Callable[[Tile], tuple[Callable[[Tile], None], Callable[[], pa.RecordBatch]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lets the candidates of each key pass its anchors; ``meet`` makes what takes them and what ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, take, end = None, [], None, None
        for key, side, tile in _tiles(batches, STRIP):
            if key != current:
                if end:
                    yield end()
                current, held, take, end = key, [], None, None
            if not side:
                held.append(tile)
            elif held or take:
                if not take:
                    take, end = meet(_joined(held))
                    held = []
                take(tile)
        if end:
            yield end()

    return run


def _positives(size: int) -> Callable[[Tile], tuple]:
    def meet(anchors: Tile) -> tuple:
        heaps = Heaps(len(anchors[0]), size)

        def take(tile: Tile) -> None:
            score = _product(anchors[2], tile[2])
            i, j = np.nonzero(heaps.may_enter(score) & (anchors[1][:, None] == tile[1]) & (anchors[0][:, None] != tile[0]))
            heaps.push(i, score[i, j], tile[0][j])

        def end() -> pa.RecordBatch:
            owner, ids, score = heaps.entries()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchors[0][owner], ids, score)], ["anchor_id", "positive_id", "positive_score"])

        return take, end

    return meet


def _negatives(size: int, low: int, high: int) -> Callable[[Tile], tuple]:
    """A heap for each anchor and positive; its window is low * positive <= 100 * negative <= high * positive."""

    def meet(anchors: Tile) -> tuple:
        opened = [(i, o["id"], o["score"]) for i, found in enumerate(anchors[3]) for o in found or []]
        at, positive, score_of = (np.array([o[k] for o in opened], np.int64) for k in range(3))
        # 100 * score may pass 64 bits, so the bounds are taken of Python's numbers
        first = np.array([-(-low * s // 100) for s in score_of.tolist()], np.int64)
        last = np.array([high * s // 100 for s in score_of.tolist()], np.int64)
        heaps = Heaps(len(opened), size)

        def take(tile: Tile) -> None:
            score = _product(anchors[2], tile[2])
            other = anchors[1][:, None] != tile[1]
            for k in range(0, len(opened), STRIP):
                part = at[k : k + STRIP]
                held = score[part]
                fits = other[part] & (held >= first[k : k + STRIP, None]) & (held <= last[k : k + STRIP, None])
                full = heaps.filled[k : k + STRIP] == size
                fits &= ~full[:, None] | (held >= heaps.scores[k : k + STRIP, -1:])
                i, j = np.nonzero(fits)
                heaps.push(i + k, held[i, j], tile[0][j])

        def end() -> pa.RecordBatch:
            owner, ids, score = heaps.entries()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (anchors[0][at[owner]], positive[owner], score_of[owner], ids, score)],
                ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
            )

        return take, end

    return meet


def _merged(found: DataFrame, owner: list[str], ids: str, score: str, size: int) -> DataFrame:
    """The heaps of all blocks as one: the first ``size`` of each owner, with their rank."""
    order = Window.partitionBy(*owner).orderBy(F.desc(score), ids)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on a column ``id``; ``label`` says what a row's label is, the
    column ``label`` by default.  A score is the inner product of ``floor(scale * x)`` of the
    components.  An anchor's positives are the first ``n_positives`` other rows of its label, by
    score, ties by smaller id; for each, the first ``n_negatives`` rows of another label whose score
    is within ``window``, in hundredths of the positive's, are its negatives, ranked from 1.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no part,
    nor do those with a component of 2**26 or more after scaling, whose scores 64 bits may not hold.
    Rows that repeat an id are one row, the smallest by label and vector.  Of vectors of different
    lengths the shorter one is filled up with zeros; an empty one scores 0 with all.  Anchors without
    positives, and positives without negatives, have no rows; further columns are ignored; an empty
    table gives none.
    """
    label = F.col("label") if label is None else label
    rows = whole_vectors(vectors, label, id_col, vector_col, scale)
    anchors = rows.where(is_anchor)
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    found = _deal(anchors.withColumn("opened", none), rows, "label").mapInArrow(_streamed(_positives(n_positives)), "anchor_id long, positive_id long, positive_score long")
    best = _merged(found, ["anchor_id"], "positive_id", "positive_score", n_positives)
    opened = best.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("opened"))
    opened = materialise(opened, "positives")
    whole = rows.withColumn("all", F.lit(0))
    asked = whole.join(opened, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    found = _deal(asked, whole, "all").mapInArrow(_streamed(_negatives(n_negatives, *window)), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _merged(found, ["anchor_id", "positive_id"], "negative_id", "negative_score", n_negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
