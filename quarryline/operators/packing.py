"""Findings packed into batches: the most urgent first, as many as a batch's count and size allow.

A batch is filled until the next finding doesn't fit, so where it ends depends on where it began, and
that on all batches before.  But in any stretch of the order there are few places where a batch may
begin first: it began in the stretch before, and is no longer than the count allows.  So for each
stretch, on its own, the batches are walked from each of these places; what comes out is at which
place of the next stretch a batch begins first, and how many batches there were.  These small tables
are composed in order, and then each stretch knows its place and its number, and is walked once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.replay import with_positions
from quarryline.sources.scratch import written

#: Findings in a stretch of the order.
STRETCH = 100_000


def next_starts(sizes: np.ndarray, count: int, room: int) -> np.ndarray:
    """Where the batch that begins at each place ends: after ``count`` findings, or before the first
    that no longer has room; a finding that is too large is alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    fits = np.searchsorted(total, total[:-1] + room, "right") - 1
    return np.minimum(np.maximum(fits, at + 1), at + count)


def pack(findings: DataFrame, count: int, room: int, priority: Column, id_col: str = "id", size_col: str = "size", stretch: int = STRETCH) -> DataFrame:
    """(id, batch, place): ``batch`` from 0, and the place in it from 0.

    Findings for which ``priority`` holds come first, then by id, which has to be different and not
    null.  A batch has ``count`` findings and a sum of sizes of ``room`` at most, but for a finding
    that is larger by itself; a null or negative size counts as 0.  What leaves the tasks for the
    driver is ``count`` pairs of numbers for each ``stretch`` findings.
    """
    stretch = max(stretch, count)
    spark = findings.sparkSession
    order = F.struct((~F.coalesce(priority, F.lit(False))).alias("later"), F.col(id_col).alias("id"))
    rows = findings.select(order.alias("order"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    placed = with_positions(rows, "order").select("order.id", "size", "_pos")
    own = F.floor(F.col("_pos") / stretch).cast("long")
    # the first places of a stretch also belong to the one before, whose last batch may reach into them
    seen = F.when((F.col("_pos") % stretch < count) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = written(placed.select("id", "size", "_pos", F.explode(seen).alias("part")), "placed")
    parts = placed.repartition("part").sortWithinPartitions("part", "_pos")
    kind = dict(placed.dtypes)["id"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        current, ids, sizes = None, [], []
        for batch in batches:
            part = np.asarray(batch.column(3))
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if high == low:
                    continue
                if part[low] != current and current is not None:
                    yield current, pa.concat_arrays(ids), np.concatenate(sizes)
                    ids, sizes = [], []
                current = int(part[low])
                ids.append(batch.column(0).slice(low, high - low))
                sizes.append(np.asarray(batch.column(1))[low:high])
        if current is not None:
            yield current, pa.concat_arrays(ids), np.concatenate(sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, sizes in stretches(batches):
            ends, end = next_starts(sizes, count, room).tolist(), min(stretch, len(sizes))
            # from the back: what is known of the next batch's beginning holds for this one's
            out, n = [0] * len(sizes), [0] * len(sizes)
            for at in range(end - 1, -1, -1):
                to = ends[at]
                out[at], n[at] = (to - stretch, 1) if to >= end else (out[to], n[to] + 1)
            k = min(count, end)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([out[:k]], pa.list_(pa.int64())), pa.array([n[:k]], pa.list_(pa.int64()))], ["part", "out", "n"])

    found = {r["part"]: r for r in parts.mapInArrow(walk, "part long, out array<long>, n array<long>").collect()}
    starts, at, number = [], 0, 0
    for part in sorted(found):
        starts.append((part, at, number))
        at, number = (found[part]["out"][at], number + found[part]["n"][at]) if at < len(found[part]["out"]) else (0, number)
    first = F.broadcast(spark.createDataFrame(starts, "part long, first long, number long"))  # one row a stretch

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = {}

        def remember(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told.update(zip(batch.column(3).to_pylist(), zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True), strict=True))
                yield batch

        for part, ids, sizes in stretches(remember(batches)):
            at, number = told[part]
            ends, low, of, place = next_starts(sizes, count, room), at, [], []
            while at < min(stretch, len(sizes)):
                to = min(int(ends[at]), len(sizes))
                of.append(np.full(to - at, number))
                place.append(np.arange(to - at))
                at, number = to, number + 1
            if of:
                yield pa.RecordBatch.from_arrays([ids.slice(low, at - low), pa.array(np.concatenate(of), pa.int64()), pa.array(np.concatenate(place), pa.int64())], ["id", "batch", "place"])

    numbered = placed.join(first, "part").select("id", "size", "_pos", "part", "first", "number")
    return numbered.repartition("part").sortWithinPartitions("part", "_pos").mapInArrow(fill, f"id {kind}, batch long, place long")
