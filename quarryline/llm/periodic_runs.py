"""Periodic runs: stretches of a text that repeat the same words again and again.

A run is a stretch of words with smallest period q, at least twice as long as q, that neither
neighbour extends.  Runs are found at several scales, all of them, whatever the text:

* Periods below ``2 * FIRST`` are too short for windows; each such lag is scanned directly.
* At a scale of ``width`` words, for periods from twice to below four times the width, every word
  starts a gram of ``width`` words.  The grams with the smallest hash of a window are minimizers.
  Inside a run, the windows one period apart hold the same grams, so they have the same minimizer:
  pairs of equal minimizers at a distance of the scale are the seeds, which are extended word by
  word in both directions.
* A gram that has itself a period of a third of its length at most is no minimizer: there would be
  as many pairs as the square of the stretch that it is in.  What is lost by that is a run of which
  one period is all inside a run A of a shorter period p, and the next inside another run B of the
  same period that touches A.  Such runs have lags that are p apart, and are listed from A and B.

So the work is near linear in the words, also in texts that repeat a word a million times.
Many texts are one sequence, longest first, with a word of its own between each two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import in_slices

#: Words that a run has at least.
LEAST = 12
#: The smallest scale, a power of two; shorter periods than twice as many words are scanned.
FIRST = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NEVER = np.uint64(2**63)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, lengths, periods


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every ``width`` neighbours, a power of two."""
    step = 1
    while step < width:
        x = op(x[:-step], x[step:])
        step *= 2
    return x


def scanned(w: np.ndarray, q: int) -> Runs:
    """The runs of one lag, by comparing every word with the one that far on."""
    same = np.zeros(max(0, len(w) - q) + 2, np.int8)
    same[1:-1] = w[: len(same) - 2] == w[q : q + len(same) - 2]
    edge = np.flatnonzero(np.diff(same))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    keep = sizes >= q
    return starts[keep], sizes[keep] + q, np.full(int(keep.sum()), q)


def _forward(w: np.ndarray, x: int, q: int) -> int:
    """The first place from ``x`` on whose word differs from the one ``q`` later."""
    size, n = 64, len(w) - q
    while x < n:
        same = w[x : min(x + size, n)] == w[x + q : min(x + size, n) + q]
        if not same.all():
            return x + int(np.argmin(same))
        x, size = x + len(same), size * 2
    return n


def _backward(w: np.ndarray, x: int, q: int) -> int:
    """The first place of the equal words that end before ``x``."""
    size = 64
    while x > 0:
        low = max(0, x - size)
        same = (w[low:x] == w[low + q : x + q])[::-1]
        if not same.all():
            return x - int(np.argmin(same))
        x, size = low, size * 2
    return 0


def seeds(grams: np.ndarray, width: int, excluded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lags, places): the pairs of equal minimizers at a lag of this scale."""
    key = grams >> np.uint64(1)
    key[excluded] = _NEVER
    edge = np.zeros(width - 1, np.uint64)
    lowest = np.concatenate([edge, _sliding(key, width, np.minimum), edge])
    at = np.flatnonzero((_sliding(lowest, width, np.maximum) == key) & (key < _NEVER))
    order = np.argsort(key[at], kind="stable")
    at = at[order]
    value = key[at]
    lags, places = [], []
    left, j = np.arange(len(at)), 1
    while len(left):
        left = left[left + j < len(at)]
        lag = at[left + j] - at[left]
        near = (value[left] == value[left + j]) & (lag < 4 * width)
        left, lag = left[near], lag[near]
        lags.append(lag[lag >= 2 * width])
        places.append(at[left[lag >= 2 * width]])
        j += 1
    if not lags:
        return at, at
    lag, place = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def extended(w: np.ndarray, lags: np.ndarray, places: np.ndarray) -> Runs:
    """The runs that seeds, in order of lag and place, are in."""
    out, last, until = [], 0, 0
    for q, x in zip(lags.tolist(), places.tolist(), strict=True):
        if q == last and x < until:
            continue
        last, until = q, _forward(w, x, q)
        first = _backward(w, x, q)
        if until - first >= q:
            out.append((first, until - first + q, q))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def families(w: np.ndarray, runs: Runs) -> Runs:
    """The runs between two touching runs A and B of the same period p, with lags of 2 p at least."""
    start, size, period = (x[np.lexsort((runs[0], runs[2]))] for x in runs)
    end = start + size
    wide = size >= np.maximum(2 * FIRST, 6 * period)
    touching = wide[:-1] & wide[1:] & (period[:-1] == period[1:]) & (end[:-1] >= start[1:]) & (end[:-1] - start[1:] < period[1:])
    out: list[np.ndarray] = []
    for k in np.flatnonzero(touching).tolist():
        p, (a, a_end), (b, b_end) = int(period[k]), (int(start[k]), int(end[k])), (int(start[k + 1]), int(end[k + 1]))
        tail, head = w[a_end - 2 * p : a_end].tobytes(), w[b : b + p].tobytes()
        at = tail.find(head)
        while at >= 0 and at % w.itemsize:
            at = tail.find(head, at + 1)
        if at < 0:
            continue
        phase = (b - (a_end - 2 * p + at // w.itemsize)) % p
        least = max(2 * FIRST, 2 * p)
        q = np.arange(least + (phase - least) % p, min(a_end - a, b_end - b) + 1, p)
        first, until = np.maximum(a, b - q), np.minimum(a_end, b_end - q)
        # only where both ends meet may the words go on being equal
        for i in np.flatnonzero((first == a) & (first == b - q)).tolist():
            first[i] = _backward(w, int(first[i]), int(q[i]))
        for i in np.flatnonzero((until == a_end) & (until == b_end - q)).tolist():
            until[i] = _forward(w, int(until[i]), int(q[i]))
        keep = until - first >= q
        out.append(np.stack([first, until - first + q, q])[:, keep])
    found = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
    return found[0], found[1], found[2]


def _distinct(parts: list[Runs]) -> Runs:
    """Each stretch once, with its smallest period."""
    start, size, period = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((period, size, start))
    start, size, period = start[order], size[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    return start[new], size[new], period[new]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of the rows whose words, as numbers from 0 on, follow
    one another; by row, start and period."""
    order = np.argsort(-sizes, kind="stable")
    held = sizes[order]
    place = np.cumsum(held + 1) - (held + 1)
    within = np.arange(len(words)) - np.repeat(np.cumsum(held) - held, held)
    w = np.empty(len(words) + len(sizes), np.int64)
    w[np.repeat(place, held) + within] = words[np.repeat((np.cumsum(sizes) - sizes)[order], held) + within]
    w[place + held] = -1 - np.arange(len(sizes))
    parts = [scanned(w, q) for q in range(1, 2 * FIRST)]
    parts = [_distinct(parts)]
    parts.append(families(w, parts[0]))
    grams, k, width = _mixed((w + 1).astype(np.uint64) * _MULTIPLIER), 1, FIRST
    while rows := int(np.searchsorted(-held, -4 * width, "right")):
        size = int(place[rows - 1] + held[rows - 1] + 1)
        while k < width:
            grams = grams[: size - k + 1]
            grams = _mixed(grams[:-k] * _MULTIPLIER + grams[k:])
            k *= 2
        start, length, period = (np.concatenate([p[i] for p in parts]) for i in range(3))
        inner = (3 * period <= width) & (length >= width) & (start + length <= size)
        change = np.bincount(start[inner], minlength=len(grams) + 1) - np.bincount((start + length)[inner] - width + 1, minlength=len(grams) + 1)
        found = extended(w[:size], *seeds(grams, width, np.cumsum(change)[: len(grams)] > 0))
        parts += [found, families(w, _distinct([found]))]
        width *= 2
    start, length, period = _distinct(parts)
    keep = length >= np.maximum(least, 2 * period)
    start, length, period = start[keep], length[keep], period[keep]
    at = np.searchsorted(place, start, "right") - 1
    row, start = order[at], start - place[at]
    by = np.lexsort((period, start, row))
    return row[by], start[by], length[by], period[by]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(np.asarray(full))])
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    return flat.filter(full), np.diff(counts[offsets])


_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` are all runs of at least ``least`` words and two periods, by start and period, in word
    numbers from 0; words are what ASCII white space separates, as they are written.  ``collapsed``
    is the text without the words that follow a run's first period inside it, joined by one space.
    A null, empty or blank text has no words, no runs and an empty ``collapsed``.  A null id stays
    null, repeated rows are taken one by one, further columns are ignored, an empty table gives none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            words, sizes = _words(part.column(1))
            coded = words.dictionary_encode()
            row, start, length, period = runs_of(np.asarray(coded.indices).astype(np.int64), sizes, least)
            ends = np.cumsum(sizes)
            first = (ends - sizes)[row] + start
            change = np.bincount(first + period, minlength=len(words) + 1) - np.bincount(first + length, minlength=len(words) + 1)
            kept = np.cumsum(change)[: len(words)] == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            left = pa.ListArray.from_arrays(pa.array(before[np.concatenate([[0], ends])], pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pc.binary_join(left, " ")],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, f"doc_id long, {_OUT}")
