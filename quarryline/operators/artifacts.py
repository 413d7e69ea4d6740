"""Duplicate text artifacts: exact after line normalisation, and near ones by sequence similarity."""

from __future__ import annotations

import io
import tokenize
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.lineage import components
from quarryline.sources.scratch import written

#: Similarity of near-duplicates.
SIMILAR = 0.95
#: Characters of a shingle, bands of min-hashes, and min-hashes in each.  Where one character in twenty
#: differs, spread evenly, shingle sets have a Jaccard index of 0.6, and share none of the bands with a
#: probability of 0.003; changes that lie together leave a higher index.
SHINGLE, BANDS, ROWS = 5, 24, 3
#: Min-hashes, of all, that a pair has to agree in to be compared: at a Jaccard index of 0.6 fewer agree
#: with a probability of 1e-6.
LEAST_AGREED = 23

#: Characters of the shortest common runs that are listed at first; runs that are listed in any case, and for
#: each character; product of the lengths up to which two parts are left to difflib.
RUN, LEAST_LISTED, LISTED, SMALL = 32, 1 << 20, 8, 1 << 10

_SEEDS = np.random.default_rng(17).integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE)], np.uint64)


def standard_lines(text: Column) -> Column:
    """The text with plain line ends, no white space at line ends, no empty lines at both ends."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]+(?=\n|$)", ""), "\n")
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def comment_free(code: str) -> str:
    """Python source without its comments; ``#`` inside strings stays.  Source that can't be split
    into tokens only loses the lines that begin with ``#``."""
    lines = code.splitlines(keepends=True)
    try:
        comments = [t.start for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return "".join(line for line in lines if not line.lstrip().startswith("#"))
    # a comment reaches to the end of its line, so a line has one at most; the tokenizer ends lines at \n only
    lines = code.split("\n")
    for row, column in comments:
        lines[row - 1] = lines[row - 1][:column]
    return "\n".join(lines)


def without_comments(files: DataFrame, text: str) -> DataFrame:
    """``files`` with the comments of the Python sources in a column left out, null as null."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            plain = pa.array([None if x is None else comment_free(x) for x in batch.column(k).to_pylist()], batch.column(k).type)
            yield pa.RecordBatch.from_arrays([plain if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return files.mapInArrow(strip, files.schema)


def exact_groups(files: DataFrame, name: str, text: str) -> DataFrame:
    """(name, primary, size) of the artifacts that equal another one; the smallest name of each
    group is its primary.  Sizes and primaries are pre-aggregated by digest."""
    hashed = files.select(F.col(name).alias("name"), F.sha2(standard_lines(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256).alias("h"))
    # digests are made once, and the groups written, so that a hot one can be split in the join
    hashed = written(hashed, "digests")
    groups = written(hashed.groupBy("h").agg(F.min("name").alias("primary"), F.count("*").alias("size")).where("size > 1"), "groups")
    return hashed.join(groups, "h").select("name", "primary", "size")


def bands_of(body: str) -> tuple[np.ndarray, bytes]:
    """A number for each band of the min-hashes of a text's character shingles, and a byte of each of
    these hashes."""
    points = np.frombuffer(body.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = max(1, len(points) - SHINGLE + 1)
    h = np.zeros(size, np.uint64)
    for k in range(min(SHINGLE, len(points))):
        h += points[k : k + size] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h = np.unique(h * np.uint64(0xBF58476D1CE4E5B9))
    h ^= h >> np.uint64(31)
    product, least = np.empty_like(h), np.empty(BANDS * ROWS, np.uint64)
    for k, seed in enumerate(_SEEDS):
        least[k] = np.multiply(h, seed, out=product).min()
    least = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out + least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64), least.astype(np.uint8).tobytes()


def common_order(x: str, y: str, least: int = 0) -> int:
    """The length of the longest common subsequence: difflib never matches more characters.  -1 as soon as it
    is certain to be less than ``least``.  A bit of an integer stands for each place of ``x``."""
    if least > min(len(x), len(y)):
        return -1
    points, places = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), {}
    full = (1 << len(x)) - 1
    row, ahead = full, len(x) - least
    for k, c in enumerate(y, 1):
        if c not in places:
            places[c] = int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little")
        if both := row & places[c]:
            row = (row + both | row - both) & full
        # what is matched of y[:k] is in x[: k + ahead], else too much of x is not
        if not k & 63:
            until = min(len(x), k + ahead)
            if k - until + (row & (1 << until) - 1).bit_count() > len(y) - least:
                return -1
    return len(x) - row.bit_count()


def beginnings(a: np.ndarray, b: np.ndarray, before_a: np.ndarray, before_b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(i, j) of all pairs of places with a[i] = b[j] but not before_a[i] = before_b[j], None if they are more
    than ``most``.  The places of a value in ``b`` are in order of what is before them, so those left out are
    one range: texts of repetitions make as many pairs as they have runs, not places."""
    kinds = 1 + int(max(before_a.max(initial=0), before_b.max(initial=0)))
    key = b * kinds + before_b
    order = np.argsort(key, kind="stable")
    line, mine = key[order], a * kinds + before_a
    bounds = [np.searchsorted(line, x) for x in (a * kinds, mine, mine + 1, (a + 1) * kinds)]
    if sum(int((bounds[k + 1] - bounds[k]).sum()) for k in (0, 2)) > most:
        return None
    i, j = [], []
    for low, high in (bounds[:2], bounds[2:]):
        n = high - low
        i.append(np.repeat(np.arange(len(a)), n))
        j.append(order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(i), np.concatenate(j)


def common_runs(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray | None:
    """Rows (start in x, end in x, start in y less that in x) of all common runs of at least ``size`` places
    that can't be made longer; None if they are more than LEAST_LISTED, and than LISTED for each place."""
    letters, width = np.unique(np.concatenate([x, y]), return_inverse=True)[1], 1
    ranks = letters
    while width < size:
        step = min(width, size - width)
        ranks, width = np.unique(ranks[: len(ranks) - step] * (len(x) + len(y)) + ranks[step:], return_inverse=True)[1], width + step
    # runs across the end of x are no runs
    a, b = ranks[: max(0, len(x) - size + 1)], ranks[len(x) :]
    if not len(a) or not len(b):
        return np.zeros((0, 3), np.int64)
    ends = []
    for back in (False, True):
        around = []
        for k, (line, of) in enumerate(((letters[: len(x)], a), (letters[len(x) :], b))):
            # the letter before each place, or behind it; another one at the ends of both texts
            other = np.full(len(of), k, np.int64)
            if back:
                other[:-1] = line[size:][: len(of) - 1] + 2
            else:
                other[1:] = line[: len(of) - 1] + 2
            around.append(other)
        met = beginnings(a, b, *around, max(LEAST_LISTED, LISTED * (len(x) + len(y))))
        if met is None:
            return None
        i, d = met[0], met[1] - met[0]
        at = np.lexsort((i, d))
        ends.append((i[at], d[at]))
    return np.array([ends[0][0], ends[1][0] + size, ends[0][1]]).T


def matching(x: str, y: str, most_lost: float, size: int = RUN) -> int | None:
    """How many characters difflib matches: those of the longest common run, the first in ``x`` and then in
    ``y``, and of what lies before it and behind it on both sides.  None if more than ``most_lost`` of the
    shorter text are not.

    The longest run of two parts is told by a list of all runs of at least ``size``, cut to the parts.
    Parts without any are searched for shorter ones, and small ones are left to difflib itself, as are those
    that have too many runs to list and none of the length from which they are few.
    """
    if size > 1 and len(x) * len(y) > SMALL:
        least = max(0, ceil(min(len(x), len(y)) - most_lost))
        if size < RUN // 4 and common_order(x, y, least) < least:
            return None
        points = [np.frombuffer(z.encode("utf-32-le", "surrogatepass"), np.uint32) for z in (x, y)]
        runs, least = common_runs(*points, size), size
        while runs is None and least < min(len(x), len(y)):
            least *= 2
            runs = common_runs(*points, least)
    if size < 2:
        found, at = 0, -1  # no two characters in a row are common: each goes with the first one behind the last
        for c in x:
            if (next_ := y.find(c, at + 1)) >= 0:
                found, at = found + 1, next_
        return found if min(len(x), len(y)) - found <= most_lost else None
    if len(x) * len(y) <= SMALL or runs is None or (least > size and not len(runs)):
        found = sum(block.size for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        return found if min(len(x), len(y)) - found <= most_lost else None
    found, todo = 0, [(0, len(x), 0, len(y), runs)]
    while todo:
        i, until_i, j, until_j, runs = todo.pop()
        low, high = np.maximum(np.maximum(runs[:, 0], i), j - runs[:, 2]), np.minimum(np.minimum(runs[:, 1], until_i), until_j - runs[:, 2])
        fits = high - low >= least
        if not fits.any():
            n = matching(x[i:until_i], y[j:until_j], most_lost, size // 4 if least == size else size)
            if n is None:
                return None
            most_lost -= min(until_i - i, until_j - j) - n
            found += n
            continue
        runs, low, high = runs[fits], low[fits], high[fits]
        longest = np.flatnonzero(high - low == (high - low).max())
        best = longest[np.lexsort((runs[longest, 2], low[longest]))[0]]
        begin, end, d = int(low[best]), int(high[best]), int(runs[best, 2])
        found += end - begin
        parts = [(i, begin, j, begin + d, runs), (end, until_i, end + d, until_j, runs)]
        # what the longer side of each part has more than the shorter one can't be matched
        most_lost -= min(until_i - i, until_j - j) - (end - begin) - sum(min(p[1] - p[0], p[3] - p[2]) for p in parts)
        if most_lost < 0:
            return None
        todo += [p for p in parts if p[0] < p[1] and p[2] < p[3]]
    return found


def similarity(x: str, y: str, threshold: float) -> float | None:
    """difflib's ratio of two texts, without its junk; None if it is below the threshold."""
    both, shorter = len(x) + len(y), min(len(x), len(y))
    most_lost = shorter - threshold * both / 2 + 0.5
    least = max(0, ceil(shorter - most_lost))
    if 2.0 * shorter / both < threshold or common_order(x, y, least) < least:
        return None
    found = matching(x, y, most_lost)
    return None if found is None or 2.0 * found / both < threshold else 2.0 * found / both


def near_pairs(files: DataFrame, name: str, text: str, threshold: float = SIMILAR, code: bool = False) -> DataFrame:
    """(a, b, similarity) of artifacts that aren't equal but similar: twice the matching characters over
    all characters, white space left out, and with ``code`` the comments of Python sources.

    Texts that share a band of min-hashes are a bucket.  Its smallest name is compared with the others,
    and the links found make components.  In a bucket of several components the members outside the
    largest are then compared with all members of other components, so no link between texts of one
    bucket is lost that joins two components, and members of one group don't all meet one another.
    Texts whose lengths rule the similarity out are not compared, and neither are those that agree in
    fewer than LEAST_AGREED of their min-hashes, so whole texts only travel for likely pairs.
    """
    rows = files.select(F.col(name).alias("name"), standard_lines(F.coalesce(F.col(text), F.lit(""))).alias("plain"))
    rows = (without_comments(rows, "plain") if code else rows).withColumn("plain", F.regexp_replace("plain", r"(?U)\s+", ""))
    once = written(rows.groupBy("plain").agg(F.min("name").alias("name")).where("plain <> ''").withColumn("n", F.length("plain")), "artifacts")
    kind = dict(once.dtypes)["name"]

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.binary())], ["name", "n", "bands", "sig"])

    sketches = written(once.select("name", "plain", "n").mapInArrow(banded, f"name {kind}, n int, bands array<long>, sig binary"), "sketches")
    members = sketches.select("name", "n", F.explode("bands").alias("band"))
    left, right = once.select(F.col("name").alias("a"), F.col("plain").alias("x")), once.select(F.col("name").alias("b"), F.col("plain").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (r := similarity(x, y, threshold)) is not None:
                    out.append((a, b, r))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.column(0).type if i < 2 else pa.float64()) for i in range(3)], ["a", "b", "similarity"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_AGREED))

    def verified(pairs: DataFrame) -> DataFrame:
        one, other = sketches.select(F.col("name").alias("a"), F.col("sig").alias("x")), sketches.select(F.col("name").alias("b"), F.col("sig").alias("y"))
        pairs = written(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(likely, f"a {kind}, b {kind}"), "likely")
        return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}, similarity double"), "links")

    fits = F.least("n", "other_n") >= F.lit(threshold / 2) * (F.col("n") + F.col("other_n"))
    members = written(members, "bands")
    lead = members.groupBy("band").agg(F.min(F.struct("name", "n")).alias("lead"), F.count("*").alias("many")).where("many > 1").select("band", F.col("lead.name").alias("a"), F.col("lead.n").alias("other_n"))
    shared = written(members.join(written(lead, "leaders"), "band"), "buckets")
    first = written(shared.where("name <> a").where(fits).select("a", F.col("name").alias("b")).distinct(), "pairs")
    links = verified(first)
    known = components(links, "a", "b").select(F.col("node").alias("name"), "component")
    placed = written(shared.select("band", "name", "n").join(known, "name", "left").select("band", "name", "n", F.coalesce("component", "name").alias("comp")), "placed")
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("size")).groupBy("band").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
    open_ = written(placed.join(sizes.where("comps > 1").select("band", "main"), "band"), "open")
    outside = open_.where("comp <> main").select("band", F.col("name").alias("other"), F.col("n").alias("other_n"), F.col("comp").alias("other_comp"))
    met = outside.join(open_.drop("main"), "band").where("comp <> other_comp").where(fits)
    more = met.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    return links.unionByName(verified(written(more, "pairs")))


def near_groups(pairs: DataFrame) -> DataFrame:
    """(name, primary) of the artifacts linked by near pairs."""
    return components(pairs, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("primary"))
