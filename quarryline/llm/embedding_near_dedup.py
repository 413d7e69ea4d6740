"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Every unit vector is projected on ``PROJECTIONS`` random directions.  The other vectors are sorted
along each direction, and those inside a window centred on the query collide with it; the pairs
that collide often enough are verified by their exact cosine.  For a pair at the least cosine the
count is binomial, so the count asked for is the one that such a pair misses with a probability of
``MISS`` at most.

Vectors of one label that fit into a few blocks are all compared.  A larger label is first cut by
some of the projections: several of them, each cut into cells at a random offset, make a table, and
only vectors that share all cells of a table are compared.  How many projections a table has, and
how many tables there are, follows from the label's size alone: so many that a pair at the least
cosine shares none of the tables with a probability of LOST at most, and that unlike vectors seldom
meet.  The work of a label then grows far slower than the square of its size.

Groups are cut into blocks of bounded size, a task compares two blocks, and it returns only each
vector's number of links and the components among its vectors, never all pairs.  A pair that shares several
tables counts in the first of them.  Equal vectors are one class throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import connected_components, left_join_set, materialise

#: Directions that collisions are counted on.
PROJECTIONS = 64
#: Half of a window, in standard deviations of the projected difference of a pair at the least cosine.
WINDOW = 1.0
#: Probability with which a pair at the least cosine may miss the count.
MISS = 1e-6
#: Vectors in a block, on average.
BLOCK = 1000
#: Width of a cell, in standard deviations of the projected difference of a pair at the least cosine.
CELL = 6.0
#: Probability with which a pair at the least cosine may share none of its label's tables; as small
#: as that of the count, so that a large label loses no more than a small one.
LOST = 1e-6
#: Bytes of vectors, or cells, that are copied at once to verify pairs.
SLICE = 16 << 20
#: Projections that a table has at most, and comparisons that take as long as dealing out a copy.
DEEPEST, COPY = 32, 1000


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the least cosine reaches with probability 1 - miss."""
    p = math.erf(window / math.sqrt(2))
    below, count = 0.0, 0
    while True:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
        count += 1


def same_cell(width: float) -> float:
    """The probability that two values whose difference is normal with deviation 1 are in one cell
    of a width, cut at a random offset."""
    return math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def plan(members: int, least: float) -> tuple[int, int]:
    """(projections of a table, tables) of the least work for a label of so many vectors; (0, 1) is
    one table without a projection, in which all meet."""
    near, far = same_cell(CELL), same_cell(CELL * math.sqrt(2 - 2 * least) / math.sqrt(2))
    best = (members + COPY, 0, 1)
    for k in range(1, DEEPEST + 1):
        tables = math.ceil(math.log(LOST) / math.log1p(-(near**k)))
        best = min(best, (tables * (COPY + members * far**k), k, tables))
    return best[1:]


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """The Gaussian directions for the collisions."""
    return np.random.default_rng(1000 + dim).normal(size=(dim, PROJECTIONS))


@lru_cache(maxsize=8)
def cell_directions(dim: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The Gaussian directions of all tables and the offsets of their cells."""
    rng = np.random.default_rng(5000 + dim)
    return rng.normal(size=(tables * depth, dim)), rng.uniform(size=tables * depth)


def cells_of(units: np.ndarray, depth: int, tables: int, least: float) -> np.ndarray:
    """A number for each unit vector's cells in each table.  Sums are taken in one order however
    many vectors there are, so a vector has the same cells wherever they are found."""
    if not depth:
        return np.zeros((len(units), 1), np.int64)
    along, offset = cell_directions(units.shape[1], depth, tables)
    at = np.floor(np.einsum("ij,kj->ik", units, along, optimize=False) / (CELL * math.sqrt(2 - 2 * least)) + offset).astype(np.int64).view(np.uint64)
    at = at.reshape(len(units), tables, depth)
    out = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(units), tables)).copy()
    for k in range(depth):
        out = (out + at[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How many projections of each row of ``a`` have each row of ``b`` in their window."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    flat = counts.reshape(-1)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j]
        low, high = np.searchsorted(line, a[:, j] - half, "left"), np.searchsorted(line, a[:, j] + half, "right")
        sizes = high - low
        ends = np.cumsum(sizes)
        inside = np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])
        flat[np.repeat(np.arange(len(a)) * len(b), sizes) + order[inside]] += 1  # once for each pair
    return counts


def _slices(pairs: int, width: int) -> Iterator[slice]:
    """The pairs in slices for which ``width`` numbers a pair take SLICE bytes at most."""
    step = max(1, SLICE // (8 * max(1, width)))
    for at in range(0, pairs, step):
        yield slice(at, at + step)


def linked(a: np.ndarray, b: np.ndarray, least: float, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with cosine >= least, by counting and verification; ``exact`` verifies
    all pairs.  However many pairs are near, only a slice of their vectors is copied at once."""
    size_a, size_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if exact:
        i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    else:
        along = directions(a.shape[1])
        half = WINDOW * math.sqrt(2 - 2 * least)
        i, j = np.nonzero(collisions(a / size_a[:, None] @ along, b / size_b[:, None] @ along, half) >= least_count())
    near = np.zeros(len(i), bool)
    for part in _slices(len(i), 2 * a.shape[1]):
        x, y = i[part], j[part]
        near[part] = np.einsum("ij,ij->i", a[x], b[y]) / (size_a[x] * size_b[y]) >= least
    return i[near], j[near]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): each node of the links but the roots with the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _compare(table: int, depth: int, tables: int, rows: list[tuple[int, int, int, bytes]], least: float, exact: bool) -> Iterator[tuple[int, int | None, int | None]]:
    """Rows (side, rep, members, vector) of one or two blocks of a table's cell -> (rep, None,
    linked vectors) and (rep, rep, None) of a forest with their components, for pairs that meet here first."""
    sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
    own = not sides[1]
    left, right = sides[0], sides[0] if own else sides[1]
    if not left or not right:
        return
    a, b = (np.array([np.frombuffer(r[3], np.float64) for r in side]) for side in (left, right))
    i, j = linked(a, b, least, exact)
    if own:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        at, other = np.unique(i), np.unique(j)
        cells = [cells_of(x / np.linalg.norm(x, axis=1, keepdims=True), depth, tables, least)[:, :table] for x in (a[at], b[other])]
        p, q, first = np.searchsorted(at, i), np.searchsorted(other, j), np.zeros(len(i), bool)
        for part in _slices(len(i), 2 * table):
            first[part] = (cells[0][p[part]] != cells[1][q[part]]).all(axis=1)
        i, j = i[first], j[first]
    reps = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    members = [np.array([r[2] for r in side], np.float64) for side in (left, right)]
    for at, other, who, whom in ((i, j, 0, 1), (j, i, 1, 0)):
        if len(at):
            total = np.bincount(at, members[whom][other], len(reps[who]))
            for k in np.flatnonzero(total):
                yield int(reps[who][k]), None, int(total[k])
    for x, y in zip(*(z.tolist() for z in _forest(reps[0][i], reps[1][j])), strict=True):
        yield x, y, None


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    With ``exact`` all vectors of a label are compared, in blocks, and every pair is verified: no link
    is lost, at the price of work with the square of a label.

    Rows are compared when their labels are equal and not null and their vectors as long; they are
    linked at cosine >= ``least``, in double precision.  A null or zero vector, or one with a null
    or non-finite component, links with nothing; so does a row with a null id, whose component is
    null and which is kept.  ``n_links`` counts the other rows linked directly; rows that repeat
    an id count one by one.  Further columns are ignored; an empty table gives none.
    """
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for vec, label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                row = (vec, label, None, None, None)
                if vec is not None and label is not None and x.is_valid and not x.values.null_count and len(x.values):
                    v = np.asarray(x.values, np.float64) + 0.0
                    size = np.linalg.norm(v)
                    if np.isfinite(v).all() and np.isfinite(size) and size > 0:
                        fp = hashlib.blake2b(b"%d:" % label + v.tobytes(), digest_size=16).digest()
                        row = (vec, label, len(v), fp, v.tobytes())
                out.append(row)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["vec_id", "label", "dim", "fp", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector_col)
    ready = rows.mapInArrow(prepare, "vec_id long, label long, dim int, fp binary, vector binary")
    # hashed rows of one class meet on the map side first, so a very common vector is a few rows
    classes = ready.where("fp is not null").groupBy("fp").agg(F.count("*").alias("members"), F.min(F.struct("vec_id", "label", "dim", "vector")).alias("r"))
    classes = materialise(classes.select("fp", "members", F.col("r.vec_id").alias("rep"), "r.label", "r.dim", "r.vector"), "vectors")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(0, 1) if exact else plan(n, least) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1))], ["label", "dim", "depth", "tables"])

    plans = materialise(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).mapInArrow(sized, "label long, dim int, depth int, tables int"), "plans")

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x, depth, tables in zip(batch.column(2), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                v = np.frombuffer(x.as_buffer(), np.float64)[None, :]
                cells.append(cells_of(v / np.linalg.norm(v, axis=1, keepdims=True), depth, tables, least)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    planned = classes.select("rep", "members", "vector", "label", "dim").join(plans, ["label", "dim"]).select("rep", "members", "vector", "label", "dim", "depth", "tables")
    planned = materialise(planned.mapInArrow(celled, "rep long, members long, vector binary, label long, dim int, depth int, tables int, cells array<long>"), "cells")
    group = ["label", "dim", "table", "cell"]
    counts = planned.select("label", "dim", F.posexplode("cells").alias("table", "cell")).groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts.select(*group, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "groups")
    # who is alone in its cell is not dealt out
    placed = planned.select("*", F.posexplode("cells").alias("table", "cell")).drop("cells").join(counts, group)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    key = [*group, "i", "j"]
    dealt = (
        placed.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "depth", "tables", (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "members", "vector")
        .repartition(*key)
        .sortWithinPartitions(*key)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["a", "b", "links"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(12)), strict=True):
                if row[:8] != current:
                    if held:
                        yield out(list(_compare(current[2], *current[6:], held, least, exact)))
                    current, held = row[:8], []
                held.append(row[8:])
        if held:
            yield out(list(_compare(current[2], *current[6:], held, least, exact)))

    found = materialise(dealt.mapInArrow(compare, "a long, b long, links long"), "links")
    component = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("fp", "rep", "members")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .where("members > 1 or links is not null")
        .select(
            F.col("fp").alias("class"),
            (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    return (
        left_join_set(ready.select("vec_id", "fp"), of_class, "fp", "class")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
