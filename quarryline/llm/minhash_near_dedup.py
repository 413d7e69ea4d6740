"""Near-duplicate documents by circulant MinHash.

Two permutations make a whole signature.  The first deals shingles to positions of a universe;
coordinate k is the smallest value that the second one, shifted round by k, has at the set's
positions.  Coordinates are banded, documents that agree on a band are candidates, and every link
is confirmed by the exact Jaccard index of the full shingle sets.

No bucket is expanded into all its pairs:

1. documents with equal shingle sets become one class, its smallest id standing for it;
2. in each bucket every member is compared with the bucket's smallest member only, and the
   confirmed links are joined into components;
3. buckets that still hold several components are the rest.  The members outside a bucket's
   largest component are compared with all others in blocks of bounded size by their whole
   signatures, and what may still be a link between different components is confirmed exactly,
   too.  The members of the largest component never meet one another again.

A confirmed link is never inferred, and the components are those of all links that share a band.
With the constants below a pair of similarity 0.75 shares none of the bands with a probability of
2e-5, and falls below the signature threshold of step 3 with one of 3e-4; at 0.8 both are below
1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import connected_components, left_join_set, materialise, rows_without, temporary_tables, utf8, with_texts
from quarryline.llm.shingles import shingles_of

#: Positions that shingles are dealt to; the second permutation is of these.
UNIVERSE = 1 << 22
#: Bands, and coordinates in each; the coordinates behind the bands only sharpen the estimate.
BANDS, ROWS, COORDINATES = 40, 5, 400
#: Share of equal coordinates from which a pair of the rest is confirmed exactly.
LEAST_EQUAL = 0.675
#: Members of a bucket that one block holds.
BLOCK = 512
#: Members that are confirmed against one copy of a bucket's smallest member.
CHUNK = 64
_BATCH = 4096


@lru_cache(maxsize=1)
def circulant(seed: int = 11) -> np.ndarray:
    """The shifted copies of one permutation: row p holds the values that position p has under
    each shift, so a set's whole signature is a column-wise minimum over some rows."""
    order = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set of shingle hashes."""
    rows = circulant()
    # the first permutation: a bijection of the universe
    at = shingles & np.uint64(UNIVERSE - 1)
    at = (at * np.uint64(2654435761) + np.uint64(974711)) & np.uint64(UNIVERSE - 1)
    at ^= at >> np.uint64(11)
    parts = [rows[at[i : i + _BATCH].astype(np.int64)].min(0) for i in range(0, len(at), _BATCH)]
    return np.minimum.reduce(parts)


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band, the band's number included."""
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out + rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def sketches(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, n, fp, bands, sig) of (doc_id, raw): the size and a 128-bit fingerprint of the
    shingle set, its band hashes and the low byte of each coordinate; the latter three are null
    for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, bands, sig = [], [], [], []
            for found in map(np.unique, shingles_of(batch.column(1), shingle_words)):
                n.append(len(found))
                if len(found):
                    coordinates = signature(found)
                    fp.append(hashlib.blake2b(found, digest_size=16).digest())
                    bands.append(band_hashes(coordinates))
                    sig.append(coordinates.astype(np.uint8).tobytes())
                else:
                    fp.append(None)
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n", "fp", "bands", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, bands array<long>, sig binary")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts in ``texts`` (doc_id, raw) have shingle sets with
    100 * intersection >= percent * union.

    The pairs of one ``a`` are dealt into chunks; each chunk gets one copy of a's text, and its
    partners' texts stream past it, so a popular ``a`` is neither copied for each pair nor
    gathered in one task.
    """
    pairs = pairs.select("a", "b")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    first = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    rest = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b", F.col("b").alias("id"))
    wanted = materialise(first.unionByName(rest), "chunks")
    dealt = with_texts(texts.withColumnRenamed("doc_id", "id"), "id", wanted).select("a", "chunk", "b", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for batch in batches:
            left, right = [], []
            for a, chunk, b, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingles_of(batch.column(3), shingle_words), strict=True):
                found = np.unique(s)
                if (a, chunk) != key:
                    key, sets = (a, chunk), []
                if b is None:
                    sets.append(found)  # one, or several where an id has several texts
                    continue
                for other in sets:
                    both = len(np.intersect1d(other, found, assume_unique=True))
                    if 100 * both >= percent * (len(other) + len(found) - both):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = dealt.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rest_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) between different components of a bucket, for ``entries``
    (band, rep, n, comp, sig, bands, main, in_main, outside): blocks of a bucket are compared two by
    two.  The ``in_main`` members of the largest component ``main`` have blocks of their own, which
    only meet blocks of the ``outside`` ones, so a large component with few strays is dealt out
    about once.  A pair that shares several of the buckets (``bands`` lists a member's) is made in
    the lowest only."""
    of_outside, of_main = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("outside", "in_main"))
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, of_outside + F.pmod(F.xxhash64("rep"), of_main)).otherwise(F.pmod(F.xxhash64("rep"), of_outside)).cast("int")
    dealt = (
        entries.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, of_outside - 1).otherwise(of_outside + of_main - 1))))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "comp", "sig", "bands")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
    )

    def compare(key: tuple, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        band, i, j = key
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        if not left or not right:
            return
        sig = np.array([np.frombuffer(r[4], np.uint8) for r in right])
        rep, n, comp = (np.array([r[k] for r in right], np.int64) for k in (1, 2, 3))
        for r in left:
            fit = (comp != r[3]) & (100 * np.minimum(n, r[2]) >= percent * np.maximum(n, r[2]))
            if i == j:
                fit &= rep > r[1]
            at = np.flatnonzero(fit)
            if len(at):
                equal = (sig[at] == np.frombuffer(r[4], np.uint8)).mean(1)
                for k in at[equal >= LEAST_EQUAL].tolist():
                    if np.intersect1d(r[5], right[k][5], assume_unique=True)[0] == band:
                        yield min(r[1], right[k][1]), max(r[1], right[k][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            lists = (np.asarray(x.values) for x in batch.column(8))
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), lists, strict=True):
                if row[:3] != key:
                    if rows:
                        found.update(compare(key, rows))
                    key, rows = row[:3], []
                rows.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = set(compare(key, rows)) if rows else set()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs without ASCII white space, ASCII letters lower-cased; the set is of the
    distinct runs of ``shingle_words`` words, or of the one run of all words where there are
    fewer.  Documents are linked when 100 * intersection >= ``percent`` * union; ``component_id``
    is the smallest id reachable, and ``kept`` says that it is the document's own.

    Null, empty and blank texts have no shingles and are linked with nothing.  A null id is linked
    with nothing, has a null component and is kept.  Repeated rows are reported one by one; an id
    with several texts is one node of the links, with those of each text, and every row counts its
    own text's shingles.  Further columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    sketch = materialise(sketches(rows, shingle_words), "sketches")
    full = sketch.where("doc_id is not null and fp is not null")
    classes = full.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("r"), F.max("doc_id").alias("last"))
    classes = materialise(classes.select("fp", F.col("r.doc_id").alias("rep"), "last", "r.n", "r.bands", "r.sig"), "classes")

    banded = classes.select(F.explode("bands").alias("band"), "rep", "n")
    buckets = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("low"), F.max("rep").alias("high"))
    buckets = buckets.where("high > low.rep").select("band", F.col("low.rep").alias("leader"), F.col("low.n").alias("leader_n"))
    # written, so that the join has shuffles of its own, in which a hot bucket can be split
    multi = materialise(banded.join(materialise(buckets, "band-leaders"), "band"), "buckets")

    alike = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    stars = materialise(multi.where("rep <> leader").where(alike).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = materialise(confirm(stars, rows, percent, shingle_words), "links")
    label = materialise(connected_components(links), "labels")

    joined = multi.join(label, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = joined.groupBy("band", "comp").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("m"), F.sum("size").alias("members")).where("comps > 1")
    open_ = materialise(open_.select("band", F.col("m.comp").alias("main"), F.col("m.size").alias("in_main"), (F.col("members") - F.col("m.size")).alias("outside")), "open-bands")
    entries = materialise(joined.join(open_, "band"), "open")
    of_rep = entries.groupBy("rep").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # BANDS at most
    entries = entries.join(of_rep, "rep").join(classes.select("rep", "n", "sig"), "rep")
    more = materialise(_rest_pairs(entries, percent).join(stars, ["a", "b"], "left_anti"), "rest")
    if not more.isEmpty():
        links = links.unionByName(materialise(confirm(more, rows, percent, shingle_words), "links"))
        label = materialise(connected_components(links), "labels")

    # only classes of several documents, or linked with another class, say more than the row itself
    of_class = (
        classes.join(label, F.col("rep") == F.col("node"), "left")
        .where("last > rep or component is not null")
        .select(F.col("fp").alias("class"), F.coalesce("component", "rep").alias("found"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return (
        left_join_set(sketch.select("doc_id", "n", "fp"), of_class, "fp", "class")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one_of_each(docs: DataFrame, percent: int = 75, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the smallest id of each group of near-duplicates; all columns stay.

    Rows with a null id or a text without words stay, as do all rows of an id that is kept; an
    empty table stays empty.  Only rows whose id may be one to drop are shuffled with their texts.
    """
    with temporary_tables(docs.sparkSession):
        gone = near_duplicates(docs, percent, shingle_words, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
        gone = materialise(gone, "gone", keep=True)
    return rows_without(docs, id_col, gone).select(docs.columns)
