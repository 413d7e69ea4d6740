"""Language-model scores of texts by deleted interpolation.

The probability of a token after a context mixes the maximum-likelihood estimates of all orders,

    p_r(w | h) = weight_r(h) * c(h w) / c(h) + (1 - weight_r(h)) * p_{r-1}(w | h without its first word),

down to an equal share for each known token and one unknown one.  The weight depends on how often the
context was seen: contexts are in buckets by the number of binary digits of c(h), and those never seen
have weight zero.  A part of the training texts is deleted from the counts, and expectation-maximisation
learns the weights that make this part most likely; then the counts of all training texts are used.

Tokens are 64-bit hashes of words.  Texts are gathered in chunks of bounded size, each with a dictionary
of its own.  A chunk asks for every different n-gram that it holds once, and tells how often it holds
it, so the commonest n-grams of the corpus are a few numbers a chunk: no key is hot.  N-grams are dealt
to buckets by their hash; a bucket adds up what the chunks tell, and answers each of them.  Nothing
that grows with the corpus is broadcast or collected.

For the weights of an order only the ratio of its estimate to that of the order below matters, so a
pass over the deleted part counts ratios in bins of 1/64 of a binary digit for each bucket of contexts;
this small table is all that expectation-maximisation needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import in_slices, materialise, temporary_tables, utf8
from quarryline.llm.shingles import hash_words

#: Words of the longest n-grams.
ORDER = 2
#: Tokens of a chunk, but for a text that has more, and of the n-grams that a bucket is asked for on
#: average.  There are about as many rows of requests as the product of chunks and buckets: where
#: these are many thousands, both may well be larger.
CHUNK, BUCKET = 2_000_000, 2_000_000
#: One in so many training texts is deleted from the counts that the weights are learned with.
DELETED = 6
#: Bins of a ratio for each of its binary digits.
BINS = 64
#: The weight that expectation-maximisation starts with, the least a weight or its rest may be, rounds.
START, LEAST_WEIGHT, ROUNDS = 0.5, 1e-6, 200
#: Buckets of contexts: the numbers of binary digits.
DIGITS = 65
#: Stand for the end of a text, and for what is before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in few bytes: their bytes apart by place, compressed."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    """The numbers again, of which there are ``n``."""
    width = packed[0]
    planes = np.frombuffer(pa.decompress(packed[1:], n * width, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(n)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()),
        ("deleted", pa.bool_()),
        ("ids", pa.list_(pa.int64())),
        ("trained", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int32())),
        ("n_words", pa.int32()),
        ("words", pa.binary()),
        ("codes", pa.binary()),
        ("n_tokens", pa.int64()),
        ("train_tokens", pa.int64()),
        ("train_docs", pa.int64()),
    ]
)
_CHUNKS_SQL = "chunk long, deleted boolean, ids array<long>, trained array<boolean>, sizes array<int>, n_words int, words binary, codes binary, n_tokens long, train_tokens long, train_docs long"


class _Chunk:
    """Texts that are gathered until they are a chunk."""

    def __init__(self, deleted: bool) -> None:
        self.deleted, self.ids, self.trained, self.sizes, self.tokens, self.n = deleted, [], [], [], [], 0

    def add(self, ids: list, trained: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.ids += ids
        self.trained.append(trained)
        self.sizes.append(sizes)
        self.tokens.append(tokens)
        self.n += len(tokens)

    def row(self) -> pa.RecordBatch:
        words, codes, counts = np.unique(np.concatenate(self.tokens), return_inverse=True, return_counts=True)
        common = np.argsort(-counts, kind="stable")  # common words have small numbers
        rank = np.empty(len(words), np.int64)
        rank[common] = np.arange(len(words))
        trained, sizes = np.concatenate(self.trained), np.concatenate(self.sizes)
        row = [uuid.uuid4().int >> 65, self.deleted, self.ids, trained.tolist(), sizes.tolist(), len(words), words[common].astype("<u8").tobytes(), pack(rank[codes])]
        row += [self.n, int(sizes[trained].sum()), int(trained.sum())]
        return _batch(_CHUNKS, [[x] for x in row])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, trained, deleted, text) -> chunks; the deleted texts have chunks of their own."""
    open_ = {d: _Chunk(d) for d in (False, True)}
    for part in in_slices(batches):
        raw = part.column(3).to_pylist()
        starts = np.cumsum([0] + [len(r) for r in raw[:-1]])
        hashes, counts = hash_words(np.frombuffer(b"".join(raw), np.uint8), starts)
        ends = np.cumsum(counts)
        tokens = np.insert(hashes, ends, END)
        row = np.repeat(np.arange(len(counts)), counts + 1)
        ids, trained, deleted = part.column(0).to_pylist(), np.asarray(part.column(1)), np.asarray(part.column(2))
        for d, chunk in open_.items():
            mine = np.flatnonzero(deleted == d)
            if not len(mine):
                continue
            chunk.add([ids[k] for k in mine], trained[mine], counts[mine] + 1, tokens[(deleted == d)[row]])
            if chunk.n >= CHUNK:
                yield chunk.row()
                open_[d] = _Chunk(d)
    for chunk in open_.values():
        if chunk.n:
            yield chunk.row()


def grams(tokens: np.ndarray, first: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The hashes of the n-grams that end at each token, for each order from 1; ``first`` are the
    places of the first tokens of texts."""
    g = tokens
    yield g
    for r in range(2, order + 1):
        before = np.empty_like(g)
        before[1:] = g[:-1]
        before[first] = BEGIN + np.uint64(r)
        g = before * _MULTIPLIER + tokens
        g = (g ^ (g >> np.uint64(31))) * _MIX
        g ^= g >> np.uint64(29)
        yield g


def _texts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sizes, places of first tokens, which tokens are trained on) of a chunk's row."""
    sizes = np.array(row["sizes"], np.int64)
    tokens = np.frombuffer(row["words"], "<u8")[unpack(row["codes"], row["n_tokens"]).astype(np.int64)]
    return tokens, sizes, np.cumsum(sizes) - sizes, np.repeat(np.array(row["trained"], bool), sizes)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among ascending keys."""
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


_ASKED = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKED_SQL = "order int, bucket int, chunk long, deleted boolean, n int, keys binary, counts binary"
_ANSWERED = pa.schema(
    [("chunk", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("total", pa.binary()), ("kept", pa.binary()), ("types", pa.int64()), ("kept_types", pa.int64())]
)
_ANSWERED_SQL = "chunk long, order int, bucket int, n int, total binary, kept binary, types long, kept_types long"


def _requests(order: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for part in in_slices([batch], 1) for r in part.to_pylist()):
            tokens, _, first, trained = _texts_of(row)
            for r, g in enumerate(grams(tokens, first, order), 1):
                keys, at = np.unique(g, return_inverse=True)
                counts = np.bincount(at[trained], minlength=len(keys))
                edges = _edges(keys, buckets)
                out = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    part = keys[edges[b] : edges[b + 1]]
                    out.append((r, b, row["chunk"], row["deleted"], len(part), pack(np.diff(part, prepend=np.uint64(0))), pack(counts[edges[b] : edges[b + 1]])))
                yield _batch(_ASKED, list(zip(*out, strict=True)))

    return run


def _answer(asked: list[tuple]) -> pa.RecordBatch:
    """What one bucket answers to all chunks that asked it."""
    order, bucket = asked[0][:2]
    keys = np.concatenate([np.cumsum(unpack(a[5], a[4]), dtype=np.uint64) for a in asked])
    counts = np.concatenate([unpack(a[6], a[4]) for a in asked]).astype(np.int64)
    deleted = np.repeat(np.array([a[3] for a in asked], bool), [a[4] for a in asked])
    types, at = np.unique(keys, return_inverse=True)
    total, kept = (np.bincount(at, weights=w, minlength=len(types)).astype(np.int64) for w in (counts, counts * ~deleted))
    out, low = [], 0
    for k, a in enumerate(asked):
        mine = at[low : low + a[4]]
        low += a[4]
        found = (int((total > 0).sum()), int((kept > 0).sum())) if not k else (0, 0)
        out.append((a[2], order, bucket, a[4], pack(total[mine]), pack(kept[mine]) if a[3] else None, *found))
    return _batch(_ANSWERED, list(zip(*out, strict=True)))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if row[:2] != current:
                if held:
                    yield _answer(held)
                current, held = row[:2], []
            held.append(row)
    if held:
        yield _answer(held)


def _counts(row: dict, tokens: np.ndarray, first: np.ndarray, order: int, which: str) -> list[np.ndarray]:
    """For each order, how often the n-gram that ends at each token was counted."""
    answers = sorted(row["answers"], key=lambda a: (a["order"], a["bucket"]))
    out = []
    for r, g in enumerate(grams(tokens, first, order), 1):
        found = np.concatenate([unpack(a[which], a["n"]) for a in answers if a["order"] == r])
        out.append(found[np.unique(g, return_inverse=True)[1]].astype(np.int64))
    return out


class Mixture:
    """The sizes of what was counted, and the weights by order and bucket of contexts."""

    def __init__(self, tokens: int, docs: int, types: int, weights: np.ndarray) -> None:
        self.tokens, self.docs, self.types, self.weights = tokens, docs, types, weights

    def estimates(self, counts: list[np.ndarray], first: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket of the context, estimate of this order, mixture of the orders below) of each
        token, for each order up to ``upto``; and at last the mixture of all of them."""
        below = np.full(len(counts[0]), 1 / (self.types + 1))
        for r in range(1, upto + 1):
            if r == 1:
                context = np.full(len(below), self.tokens)
            else:
                context = np.empty(len(below), np.int64)
                context[1:] = counts[r - 2][:-1]
                context[first] = self.docs
            bucket = np.frexp(context.astype(np.float64))[1]
            estimate = counts[r - 1] / np.maximum(context, 1)
            yield bucket, estimate, below
            weight = self.weights[r, bucket]
            below = weight * estimate + (1 - weight) * below
        yield np.zeros(0, np.int64), np.zeros(0), below


def learned(histogram: list[tuple[int, int | None, int]], start: float = START) -> np.ndarray:
    """The weight of each bucket, from (bucket, bin of the ratio or null for zero, tokens).

    A bucket without tokens has the weight of the next smaller one that has some, or else of the
    next larger; without any all have the one to start with.  Bucket 0, of contexts that were never
    seen, has none.
    """
    out = np.full(DIGITS, np.nan)
    for b in {h[0] for h in histogram if h[0]}:
        rows = [h for h in histogram if h[0] == b]
        ratio = np.array([0.0 if h[1] is None else 2 ** (h[1] / BINS) for h in rows])
        n = np.array([h[2] for h in rows], np.float64)
        weight = start
        for _ in range(ROUNDS):
            before, weight = weight, float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum())
            weight = min(max(weight, LEAST_WEIGHT), 1 - LEAST_WEIGHT)
            if abs(weight - before) < 1e-9:
                break
        out[b] = weight
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        out[:] = start
    else:
        at = np.maximum(np.searchsorted(known, np.arange(DIGITS), "right") - 1, 0)
        out = out[known[at]]
    out[0] = 0.0
    return out


def _ratios(model: Mixture, order: int, upto: int) -> Callable:
    """Counts, over deleted chunks, the ratios of the estimates of order ``upto`` to the mixture below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for part in in_slices([batch], 1) for r in part.to_pylist()):
            tokens, _, first, _ = _texts_of(row)
            counts = _counts(row, tokens, first, order, "kept")
            *_, (bucket, estimate, below), _ = model.estimates(counts, first, upto)
            seen = (bucket > 0) & (estimate > 0)
            none = np.bincount(bucket[(bucket > 0) & (estimate == 0)], minlength=DIGITS)
            bins = np.rint(np.log2(estimate[seen] / below[seen]) * BINS).astype(np.int64)
            key, n = np.unique((bucket[seen].astype(np.int64) << 32) + bins, return_counts=True)
            at = (key + (1 << 31)) >> 32
            unseen = np.flatnonzero(none)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([at, unseen]), pa.int32()),
                    pa.array(np.concatenate([key - (at << 32), np.zeros(len(unseen), np.int64)]), pa.int32(), mask=np.concatenate([np.zeros(len(n), bool), np.ones(len(unseen), bool)])),
                    pa.array(np.concatenate([n, none[unseen]]), pa.int64()),
                ],
                ["bucket", "bin", "n"],
            )

    return run


def _scores(model: Mixture, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for part in in_slices([batch], 1) for r in part.to_pylist()):
            tokens, sizes, first, _ = _texts_of(row)
            counts = _counts(row, tokens, first, order, "total")
            *_, (_, _, p) = model.estimates(counts, first, order)
            base = np.log10((counts[0] + 1) / (model.tokens + model.types + 1))
            known, base, score = (np.add.reduceat(x, first) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(p)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["trained"], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)],
                ["doc_id", "trained", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, deleted: int = DELETED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from the rows for which ``train`` holds, of which one in ``deleted``, by a hash
    of id and text, is deleted to learn the weights.  Tokens are the words that ASCII white space
    separates, ASCII letters lower-cased, and the end of the text.  ``n_known`` counts the tokens
    that the training texts hold, ``train_tokens`` is the number of theirs; ``base_score`` is the
    sum of log10 of (c + 1) / (N + V + 1), ``score`` the log10 probability of the text under the
    mixture.

    A null, empty or blank text is its end alone.  A row for which ``train`` is null isn't learned
    from; a null id stays null; repeated rows count, and are scored, one by one.  Without training
    texts every probability is 1, without deleted ones all weights are START.  Further columns are
    ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("trained"), utf8(text_col).alias("text"))
    rows = rows.select("id", "trained", (F.col("trained") & (F.pmod(F.xxhash64("id", "text"), F.lit(deleted)) == 0)).alias("deleted"), "text")
    chunks = materialise(rows.mapInArrow(_chunks, _CHUNKS_SQL), "lm-chunks", keep=True)
    none = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(c), none) for c in ("n_tokens", "train_tokens", "train_docs")]
    sums += [F.coalesce(F.sum(F.when(~F.col("deleted"), F.col(c))), none) for c in ("train_tokens", "train_docs")]
    tokens, train_tokens, train_docs, kept_tokens, kept_docs = chunks.agg(*sums).first()
    buckets = max(1, -(-tokens // BUCKET))
    asked = chunks.mapInArrow(_requests(order, buckets), _ASKED_SQL)
    asked = asked.repartition("order", "bucket").sortWithinPartitions("order", "bucket")
    answers = materialise(asked.mapInArrow(_answers, _ANSWERED_SQL), "lm-counts", keep=True)
    types, kept_types = answers.where("order = 1").agg(*(F.coalesce(F.sum(c), none) for c in ("types", "kept_types"))).first()

    def answered(which: DataFrame, replies: DataFrame) -> DataFrame:
        told = replies.groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "n", "total", "kept")).alias("answers"))
        return which.join(told, "chunk").select("chunk", "ids", "trained", "sizes", "words", "codes", "n_tokens", "answers")

    weights = np.zeros((order + 1, DIGITS))
    with temporary_tables(spark):
        held = materialise(answered(chunks.where("deleted"), answers.where("kept is not null")), "lm-deleted")
        for r in range(1, order + 1):
            found = held.mapInArrow(_ratios(Mixture(kept_tokens, kept_docs, kept_types, weights), order, r), "bucket int, bin int, n long")
            weights[r] = learned([tuple(x) for x in found.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()])
    model = Mixture(train_tokens, train_docs, types, weights)
    scored = answered(chunks, answers).mapInArrow(_scores(model, order), "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "trained", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
