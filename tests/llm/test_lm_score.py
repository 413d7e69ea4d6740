"""Language-model scores against plain Python, token by token."""

import math
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import lm_score, registry


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def compare(got, want):
    got, want = key(got), key(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3)


def expected(df, train, order, deleted=lm_score.DELETED):
    rows = df.select("doc_id", "text", F.coalesce(train, F.lit(False)), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")), F.lit(deleted)) == 0).collect()
    found = brute.lm([(r[0], r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], order)
    return [(r[0], r[2], *f) for r, f in zip(rows, found)]


@pytest.mark.parametrize(("name", "order"), [("docs", 1), ("docs", 2), ("docs", 3), ("odd_docs", 2), ("no_docs", 2)])
def test_scores_equal_plain_python(name, order, request, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET", 500)
    df = request.getfixturevalue(name).where("doc_id is null or doc_id <> 4")
    train = F.col("doc_id") % 5 != 0
    compare([tuple(r) for r in lm_score.score_texts(df, train, order=order).collect()], expected(df, train, order))


@pytest.mark.parametrize("chunk", [None, 300])
def test_query_equals_plain_python(spark, chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(lm_score, "CHUNK", chunk)
        monkeypatch.setattr(lm_score, "BUCKET", 20_000)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in registry.op12_lm_score(spark, sf).collect()]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    compare([(r[0], not r[1], *r[2:]) for r in rows], expected(docs, train, lm_score.ORDER))
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # likelier than without contexts


def test_probabilities_add_up_to_one():
    """Over all continuations of one context: known tokens, the end among them, and one unknown one."""
    after, counts = [7, 0, 2, 1, 0], [20, 9, 4, 1, 0]  # the last is unknown
    weights = np.random.default_rng(12).uniform(size=(3, lm_score.DIGITS))
    model = lm_score.Mixture(sum(counts), 5, 4, weights)
    unigrams = np.array([x for c in counts for x in (sum(after), c)])
    bigrams = np.array([x for c in after for x in (3, c)])
    *_, (_, _, p) = model.estimates([unigrams, bigrams], np.arange(0, 10, 2), 2)
    assert p[1::2].sum() == pytest.approx(1.0, abs=1e-12)


def test_weights_are_those_of_most_likelihood():
    rows = [(3, None, 40), (3, 128, 30), (3, 200, 10), (5, 64, 5)]
    weights = lm_score.learned(rows)

    def likelihood(x):
        return sum(n * math.log(1 - x if k is None else x * 2 ** (k / lm_score.BINS) + 1 - x) for b, k, n in rows if b == 3)

    assert likelihood(weights[3]) == pytest.approx(max(likelihood(x / 10_000) for x in range(1, 10_000)), abs=1e-4)
    assert weights[0] == 0 and weights[1] == weights[3] == weights[4] and weights[9] == weights[5] > 0.999
    assert (lm_score.learned([])[1:] == lm_score.START).all()


def test_packing():
    for x in ([], [0], [1, 255, 256, 2**63 + 5], list(range(1000))):
        assert lm_score.unpack(lm_score.pack(np.array(x, np.uint64)), len(x)).tolist() == x
