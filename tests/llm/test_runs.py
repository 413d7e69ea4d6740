"""Periodic runs against every lag in plain Python."""

import random
import time

import brute
import numpy as np
import pytest
from conftest import ordered

from quarryline.llm import periodic_runs, registry


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SPECIAL = [
    [],
    [0],
    fibonacci(600),
    [bin(i).count("1") % 2 for i in range(800)],
    [0] * 400,
    [0, 1] * 120 + [0] + [0, 1] * 120 + [0],
    [0] * 99 + [1] + [0] * 99 + [1] + [0] * 150,
    ([0, 0, 1] * 30 + [0]) * 4,
    ([0] * 120 + [1]) * 5,
    [0, 1] * 130 + [0] + [0, 1] * 90 + [1] + [0, 1] * 90,
    list(range(100)) * 3 + [7],
    list(range(100)),
]


def rows_of(texts, least):
    words = np.array([x for t in texts for x in t], np.int64)
    found = periodic_runs.runs_of(words, np.array([len(t) for t in texts]), least)
    return [[r[1:] for r in zip(*(x.tolist() for x in found), strict=True) if r[0] == k] for k in range(len(texts))]


@pytest.mark.parametrize("least", [2, 12])
def test_all_runs_of_special_sequences(least):
    assert rows_of(SPECIAL, least) == [brute.runs(t, least) for t in SPECIAL]


def test_all_runs_of_random_sequences():
    rnd = random.Random(11)

    def piece():
        unit = [rnd.randrange(rnd.choice((2, 3, 50))) for _ in range(rnd.randrange(1, 90))]
        return (unit * rnd.randrange(1, 7))[rnd.randrange(len(unit)) :][: rnd.randrange(1, 400)]

    for _ in range(60):
        texts = [[x for _ in range(rnd.randrange(4)) for x in piece()] for _ in range(rnd.randrange(1, 5))]
        assert rows_of(texts, 12) == [brute.runs(t) for t in texts]


def test_repetitive_texts_take_near_linear_time():
    began = time.time()
    assert rows_of([[0] * 300_000], 12) == [[(0, 300_000, 1)]]
    assert len(rows_of([[0, 1] * 50_000 + [0] + [0, 1] * 50_000 + [0]], 12)[0]) > 40_000
    assert time.time() - began < 30


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_query_equals_plain_python(spark, name, request, tmp_path):
    df = request.getfixturevalue(name)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute.op11([(r.doc_id, r.text) for r in df.collect()])
    assert ordered(registry.op11_periodic_runs(spark, str(tmp_path))) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute.op11([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12_000])
    got = {r.doc_id: tuple(r) for r in registry.op11_periodic_runs(spark, sf).collect()}
    assert [got[r[0]] for r in want] == want and any(r[1] for r in want)


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "a b " + "x y z " * 5 + "c", 1), (None, None, 2), (3, " \t", 3), (4, "w " * 20, 4)], "doc_id long, text string, runs int")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {1: (18, [(2, 15, 3)], "a b x y z c"), None: (0, [], ""), 3: (0, [], ""), 4: (20, [(0, 20, 1)], "w")}
