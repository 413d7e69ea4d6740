"""Hard negatives against all inner products in plain Python."""

import random

import brute
import numpy as np
import pytest

from quarryline.llm import hard_negatives, registry


def test_strassen_is_exact():
    rng = np.random.default_rng(13)
    for m, k, n, leaf in ((1, 1, 1, 1), (7, 5, 3, 1), (33, 64, 70, 4), (100, 65, 129, 16), (8, 0, 9, 2), (64, 64, 64, 8)):
        a, b = rng.integers(-(2**26), 2**26, (m, k)), rng.integers(-(2**26), 2**26, (k, n))
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    a = rng.integers(-(2**62), 2**62, (40, 40))
    assert (hard_negatives.strassen(a, a, 2) == a @ a).all()  # modulo 2**64


def test_heaps_merge_in_any_order():
    rnd = random.Random(3)
    entries = [(rnd.randrange(4), rnd.randrange(5), i) for i in range(200)]
    want = [[(s, i) for s, i in sorted(((s, i) for o, s, i in entries if o == k), key=lambda e: (-e[0], e[1]))[:3]] for k in range(5)]
    for size in (1, 7, 200):
        rnd.shuffle(entries)
        heaps = hard_negatives.Heaps(5, 3)
        for at in range(0, len(entries), size):
            owner, score, ids = (np.array([e[k] for e in entries[at : at + size]]) for k in range(3))
            heaps.push(owner, score, ids)
        owner, ids, score = (x.tolist() for x in heaps.entries())
        assert [[(s, i) for o, i, s in zip(owner, ids, score) if o == k] for k in range(5)] == want


def table(n=400, dim=7):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=dim) + 0.5], int(rng.integers(0, 3))) for i in range(n)]
    for i in (60, 61, 62, 63):
        rows[i] = (i, rows[100][1], i % 2)  # ties
    nan, inf = float("nan"), float("inf")
    for i, v, label in ((5, None, 1), (6, [nan] * dim, 1), (7, [1.0, None] + [0.0] * (dim - 2), 1), (8, [inf] * dim, 1), (9, [1.0] * dim, None), (10, [0.0] * dim, 1), (11, [], 1), (12, [2.0, 3.0], 0), (13, [2.0] * (dim + 3), 1), (150, None, 1), (200, [0.0] * dim, 2), (250, [-1.0] * dim, 2)):
        rows[i] = (i, v, label)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, anchor_id int, opened int"


@pytest.mark.parametrize("sizes", [None, (2, 50, 7)])
def test_query_equals_plain_python(spark, tmp_path, monkeypatch, sizes):
    if sizes:
        for name, size in zip(("TILE", "BLOCK", "STRIP"), sizes):
            monkeypatch.setattr(hard_negatives, name, size)
        monkeypatch.setattr(hard_negatives.strassen, "__defaults__", (2,))
    rows = table()
    spark.createDataFrame([(*r, r[0], "v", 1, 1) for r in rows + [rows[50], rows[3]]] + [(None, [1.0] * 7, 1, 1, "v", 1, 1)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = sorted(brute.op13(rows))
    got = sorted(tuple(r) for r in registry.op13_hard_negatives(spark, str(tmp_path)).collect())
    assert got == want and len(want) > 20


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.op13_hard_negatives(spark, str(tmp_path)).collect() == []


def test_the_smallest_of_rows_that_repeat_an_id(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(50, [3.0], 1), (50, [2.0], 1), (1, [4.0], 1), (2, [3.0], 2)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 50 == 0).collect()]
    assert got == [(50, 1, 1, 2, 512 * 1024, 512 * 768)]
