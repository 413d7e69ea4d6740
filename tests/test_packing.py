"""Batches of findings against filling them one after another."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import packing


def one_by_one(rows, count, room):
    """rows (id, size, priority) -> {id: (batch, place)}"""
    out, batch, held, used = {}, 0, 0, 0
    for i, size, _ in sorted(rows, key=lambda r: (not r[2], r[0])):
        size = max(size or 0, 0)
        if held and (held + 1 > count or used + size > room):
            batch, held, used = batch + 1, 0, 0
        out[i] = (batch, held)
        held, used = held + 1, used + size
    return out


@pytest.mark.parametrize(("n", "count", "room", "stretch"), [(0, 3, 10, 5), (1, 3, 10, 5), (400, 1, 10, 7), (400, 5, 30, 7), (400, 12, 1000, 12), (400, 12, 25, 3), (1000, 8, 60, 1000), (1000, 8, 60, 999), (40, 100, 1000, 5)])
def test_batches_equal_filling_one_by_one(spark, n, count, room, stretch):
    rnd = random.Random(n + count)
    rows = [(i * 3, rnd.choice([None, 0, -1, 1, 5, 9, 20, 40, room, room + 1]), rnd.choice([True, False, None])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, size int, urgent boolean").repartition(3)
    got = {r.id: (r.batch, r.place) for r in packing.pack(df, count, room, F.col("urgent"), stretch=stretch).collect()}
    assert got == one_by_one(rows, count, room)


def test_a_hundred_thousand_findings(spark):
    df = spark.range(100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(900)) + 50).alias("size"), (F.col("id") % 7 == 0).alias("urgent"))
    rows = [tuple(r) for r in df.collect()]
    got = {r.id: (r.batch, r.place) for r in packing.pack(df, 8, 3000, F.col("urgent"), stretch=9_000).collect()}
    assert got == one_by_one(rows, 8, 3000)
