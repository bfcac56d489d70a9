"""The overlap join against brute force, and what its hot keys put on one task."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import overlap


def meets(a, b):
    (al, ah), (bl, bh) = a, b
    empty = lambda lo, hi: lo is not None and hi is not None and lo >= hi
    return not empty(al, ah) and not empty(bl, bh) and (al is None or bh is None or al < bh) and (bl is None or ah is None or bl < ah)


def some_ranges(rng, n, keys, most=60):
    out = []
    for i in range(n):
        lo = None if rng.random() < 0.15 else rng.choice([7, rng.randint(0, most)])
        hi = None if rng.random() < 0.2 else (lo if lo is not None else 0) + rng.randint(-1, 12)
        out.append((rng.choice(keys), i, lo, hi))
    return out


@pytest.mark.parametrize("hot_rows", [3, 40, 10_000])
def test_pairs_equal_brute_force(spark, hot_rows):
    rng = random.Random(hot_rows)
    keys = [1] * 6 + [2, 3, None]
    a, b = some_ranges(rng, 160, keys), some_ranges(rng, 140, [*keys, 4])
    left = spark.createDataFrame(a, "k int, x int, lo int, hi int")
    right = spark.createDataFrame(b, "k int, y int, lo_b int, hi_b int")
    found = overlap.overlap_join(left, right, ["k"], ("lo", "hi"), ("lo_b", "hi_b"), hot_rows)
    assert found.columns == ["k", "x", "lo", "hi", "y", "lo_b", "hi_b"]
    got = sorted((r.x, r.y) for r in found.collect())
    assert got == sorted((x, y) for k, x, *r in a for m, y, *s in b if k is not None and k == m and meets(r, s))
    points = spark.createDataFrame([(k, y, lo) for k, y, lo, _ in b], "k int, y int, at int")
    got = sorted((r.x, r.y) for r in overlap.point_join(points, left, ["k"], "at", "lo", "hi", hot_rows).collect())
    assert got == sorted((x, y) for k, x, lo, hi in a for m, y, at, _ in b if k == m and k is not None and at is not None and (lo is None or lo <= at) and (hi is None or at < hi))
    assert overlap.overlap_join(left.limit(0), right, ["k"], ("lo", "hi"), ("lo_b", "hi_b"), hot_rows).collect() == []


def test_a_key_with_half_of_all_rows_is_dealt_out(spark):
    """20,000 ranges, half of them of one key and a third of these at one position: no bin and salt holds many more points than asked for."""
    rng = random.Random(9)
    rows = [(0 if i % 2 else 1 + i % 500, i, 5 if i % 6 == 1 else rng.randint(0, 3000)) for i in range(20_000)]
    df = spark.createDataFrame([(k, i, lo, None if i % 50 == 1 else lo + rng.randint(1, 3)) for k, i, lo in rows], "k int, x int, lo int, hi int")
    points, spans = overlap.deal(df, df, ["k"], "lo", "lo", "hi", 500)
    own = points.filter("k = 0").groupBy("__bin", "__salt").count()
    most, n, total = own.agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert total == 10_000 and most <= 2 * 500 and n >= 12
    # Open ends reach every later bin, other ranges one or two.
    copies = spans.filter("k = 0").count()
    assert copies < 10_000 * 8 + 400 * n
    # On tasks: no partition of the join's input holds the hot key.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = points.repartition(16, "k", "__bin", "__salt").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts < 0.25 * 20_000
