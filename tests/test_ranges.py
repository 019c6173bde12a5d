"""Overlaps of intervals whose lengths differ by any factor."""

import random

from pyspark.sql import functions as F

from haploweave.operators import ranges

NAMES = ("s", "e", "u", "v")


def intervals(n, seed):
    """Of lengths from 0 to 2.5e8, on two lines, some repeated, some over the top level."""
    draw = random.Random(seed)
    found = []
    for _ in range(n):
        start = draw.choice([draw.randrange(300_000_000), draw.randrange(2_000)])
        found.append((draw.choice("xy"), start, start + draw.choice([0, 1, 7, 100, 4_096, 1_000_000, 250_000_000])))
    return [*found, found[0], ("x", 0, 30_000_000_000), ("z", 1, 5)]


def test_overlaps_by_brute_force(spark):
    a, b = intervals(300, 1), intervals(200, 2)
    left, right = spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b[:-1], "k string, u long, v long")
    for width in (1, 100, 100_000):
        got = sorted(map(tuple, ranges.overlaps(left, right, NAMES, width, ["k"]).select("k", *NAMES).collect()))
        assert got == sorted((k, s, e, u, v) for k, s, e in a for j, u, v in b[:-1] if k == j and s < e and u < v and s < v and u < e)
    got = sorted(map(tuple, ranges.overlaps(left.drop("k"), right.drop("k"), NAMES, 100).select(*NAMES).collect()))
    assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b[:-1] if s < e and u < v and s < v and u < e)


def test_fractions_and_negative_ends(spark):
    rows = [(-3.5, -0.5), (-0.5, 0.0), (0.0, 1e-9), (-1e6, 1e6), (99.5, 100.0), (100.0, 100.5)]
    left, right = spark.createDataFrame(rows, "s double, e double"), spark.createDataFrame(rows, "u double, v double")
    got = sorted(map(tuple, ranges.overlaps(left, right, NAMES, 100).select(*NAMES).collect()))
    assert got == sorted((s, e, u, v) for s, e in rows for u, v in rows if s < v and u < e)


def test_nothing_on_one_side(spark):
    left, none = spark.createDataFrame([(1, 5)], "s long, e long"), spark.createDataFrame([], "u long, v long")
    assert ranges.overlaps(left, none, NAMES, 10).count() == 0
    assert ranges.overlaps(none.toDF("s", "e"), left.toDF("u", "v"), NAMES, 10).count() == 0


def test_rows_dealt(spark):
    """At most two a level, and once more where a row lies; a piece 2,500 widths long is no longer 2,500 rows."""
    rows = spark.createDataFrame([(7, 250_000_007), *((x, x + 10) for x in range(0, 5_000_000, 50_000))], "s long, e long")
    own = ranges.with_level(rows, "s", "e", 100_000)
    dealt = ranges.binned_by_level(own, "s", "e", own.toDF("u", "v", "_level"), 100_000, 0).groupBy("s", "e").agg(F.count("*").alias("n"))
    assert own.select("_level").distinct().count() == 2
    assert dealt.agg(F.max("n")).first()[0] <= 2 * 2
