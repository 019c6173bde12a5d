"""Consensus of several partitions by merging their intervals."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haploweave.operators.ranges import STRETCH, overlaps, running_max
from haploweave.sources.shared import written


def extremes(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sets.groupBy(*by).agg(F.min("block_start").alias("chrom_start"), F.max("block_end").alias("chrom_stop"))


def shrunk(sets: DataFrame, buffer: float) -> DataFrame:
    """Half-open intervals of ``sets(pop, block_start, block_end)``, shortened by half the buffer on both sides; empty ones go."""
    half = buffer / 2.0
    return sets.withColumn("start", F.col("block_start") + half).withColumn("stop", F.col("block_end") + 1 - half).where("start < stop")


def islands(intervals: DataFrame, by: Sequence[str] = (), merge_adjacent: bool = False, width: int = STRETCH) -> DataFrame:
    """Merged (start, stop): intervals that overlap, and with ``merge_adjacent`` also those that touch, become one."""
    # each once, so that both passes below see one order
    rows = running_max(intervals.select(*by, "start", "stop").distinct(), "start", F.col("stop"), "reach", ["start", "stop"], by, width=width)
    apart = (F.col("start") > F.col("reach")) if merge_adjacent else (F.col("start") >= F.col("reach"))
    rows = rows.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), F.col("start")))
    # an island is named by the start of its first interval
    rows = running_max(rows, "start", F.col("new"), "earlier", ["start", "stop"], by, width=width).withColumn("island", F.coalesce("new", "earlier"))
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def merged(sets: DataFrame, buffer: float, by: Sequence[str] = (), merge_adjacent: bool = False) -> DataFrame:
    """Consensus intervals before repair: shrunk blocks and the chromosome's ends, merged."""
    short = shrunk(sets, buffer).select(*by, "start", "stop")
    inner = short.groupBy(*by).agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    ends = extremes(sets, by)
    edge = ends.join(inner, list(by)) if by else ends.crossJoin(F.broadcast(inner))  # one row each
    double = lambda c: F.col(c).cast("double")
    first = edge.select(*by, double("chrom_start").alias("start"), (F.col("lo") + 1).alias("stop"))
    # the last piece begins one before all others' end, the first piece's too
    top = F.greatest(F.col("hi"), F.when(double("chrom_start") < F.col("lo") + 1, F.col("lo") + 1))
    last = edge.select(*by, (top - 1).alias("start"), double("chrom_stop").alias("stop"))
    return islands(short.unionByName(first.where("start < stop")).unionByName(last.where("start < stop")), by, merge_adjacent)


def _reached(sets: DataFrame, consensus: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """(pop, block_start, block_end, n, low, high) of blocks that overlap more than one consensus interval: how many, and from where to where these go."""
    own = sets.select(*by, "pop", "block_start", "block_end", F.col("block_start").cast("double").alias("s"), (F.col("block_end") + 1).cast("double").alias("e"))
    pairs = overlaps(own, consensus.select(*by, F.col("start").alias("u"), F.col("stop").alias("v")), ("s", "e", "u", "v"), width, by)
    return pairs.groupBy(*by, "pop", "block_start", "block_end").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("v").alias("high")).where("n > 1")


def violations(sets: DataFrame, consensus: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(pop, block_start, block_end, n) of blocks that overlap more than one consensus interval."""
    return _reached(sets, consensus, width, by).drop("low", "high")


def _cut(starts: list[float], stops: list[float], a: float, b: float) -> None:
    """Of sorted intervals, those that [a, b) overlaps lose what they share with it, but for the longest overlap (the first of equals)."""
    low, high = bisect.bisect_right(stops, a), bisect.bisect_left(starts, b)
    if high - low < 2:
        return
    most = max(range(low, high), key=lambda k: (min(stops[k], b) - max(starts[k], a), -k))
    left = []
    for k in range(low, high):
        if k == most:
            left.append((starts[k], stops[k]))
        else:
            left += [p for p in ((starts[k], min(stops[k], a)), (max(starts[k], b), stops[k])) if p[0] < p[1]]
    starts[low:high], stops[low:high] = [p[0] for p in left], [p[1] for p in left]


def repaired(sets: DataFrame, buffer: float, width: int, by: Sequence[str] = (), merge_adjacent: bool = False) -> DataFrame:
    """Consensus intervals in which every block overlaps at most one.

    Blocks that overlap several are taken in order of population and start; all
    overlaps but the longest are cut out. What one block does matters only to those
    that reach the same intervals, so intervals and blocks are worked on in groups
    that share none; intervals that no such block reaches stay as they are.
    """
    # each is read several times below
    consensus = written(merged(sets, buffer, by, merge_adjacent), "consensus")
    bad = _reached(sets, consensus, width, by).select(*by, "pop", F.col("block_start").cast("double").alias("start"), (F.col("block_end") + 1).cast("double").alias("stop"), "low", "high")
    bad = written(bad, "reaching")
    groups = islands(bad.select(*by, F.least("low", "start").alias("start"), F.greatest("high", "stop").alias("stop")), by).select(*by, F.col("start").alias("group"), F.col("stop").alias("group_stop"))
    groups = written(groups, "groups")
    inside = overlaps(consensus, groups, ("start", "stop", "group", "group_stop"), width, by).drop("group_stop")
    marked = overlaps(bad.drop("low", "high"), groups, ("start", "stop", "group", "group_stop"), width, by).drop("group_stop")
    free = consensus.join(inside.select(*by, "start", "stop"), [*by, "start", "stop"], "left_anti")
    rows = inside.withColumn("pop", F.lit(None).cast("string")).unionByName(marked)

    def repair(frame: pd.DataFrame) -> pd.DataFrame:
        is_block = frame["pop"].notna()
        pieces = frame[~is_block].sort_values("start")
        starts, stops = pieces["start"].tolist(), pieces["stop"].tolist()
        for r in frame[is_block].sort_values(["pop", "start"]).itertuples():
            _cut(starts, stops, r.start, r.stop)
        out = pd.DataFrame({"start": starts, "stop": stops}, dtype=float)
        for name in by:
            out[name] = frame[name].iloc[0]
        return out

    schema = T.StructType([*(consensus.schema[c] for c in by), T.StructField("start", T.DoubleType()), T.StructField("stop", T.DoubleType())])
    return free.select(*by, "start", "stop").unionByName(rows.groupBy(*by, "group").applyInPandas(repair, schema))


def coverage(consensus: DataFrame, ends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(covered, coverage_percent) of the chromosome from its first to its last position."""
    covered = consensus.groupBy(*by).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    both = covered.join(ends, list(by)) if by else covered.crossJoin(F.broadcast(ends))  # one row each
    return both.select(*by, "covered", (100.0 * F.col("covered") / (F.col("chrom_stop") - F.col("chrom_start"))).alias("coverage_percent"))


def triangles(block_table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Three points (n, x, y) for each block: its start, its middle raised by half its length, its end."""
    half = (F.col("block_end") - F.col("block_start")) / 2.0
    point = lambda n, x, y: F.struct(F.lit(n).alias("n"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(point(0, F.col("block_start"), F.lit(0)), point(1, F.col("block_start") + half, half), point(2, F.col("block_end"), F.lit(0)))
    return block_table.select(*keys, "block_start", "block_end", F.explode(points).alias("p")).select(*keys, "block_start", "block_end", "p.*")
