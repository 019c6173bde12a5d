"""The matrix of correlations in a range, for display."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_long(edges: DataFrame, start: int, stop: int, least: float = 0.0001) -> DataFrame:
    """Edges with both ends in the range and a weight over ``least``, by absolute value."""
    inside = F.col("loc_a").between(start, stop) & F.col("loc_b").between(start, stop)
    return edges.withColumn("r", F.abs("r")).where(inside & (F.col("r") > least))


def matrix(edges: DataFrame, start: int, stop: int, least: float = 0.0001) -> DataFrame:
    """One row for each left end and one column for each right end, in order; a display's range holds few positions. Of a repeated pair the largest weight counts."""
    return matrix_long(edges, start, stop, least).groupBy("loc_a").pivot("loc_b").agg(F.max("r")).orderBy("loc_a")


def blocks_shown(block_table: DataFrame, start: int, stop: int) -> DataFrame:
    """Blocks of more than one position that lie in the range."""
    return block_table.where((F.col("block_start") >= start) & (F.col("block_end") <= stop) & (F.col("block_start") != F.col("block_end")))


def binned(edges: DataFrame, width: int) -> DataFrame:
    """Mean weight of squares of ``width``."""
    return edges.groupBy(F.floor(F.col("loc_a") / width).alias("bin_a"), F.floor(F.col("loc_b") / width).alias("bin_b")).agg(F.avg("r").alias("r"))


def pyramid(edges: DataFrame, width: int, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """(level, bin_a, bin_b, n, total, most): squares of ``width`` at level 0, each level's twice as wide as those of the level below.

    Every edge goes to its square at all levels before the one shuffle, so that
    partial sums, not edges, pass it; one square may hold any number of edges.
    Counts, sums and maxima can be merged with those of other edges (see merge_pyramids).
    """
    at = lambda c: F.call_function("shiftright", F.floor(F.col(c) / width), F.col("level")).alias(c.replace("loc", "bin"))
    dealt = edges.select(*by, "loc_a", "loc_b", "r", F.explode(F.array(*(F.lit(k) for k in range(levels)))).alias("level"))
    squares = dealt.select(*by, "level", at("loc_a"), at("loc_b"), "r").groupBy(*by, "level", "bin_a", "bin_b")
    return squares.agg(F.count("r").alias("n"), F.sum("r").alias("total"), F.max("r").alias("most"))


def merge_pyramids(pyramids: list[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One pyramid of the edges of all, which share none."""
    both = reduce(lambda x, y: x.unionByName(y), pyramids)
    return both.groupBy(*by, "level", "bin_a", "bin_b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def level_for(start: int, stop: int, width: int, levels: int, across: int) -> int:
    """The finest level at which the range is at most ``across`` squares wide, else the coarsest."""
    for level in range(levels):
        if stop // (width << level) - start // (width << level) < across:
            return level
    return levels - 1


def shown(squares: DataFrame, start: int, stop: int, width: int, levels: int, across: int) -> DataFrame:
    """(bin_a, bin_b, start_a, start_b, r, most) of a pyramid's squares that the range touches, at the level that takes at most ``across`` squares a side, so that a display reads a bounded number of rows."""
    level = level_for(start, stop, width, levels, across)
    size = width << level
    inside = F.col("bin_a").between(start // size, stop // size) & F.col("bin_b").between(start // size, stop // size)
    found = squares.where((F.col("level") == level) & inside)
    return found.select("bin_a", "bin_b", (F.col("bin_a") * size).alias("start_a"), (F.col("bin_b") * size).alias("start_b"), (F.col("total") / F.col("n")).alias("r"), "most")
