"""The correlation graph: canonical edges, merging, degrees, and null-model statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haploweave.operators.ranges import within


def canonical(edges: DataFrame) -> DataFrame:
    """Edges from the smaller to the larger position, without loops, with absolute weights."""
    a, b = F.col("loc_a"), F.col("loc_b")
    return edges.where(a != b).withColumns({"loc_a": F.least(a, b), "loc_b": F.greatest(a, b), "r": F.abs("r")})


def assert_unit(edges: DataFrame) -> DataFrame:
    """Edges, or an error where a weight is not between 0 and 1."""
    bad = F.raise_error(F.concat(F.lit("weight out of range: "), F.col("r").cast("string"))).cast("double")
    return edges.withColumn("r", F.when(F.col("r").between(0, 1), F.col("r")).otherwise(bad))


def duplicates(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs that occur more than once. Scoring needs this to be empty."""
    return edges.groupBy(*by, "loc_a", "loc_b").agg(F.count("*").alias("n")).where("n > 1")


#: Edges that a task or bucket should hold, about: it keeps a row of each in memory.
TASK_EDGES = 500_000
#: Side of the squares of positions whose edges are dealt to one task together.
NEAR = 100


def parts_for(rows: int, least: int) -> int:
    """How many tasks or buckets so many edges take: at least ``least``, and as many more as there are more edges."""
    return max(least, -(-rows // TASK_EDGES))


def combine(graphs: list[DataFrame], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The largest weight of each pair over all graphs.

    With ``parts`` (see parts_for) edges are dealt to so many tasks, those of a square
    of NEAR positions to one, so that a task's memory doesn't grow with the input and
    what is summed by position next finds its rows together. It is for lists whose
    pairs are repeated a few times: rows, not the largest of a task, pass the shuffle.
    """
    both = canonical(reduce(lambda x, y: x.unionByName(y), [g.select(*by, "loc_a", "loc_b", "r") for g in graphs]))
    if parts is None:
        return both.groupBy(*by, "loc_a", "loc_b").agg(F.max("r").alias("r"))
    near = [F.floor(F.col(c) / NEAR).alias(f"_{c}") for c in ("loc_a", "loc_b")]
    dealt = both.select("*", *near).repartition(parts, *by, "_loc_a", "_loc_b")
    # grouped by the squares too, so that the largest are found where the edges are
    return dealt.groupBy(*by, "_loc_a", "_loc_b", "loc_a", "loc_b").agg(F.max("r").alias("r")).drop("_loc_a", "_loc_b")


def merge(tables: list[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The largest weight of each pair over tables of canonical edges (sinks.write_bucketed): combine without a shuffle, as all edges of a left end lie in one bucket of each."""
    # the filter drops no canonical edge, but makes rows of columns: a union of columnar scans says that it keeps their buckets and doesn't (4.1.2);
    # one that rules out nulls would hide the buckets from the union
    rows = [t.select(*by, "loc_a", "loc_b", "r").where("loc_a < loc_b OR loc_a IS NULL") for t in tables]
    both = reduce(lambda x, y: x.unionByName(y), rows)
    return both.groupBy(*by, "loc_a", "loc_b").agg(F.max("r").alias("r"))


def degree_of_buckets(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As degree, of merged tables: only the sums of right ends are shuffled, to the left ends' buckets."""
    own = edges.groupBy(*by, "loc_a").agg(F.sum("r").alias("k_a")).withColumnRenamed("loc_a", "pos")
    other = edges.groupBy(*by, F.col("loc_b").alias("pos")).agg(F.sum("r").alias("k_b"))
    return own.join(other, [*by, "pos"], "full").select(*by, "pos", (F.coalesce("k_a", F.lit(0.0)) + F.coalesce("k_b", F.lit(0.0))).alias("k"))


def positions(graphs: list[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Every end of any edge, once."""
    ends = [g.select(*by, F.explode(F.array("loc_a", "loc_b")).alias("pos")) for g in graphs]
    return reduce(lambda x, y: x.unionByName(y), ends).distinct()


def degree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(pos, k): the weights of all edges at a position."""
    return edges.select(*by, F.explode(F.array("loc_a", "loc_b")).alias("pos"), "r").groupBy(*by, "pos").agg(F.sum("r").alias("k"))


def total_weight(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(m): the weight of all edges. All weights 0 is an error."""
    m = F.sum("r")
    return edges.groupBy(*by).agg(F.when(m > 0, m).otherwise(F.raise_error(F.lit("all weights are 0")).cast("double")).alias("m"))


def normalized_degree(edges: DataFrame, scaler: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(pos, k, k_norm): degrees over the root of 2 m scaler. The total is a row for each group of ``by``."""
    k, m = degree(edges, by), total_weight(edges, by)
    both = k.join(F.broadcast(m), list(by)) if by else k.crossJoin(F.broadcast(m))  # one row
    return both.select(*by, "pos", "k", (F.col("k") / F.sqrt(2 * F.col("m") * scaler)).alias("k_norm"))


def background(edges: DataFrame, distance: int, by: Sequence[str] = ()) -> DataFrame:
    """(n_edges, n_long, penalty): mean plus two population deviations of edges longer than ``distance``. None is an error."""
    long = F.col("loc_b") - F.col("loc_a") > distance
    r = F.when(long, F.col("r"))
    value = F.avg(r) + 2 * F.stddev_pop(r)
    missing = F.raise_error(F.lit(f"no edge is longer than {distance}")).cast("double")
    return edges.groupBy(*by).agg(F.count("*").alias("n_edges"), F.count(r).alias("n_long"), F.when(F.count(r) > 0, value).otherwise(missing).alias("penalty"))


def longer(edges: DataFrame, distance: int) -> DataFrame:
    """Edges longer than ``distance``."""
    return edges.where(F.col("loc_b") - F.col("loc_a") > distance)


def bucket(column: Column, buckets: int) -> Column:
    """The bucket of a left end: all edges of a left end share one."""
    return F.pmod(F.hash(column), F.lit(buckets))


def subset(edges: DataFrame, start: int, stop: int) -> DataFrame:
    return edges.where((F.col("loc_a") >= start) & (F.col("loc_b") <= stop))


def by_chunk(edges: DataFrame, chunks: DataFrame, buckets: int, width: int = 1_000_000, by: Sequence[str] = ()) -> DataFrame:
    """Edges of every chunk they lie in (from its start to its buffer's end), with sub_bucket. ``width``: about the length of a chunk."""
    found = within(edges, "loc_a", "loc_b", chunks.select(*by, "start_bp", "buffer_end_bp"), "start_bp", "buffer_end_bp", width, by)
    return found.withColumn("sub_bucket", F.col("loc_a") % buckets)
