"""Writers of the text layouts, and of Parquet laid out for the joins that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six(value: Column) -> Column:
    """A number in six significant digits, as the text layouts print it."""
    return F.format_string("%.5e", value).cast("double").cast("string")


def write_text(rows: DataFrame, path: str, columns: list[Column], order: list[Column] | None = None, by: Sequence[str] = ()) -> None:
    """Blank-separated columns; sorted files keep their order across part files. With ``by``, a folder for each of its values."""
    rows = rows.orderBy(*by, *order) if order else rows
    rows.select(*by, F.concat_ws(" ", *columns).alias("value")).write.partitionBy(*by).text(path)


def write_edges(edges: DataFrame, path: str, compat: bool = False, by: Sequence[str] = ()) -> None:
    """``a b r``: r in full, or with ``compat`` in six decimals."""
    r = F.format_string("%.6f", F.col("r")) if compat else F.col("r").cast("string")
    write_text(edges, path, [F.col("loc_a").cast("string"), F.col("loc_b").cast("string"), r], by=by)


def write_positions(chrom: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    write_text(chrom, path, [F.col("pos").cast("string")], [F.col("pos")], by)


def write_degree(degree: DataFrame, path: str, compat: bool = False, by: Sequence[str] = ()) -> None:
    write_text(degree, path, [F.col("pos").cast("string"), six(F.col("k_norm")) if compat else F.col("k_norm").cast("string")], by=by)


def write_value(value: DataFrame, path: str, column: str, compat: bool = False, by: Sequence[str] = ()) -> None:
    write_text(value, path, [six(F.col(column)) if compat else F.col(column).cast("string")], by=by)


def write_chunks(chunks: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The rightmost chunk first."""
    write_text(chunks, path, [F.col(c).cast("string") for c in ("start_bp", "end_bp", "buffer_end_bp")], [F.desc("start_bp")], by)


def write_blocks(blocks: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    write_text(blocks, path, [F.col(c).cast("string") for c in ("block_start", "block_end")], [F.col("block_start")], by)


def write_intervals(intervals: DataFrame, path: str) -> None:
    """``start stop`` of half-open intervals, in order."""
    write_text(intervals, path, [F.col(c).cast("string") for c in ("start", "stop")], [F.col("start")])


def write_optimum(dp: DataFrame, scores: str, breaks: str, compat: bool = False, by: Sequence[str] = ()) -> None:
    write_text(dp, scores, [F.col("pos").cast("string"), six(F.col("opt")) if compat else F.col("opt").cast("string")], by=by)
    write_text(dp, breaks, [F.col("pos").cast("string"), F.col("brk").cast("string")], by=by)


def write_by_left_end(edges: DataFrame, path: str, buckets: int, by: Sequence[str] = ()) -> None:
    """Parquet in which all edges of a left end lie in one file."""
    edges.repartition(buckets, *by, "loc_a").sortWithinPartitions(*by, "loc_a", "loc_b").write.parquet(path)


def write_bucketed(edges: DataFrame, table: str, path: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """Canonical edges as a table, bucketed and sorted by left end, of one file a bucket; edges.merge and edges.degree_of_buckets use the layout where tables have as many buckets and the same ``by``."""
    rows = edges.repartition(buckets, *by, "loc_a")
    rows.write.bucketBy(buckets, *by, "loc_a").sortBy(*by, "loc_a", "loc_b").option("path", path).saveAsTable(table)
    return edges.sparkSession.table(table)


def write_by_chunk(edges: DataFrame, path: str) -> None:
    """Edges of every chunk (of edges.by_chunk) in a folder for each chunk and sub-bucket."""
    keys = ["start_bp", "buffer_end_bp", "sub_bucket"]
    edges.repartition(*keys).write.partitionBy(*keys).parquet(path)
