"""Edge files that arrive over time. Degrees and totals stay up to date as files are added to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haploweave.operators import edges
from haploweave.sources import text


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def stream_edges(spark: SparkSession, folder: str, on_error: str = "fail") -> DataFrame:
    """Canonical edges of a folder's text files as they come. A malformed line ends the stream, or with ``on_error='skip'`` is left to stream_malformed."""
    if on_error == "skip":
        return edges.canonical(text.parse_edges(_lines(spark, folder), "keep").where("bad IS NULL").drop("bad"))
    return edges.canonical(text.parse_edges(_lines(spark, folder), on_error))


def stream_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """``line``: what a folder's text files hold that isn't an edge, for a sink of its own."""
    return text.parse_edges(_lines(spark, folder), "keep").where("bad IS NOT NULL").selectExpr("bad AS line")


def stream_degrees(spark: SparkSession, folder: str, on_error: str = "fail") -> DataFrame:
    """(pos, k) of all edges so far; for the complete and update modes."""
    return edges.degree(stream_edges(spark, folder, on_error))
