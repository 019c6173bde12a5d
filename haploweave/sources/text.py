"""Text files of white-space separated fields, with fixed schemas.

Files end with or without a line break; every line counts. A folder stands for
its files; several paths are given as a list or separated by commas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haploweave import schemas

_UINT = r"\d+"
_DOUBLE = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def paths_of(paths: str | Sequence[str]) -> list[str]:
    found = [p for p in (paths.split(",") if isinstance(paths, str) else paths) if p]
    if not found:
        raise ValueError("no input path is given")
    return found


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``line`` of all files; folders aren't searched below their own files."""
    return spark.read.text(paths_of(paths)).withColumnRenamed("value", "line")


def fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _position(text: Column) -> Column:
    """LONG, or null beyond unsigned 32 bits."""
    value = text.try_cast("long")
    return F.when((F.length(text) <= 19) & (value <= schemas.MAX_POSITION), value)


def parse_edges(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """loc_a, loc_b, r of lines with exactly two unsigned numbers and a number.

    Any other line (blank, header, a field too few or many, a sign on a position)
    is an error, or with ``on_error='keep'`` a row with nulls and its text in ``bad``.
    """
    pattern = rf"^\s*({_UINT})\s+({_UINT})\s+({_DOUBLE})\s*$"
    parts = [F.regexp_extract("line", pattern, i) for i in (1, 2, 3)]
    found = lines.select("line", _position(parts[0]).alias("loc_a"), _position(parts[1]).alias("loc_b"), parts[2].try_cast("double").alias("r"))
    good = F.col("loc_a").isNotNull() & F.col("loc_b").isNotNull() & F.col("r").isNotNull()
    if on_error == "keep":
        return found.select(*(F.when(good, F.col(c)).alias(c) for c in ("loc_a", "loc_b", "r")), F.when(~good, F.col("line")).alias("bad"))
    error = F.raise_error(F.concat(F.lit("not an edge: "), F.col("line")))
    return found.select(F.when(good, F.col("loc_a")).otherwise(error.cast("long")).alias("loc_a"), "loc_b", "r")


def read_edges(spark: SparkSession, paths: str | Sequence[str], on_error: str = "fail") -> DataFrame:
    return parse_edges(read_lines(spark, paths), on_error)


def parse_ids(lines: DataFrame) -> DataFrame:
    """``sample``: the names on all lines, once each."""
    return lines.select(F.explode(fields(F.col("line"))).alias("sample")).where("sample != ''").distinct()


def sample_rows(rows: DataFrame, n: int, keys: Sequence[str], seed: str = "sample") -> DataFrame:
    """``n`` of the rows, by a seeded hash of ``keys``: the same ones on every run."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *(F.col(k).cast("string") for k in keys))))
    return rows.orderBy(place, *keys).limit(n)


def sample_ids(ids: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """``n`` of the names."""
    return sample_rows(ids, n, ["sample"], seed)


def parse_panel(lines: DataFrame) -> DataFrame:
    """sample, pop, super_pop of a panel, without its header line."""
    f = fields(F.col("line"))
    return lines.select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("sample", "pop", "super_pop")))).where("sample != 'sample' AND super_pop IS NOT NULL")


def ids_by_super_pop(panel: DataFrame) -> DataFrame:
    """super_pop, samples (sorted), n_samples."""
    return panel.groupBy("super_pop").agg(F.sort_array(F.collect_list("sample")).alias("samples"), F.count("*").alias("n_samples"))


def read_placed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``line`` and ``place`` of all files: by name of the file, where in it a task begins to read, and the line's number within the task."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return spark.read.text(paths_of(paths)).select(F.col("value").alias("line"), place.alias("place"))


def parse_genetic_map(lines: DataFrame) -> DataFrame:
    """pos, cm of lines ``name position value``; of several lines for a position the last counts: by ``place`` where lines have it (read_placed), else as they come."""
    f = fields(F.col("line"))
    place = F.col("place") if "place" in lines.columns else F.monotonically_increasing_id()
    rows = lines.select(F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(2)).try_cast("double").alias("cm"), place.alias("at"))
    return rows.where("pos IS NOT NULL").groupBy("pos").agg(F.max_by("cm", "at").alias("cm"))


def read_table(spark: SparkSession, paths: str | Sequence[str], schema, by: Sequence[str] = ()) -> DataFrame:
    """A file of blank-separated numbers (positions, degrees, chunks, blocks, scores, breaks); other content is an error. ``by``: keys, texts, that folders are named by."""
    for key in by:
        schema = T.StructType([*schema.fields, T.StructField(key, T.StringType())])
    return spark.read.csv(paths_of(paths), schema=schema, sep=" ", mode="FAILFAST")


def read_value(spark: SparkSession, path: str) -> float:
    """The one number of a file; a missing or empty file is an error."""
    row = read_table(spark, path, schemas.VALUE).first()
    if row is None or row["value"] is None:
        raise ValueError(f"{path} holds no number")
    return row["value"]


def read_positions(spark: SparkSession, paths: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return read_table(spark, paths, schemas.POSITIONS, by)


def read_chunks(spark: SparkSession, paths: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return read_table(spark, paths, schemas.CHUNKS, by)


def read_blocks(spark: SparkSession, paths: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return read_table(spark, paths, schemas.BLOCKS, by)


def read_optimum(spark: SparkSession, scores: str, breaks: str, by: Sequence[str] = ()) -> DataFrame:
    """(pos, opt, brk) of the files of an earlier optimum; a position that only one of them has is an error."""
    both = read_table(spark, scores, schemas.OPT_SCORES, by).join(read_table(spark, breaks, schemas.OPT_BREAKS, by), [*by, "pos"], "full")
    lost = F.raise_error(F.concat(F.lit("no score or no break at "), F.col("pos").cast("string")))
    return both.select(*by, "pos", F.coalesce("opt", lost.cast("double")).alias("opt"), F.coalesce("brk", lost.cast("long")).alias("brk"))


def read_degree(spark: SparkSession, path: str, start: int, stop: int, by: Sequence[str] = ()) -> DataFrame:
    """Normalised degrees of positions from ``start`` to ``stop``."""
    return read_table(spark, path, schemas.DEGREE, by).where(F.col("pos").between(start, stop))
