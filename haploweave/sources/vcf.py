"""Genotype tables in VCF text: one line a site, one column an individual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.sources.text import fields

#: The header's words before the individuals, fixed by the format.
FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def samples_in(lines: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(column, sample) of the header line; with ``ids(sample)`` only those asked for."""
    header = lines.where(F.col("line").startswith("#CHROM")).select(F.posexplode(fields(F.col("line"))).alias("column", "sample"))
    header = header.where(~F.col("sample").isin(FIXED))
    return header if ids is None else header.join(ids, "sample", "left_semi").select("column", "sample")


def scan(lines: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """chrom, pos, calls (array of text, one for each selected individual) of every data line.

    The header is one line, so its columns are looked up once; no other column is
    decoded. No selected individual is an error.
    """
    columns = sorted(r["column"] for r in samples_in(lines, ids).collect())
    if not columns:
        raise ValueError("no individual is selected")
    f = fields(F.col("line"))
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select(f.alias("f"))
    calls = F.slice("f", columns[0] + 1, len(columns)) if columns == list(range(columns[0], columns[0] + len(columns))) else F.array(*(F.get("f", F.lit(c)) for c in columns))
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), calls.alias("calls"))
