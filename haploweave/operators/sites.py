"""Sites of a genotype table: counts, filters, moments and bit planes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.functions import genotype as g


def decode(calls: DataFrame, phased: bool) -> DataFrame:
    """``calls(pos, calls, ...)`` with scores and multiallelic."""
    scores, other = (g.phased_scores, g.phased_multiallelic) if phased else (g.unphased_scores, g.unphased_multiallelic)
    return calls.withColumn("scores", scores(F.col("calls"))).withColumn("multiallelic", other(F.col("calls"))).drop("calls")


def count_scores(sites: DataFrame) -> DataFrame:
    """``sites(scores)`` with n0, n1, n2, n_missing, n_present and mean (null without data)."""
    out = sites
    for name, value in (("n0", 0), ("n1", 1), ("n2", 2), ("n_missing", None)):
        out = out.withColumn(name, g.count_of(F.col("scores"), value))
    present = F.col("n0") + F.col("n1") + F.col("n2")
    return out.withColumn("n_present", present).withColumn("mean", F.when(present > 0, (F.col("n1") + 2 * F.col("n2")).cast("double") / present.cast("double")))


def with_reason(counted: DataFrame, maf: float | None = None, maf_on: str = "mean", phased: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``counted`` with ``reason``: why a site is removed, or null.

    In this order: multiallelic (also for a position on several rows), missing (no
    data), no_variation (all scores equal), maf (the mean score, or with
    ``maf_on='frequency'`` the allele's frequency, is not between maf and 1 - maf).
    """
    rows = row_counts(counted, by).join(counted.groupBy(*by, "pos").agg(F.bool_or("multiallelic").alias("any_multiallelic")), [*by, "pos"])
    value = F.col("mean") / (1.0 if phased or maf_on == "mean" else 2.0)
    n = F.col("n_present")
    reason = F.when((F.col("n_rows") != 1) | F.col("any_multiallelic"), "multiallelic").when(n == 0, "missing").when((F.col("n0") == n) | (F.col("n1") == n) | (F.col("n2") == n), "no_variation")
    if maf is not None:
        reason = reason.when((value <= maf) | (value >= 1 - maf), "maf")
    return counted.join(rows, [*by, "pos"]).withColumn("reason", reason).drop("n_rows", "any_multiallelic")


def row_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(pos, n_rows): how many rows a position has; more than one counts as multiallelic."""
    return rows.groupBy(*by, "pos").agg(F.count("*").alias("n_rows"))


def reason_counts(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sites.where("reason IS NOT NULL").groupBy(*by, "reason").agg(F.countDistinct("pos").alias("n_sites"))


def high_missingness(sites: DataFrame, share: float = 0.1) -> DataFrame:
    """Sites where at least ``share`` of the calls are missing."""
    return sites.where(F.col("n_missing") >= share * (F.col("n_missing") + F.col("n_present")))


def variance(counted: DataFrame) -> DataFrame:
    """``counted`` with the sample variance of the scores that are present."""
    n, squares = F.col("n_present").cast("double"), (F.col("n1") + 4 * F.col("n2")).cast("double")
    return counted.withColumn("variance", F.when(F.col("n_present") > 1, (squares - n * F.col("mean") * F.col("mean")) / (n - 1)))


def pack(counted: DataFrame, width: int) -> DataFrame:
    """Sites with planes het, hom and missing instead of ``width`` scores: the input of the pair join."""
    planes = {name: g.plane(F.col("scores"), width, value) for name, value in (("het", 1), ("hom", 2), ("missing", None))}
    return counted.select(*(c for c in counted.columns if c != "scores"), *(p.alias(n) for n, p in planes.items()))
