"""Inputs of the operators, derived from the tables that are at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haploweave.operators import blocks, edges, pairs, sites
from haploweave.sources import vcf

#: Scores at a site, and the longest distance of a pair.
WIDTH, LONGEST = 64, 50
#: The penalty of the scoring queries.
PENALTY = 0.06


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def vcf_lines(spark: SparkSession, sf_dir: str, phased: bool) -> DataFrame:
    """A genotype table as text. Phased: both halves of a vector give the haplotypes of 32 individuals; positions 10, 30, ... have a third allele, 20, 60, ... no variation.

    Unphased: 64 individuals, with missing calls.
    """
    rows = _vectors(spark, sf_dir)
    if phased:
        allele = lambda x: F.when(x > 0, "1").otherwise("0")
        calls = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.concat(allele(F.col("v")[2 * k]), F.lit("|"), allele(F.col("v")[2 * k + 1])))
        calls = F.when(F.col("pos") % 20 == 10, F.concat(F.array(F.lit("0|2")), F.slice(calls, 2, 31))).when(F.col("pos") % 40 == 20, F.transform(calls, lambda c: F.lit("0|0"))).otherwise(calls)
        n = 32
    else:
        call = lambda x, i: F.when((F.col("pos") * 7 + i) % 29 == 0, "./.").when(x < -0.05, "0/0").when(x < 0.05, "0/1").otherwise("1/1")
        calls, n = F.transform("v", call), WIDTH
    body = rows.select(F.concat_ws("\t", F.lit("1"), F.col("pos").cast("string"), *(F.lit(x) for x in (".", "A", "G", ".", ".", ".", "GT")), F.array_join(calls, "\t")).alias("line"))
    names = "\t".join([*vcf.FIXED, *(f"S{i}" for i in range(n))])
    head = spark.range(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit(names))).alias("line"))
    return head.unionByName(body)


def write_vcf(spark: SparkSession, sf_dir: str, folder: str, files: int = 4) -> None:
    """The phased table as several files, each with a header."""
    at = F.when(F.col("line").startswith("##"), 0).when(F.col("line").startswith("#"), 1).otherwise(2)
    part = F.when(F.col("at") < 2, F.sequence(F.lit(0), F.lit(files - 1))).otherwise(F.array(F.pmod(F.hash("line"), F.lit(files))))
    dealt = vcf_lines(spark, sf_dir, True).withColumn("at", at).withColumn("part", F.explode(part))
    dealt.repartition(files, "part").sortWithinPartitions("at").select("line").write.text(folder)


def counted(spark: SparkSession, sf_dir: str, phased: bool, ids: DataFrame | None = None) -> DataFrame:
    """pos, scores, multiallelic and counts of the text's sites."""
    return sites.count_scores(sites.decode(vcf.scan(vcf_lines(spark, sf_dir, phased), ids).drop("chrom"), phased))


def _doses() -> Column:
    return F.transform("v", lambda x, i: F.when((F.col("pos") * 7 + i) % 29 == 0, F.lit(None).cast("int")).when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2))


#: Vectors that make one wide site.
WIDE = 16


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of WIDE vectors each, with WIDTH individuals of every one; those of a vector that isn't there are missing."""
    rows = _vectors(spark, sf_dir).select((F.col("pos") % WIDE).cast("int").alias("k"), F.floor(F.col("pos") / WIDE).alias("at"), _doses().alias("own"))
    held = rows.groupBy(F.col("at").alias("pos")).agg(F.map_from_entries(F.collect_list(F.struct("k", "own"))).alias("m"))  # WIDE vectors at most
    none = F.array_repeat(F.lit(None).cast("int"), WIDTH)
    scores = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda k: F.coalesce(F.try_element_at("m", k), none)))
    return sites.pack(sites.variance(sites.count_scores(held.select("pos", scores.alias("scores")))), WIDE * WIDTH)


def scored_sites(spark: SparkSession, sf_dir: str, phased: bool) -> DataFrame:
    """Sites straight from the vectors: 64 haplotypes, or 64 individuals with missing calls."""
    rows = _vectors(spark, sf_dir)
    if phased:
        scores = F.transform("v", lambda x: F.when(x > 0, 1).otherwise(0))
    else:
        scores = _doses()
    return sites.variance(sites.count_scores(rows.select("pos", scores.alias("scores"))))


def packed(spark: SparkSession, sf_dir: str, phased: bool) -> DataFrame:
    return sites.pack(scored_sites(spark, sf_dir, phased), WIDTH)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the vectors' signs: r2 of phased sites."""
    found = pairs.correlate(packed(spark, sf_dir, True), LONGEST, 0.0, unphased=False)
    return found.select("loc_a", "loc_b", F.col("r2").alias("r"))


def chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chromosome(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos")))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list with repeated and reversed pairs, signs and loops."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("loc_a"), F.col("l_suppkey").alias("loc_b"), (sign * F.col("l_discount")).alias("r"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_items(spark, sf_dir)
    return edges.combine([raw], parts=edges.parts_for(raw.count(), spark.sparkContext.defaultParallelism))  # the count reads the files' ends only


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge list as text; every 1000th order gives a malformed line."""
    line = table(spark, sf_dir, "lineitem")
    good = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.format_string("%.2f", "l_discount"))
    return line.select(F.when(F.col("l_orderkey") % 1000 == 7, F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).otherwise(good).alias("line"))


def genetic_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, position and map position of all parts; every 40th position is left out."""
    part = table(spark, sf_dir, "part")
    pos = F.col("p_partkey") + F.floor(F.col("p_partkey") / 39)
    return part.select(F.concat_ws(" ", F.lit("rs"), pos.cast("string"), (F.col("p_partkey").cast("double") / 1000 + F.col("p_size") / 1e6).cast("string")).alias("line"))


def block_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partitions of a line of customers into blocks of about 100, with shifted bounds."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("p"))
    start = lambda k: k * 100 + (k * k * 7 + F.col("p") * 13) % 60
    return c.select(F.concat(F.lit("P"), F.col("p").cast("string")).alias("pop"), start(F.col("k")).cast("long").alias("block_start"), (start(F.col("k") + 1) - 1).cast("long").alias("block_end"))
