"""A corpus pipeline: quality, exact dedup, near dedup, mixing and packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploweave.llm._io import materialize, small_batches, table, text_key, unused
from haploweave.llm.exact_dedup import drop_exact_duplicates
from haploweave.llm.mixing import mix, sized
from haploweave.llm.packing import pack, token_pieces
from haploweave.llm.quality import keep_quality
from haploweave.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones selects."""
    small_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), "quality"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    small_batches(spark)
    return drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it doesn't take go. Repeated rows, of one doc_id and text, are taken alike."""
    small_batches(spark)
    name = unused(docs.columns, "mixed")
    own = [docs["doc_id"].cast("long"), *text_key(docs["text"])]
    keys = [f"{name}_{i}" for i in range(3)]
    copies = mix(sized(docs, h0=own[1], h1=own[2])).groupBy(*(F.col(c).alias(k) for c, k in zip(("doc_id", "h0", "h1"), keys, strict=True))).agg(F.max("copies").cast("int").alias(name)).where(f"{name} > 0")
    taken = docs.join(copies, [x.eqNullSafe(F.col(k)) for x, k in zip(own, keys, strict=True)])
    return taken.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(name)))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its place in a sequence."""
    small_batches(spark)
    return pack(token_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("mixing", mixing), ("packing", packing)]
#: Resampling, SimHash and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
