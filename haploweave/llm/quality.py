"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one over documents labelled
good, one over all documents. A document's log weight is the log ratio of its
probabilities under the two, tempered by its length: the mean of its n-grams' log
ratios, times as many n-grams as a text's evidence counts for (EVIDENCE at most),
so that long texts don't decide by length and noise matters for all. Documents
are sampled without replacement in proportion to their weights: each gets its log
weight plus seeded standard Gumbel noise, and the k largest stay. k is a
parameter; without one, it is as many as the labels say are good.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haploweave.llm._io import as_bytes, chunks, materialize, may_be_among, pieces, table, unused

#: Hash buckets of the models: what the driver gathers and sends is bounded by them.
BUCKETS = 1 << 14
#: Where k isn't given: the share of held-out good documents that may be left out by the sample.
MISSED = 0.0005
#: A text of n n-grams counts as n * EVIDENCE / (n + EVIDENCE) independent ones: all of a short one, never more than this.
EVIDENCE = 64
#: Runs of letters and digits (any non-ASCII byte counts as one) or of other marks.
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD], np.uint64)


def buckets_of(text: bytes):
    """Arrays of the buckets of a text's n-grams: tokens, pairs of tokens, and which of the two tokens before a token repeats."""
    last = np.zeros(0, np.uint64)
    for _, part in chunks(text.lower()):
        words = TOKEN.findall(part)
        if not words:
            continue
        new = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
        h = np.concatenate([last, new])
        lead = len(last)
        pairs = (h[:-1] * _MULTIPLIERS[0]) ^ (h[1:] * _MULTIPLIERS[1])
        repeats = np.zeros(len(h), np.uint64)
        repeats[1:] |= (h[1:] == h[:-1]).astype(np.uint64)
        repeats[2:] |= (h[2:] == h[:-2]).astype(np.uint64) << np.uint64(1)
        grams = [new * _MULTIPLIERS[2], pairs[max(0, lead - 1) :] * _MULTIPLIERS[3], (repeats[lead:] + np.uint64(1)) * _MULTIPLIERS[0]]
        last = h[-2:]
        yield ((np.concatenate(grams) >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches):
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in pieces(batches):
        for is_good, text in zip(batch.column("known").to_pylist(), as_bytes(batch.column("text")), strict=True):
            for at in buckets_of(text):
                found = np.bincount(at, minlength=BUCKETS)
                raw += found
                if is_good:
                    good += found
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], names=["bucket", "raw", "good"])


def _good(labels: DataFrame, held_out: bool) -> DataFrame:
    """All identifiers labelled good: three quarters make the target model, the others set the cut, as new documents would."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    part = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0
    return good.where(part if held_out else ~part)


def _marked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with ``known``: whether ``id`` is one of ``targets``, a table of one long column without repeats. Only texts of rows that may be are dealt out by their identifiers."""
    among = may_be_among(F.col("id"), targets)
    rest = rows.where(~among).withColumn("known", F.lit(False))
    near = rows.where(among).join(targets.select(F.col("doc_id").alias("id"), F.lit(True).alias("found")), "id", "left")
    return rest.unionByName(near.select("id", "text", F.col("found").isNotNull().alias("known")))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of the two models for each bucket. Where no target document is there (few labels), the held-out ones make the model; without these, too, all are 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    for held_out in (False, True):
        marked = _marked(rows, _good(labels, held_out)).select("text", "known")
        counts = marked.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
        for r in counts.toArrow().to_batches():
            raw[r.column(0).to_numpy()] += r.column(1).to_numpy()
            good[r.column(0).to_numpy()] += r.column(2).to_numpy()
        if good.sum() > BUCKETS:
            return np.log(good / good.sum()) - np.log(raw / raw.sum())
    return np.zeros(BUCKETS)


def log_weight(text: bytes, ratios: np.ndarray) -> float:
    total, n = 0.0, 0
    for at in buckets_of(text):
        total, n = total + float(ratios[at].sum()), n + len(at)
    return total * EVIDENCE / (n + EVIDENCE)


def weigh(docs: DataFrame, ratios: np.ndarray, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ``name``: each row's log weight; 0 for texts without n-grams."""

    def score(batches):
        for batch in pieces(batches, text):
            weights = [log_weight(x, ratios) for x in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel_key(weight, doc_id, seed: int):
    """The log weight plus standard Gumbel noise that doc_id and the seed fix: the largest key is a draw in proportion to the weights."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(unit))


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest ``key``, found by histograms that narrow to its bin; the bins, never the rows, reach the driver."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    for _ in range(5):
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / 4096
        if width <= abs(low) * 1e-15:
            break
        bins = inside.groupBy(F.least(F.floor((F.col(key) - low) / width), F.lit(4095)).alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= 10_000 or low == high:
            break
    left = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(key).count().collect()
    for value, n in sorted(left, reverse=True):
        above += n
        if above >= k:
            return value
    return low


def resample(scored: DataFrame, weight: str, labels: DataFrame, k: int | None = None, seed: int = 11) -> tuple[float, int]:
    """(least key that stays, k) for ``scored(doc_id, weight)``. Without ``k``: how many rows reach the key that all but MISSED of the held-out good documents reach, each of which counts; where none of these is there (few labels), the others set the cut."""
    keys = scored.select("doc_id", gumbel_key(F.col(weight), F.col("doc_id"), seed).alias("key"))
    if k is None:
        for held_out in (True, False):
            known = materialize(keys.join(_good(labels, held_out), "doc_id", "left_semi").select("key"), "quality-known")
            n = known.count()
            if n:
                cut = kth_largest(known, "key", n - max(1, math.ceil(n * MISSED)) + 1)
                return cut, keys.where(F.col("key") >= cut).count()  # it is a row's key, so the k-th largest
        return float("-inf"), keys.count()
    rows = keys.count()
    if not 0 < k < rows:
        return (float("-inf"), rows) if k > 0 else (float("inf"), 0)
    return kth_largest(keys.select("key"), "key", k), k


def select_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """One row for each row of ``docs``: doc_id, log_weight, gumbel_key, selected.

    Null and empty texts weigh 0. Rows that tie with the k-th key (repeated rows)
    stay together; with ``k`` over the number of rows all stay. Without labelled
    good documents all weights are 0, and without ``k`` every row stays. Null
    identifiers share one noise. Other columns are not read. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = materialize(weigh(docs, fit(docs, labels), "log_weight").drop("text"), "quality")
    least, _ = resample(scored, "log_weight", labels, k, seed)
    key = gumbel_key(F.col("log_weight"), F.col("doc_id"), seed)
    return scored.select("doc_id", "log_weight", key.alias("gumbel_key"), (key >= least).alias("selected"))


def keep_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, that select_quality selects. Weights are made again rather than joined to the texts."""
    name = unused(docs.columns, "log_weight")
    ratios = fit(docs, labels)
    scored = materialize(weigh(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ratios, name).drop("text"), "quality")
    least, _ = resample(scored, name, labels, k, seed)
    return weigh(docs, ratios, name).where(gumbel_key(F.col(name), F.col("doc_id").cast("long"), seed) >= least).drop(name)


def op2_quality(spark, sf_dir):
    return select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), "quality"))
