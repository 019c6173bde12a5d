"""Squared correlation of all pairs of sites within a distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haploweave.functions import genotype as g
from haploweave.functions.statistics import theta
from haploweave.operators.ranges import range_join

#: Beyond this a value is an error; from here down to 1 it is taken as 1.
ERROR = 1.01
_SIDE = ("pos", "n_present", "n_missing", "mean", "variance", "het", "hom", "missing")


def pair_counts(sites: DataFrame, distance: int, words: int, unphased: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """For each pair, both sides' columns (a_, b_), ``inner`` (sum of products) and ``n`` (present count with overlap of missing)."""
    extra = [c for c in sites.columns if c == "cm"]
    sides = [sites.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in (*_SIDE, *extra))) for s in "ab"]
    pairs = range_join(*sides, "a_pos", "b_pos", distance, by, least=1)
    bits = lambda x, y: g.common_bits(F.col(f"a_{x}"), F.col(f"b_{y}"), words)
    inner = bits("het", "het")
    if unphased:  # a phased haplotype never holds two copies
        inner = inner + 2 * bits("het", "hom") + 2 * bits("hom", "het") + 4 * bits("hom", "hom")
    n = F.col("a_n_present") + bits("missing", "missing") - F.col("b_n_missing")
    return pairs.withColumn("inner", inner).withColumn("n", n).drop(*(f"{s}_{p}" for s in "ab" for p in ("het", "hom", "missing")))


#: Left sites, and right sites, of one product of scores.
LEFT, RIGHT = 256, 1024


def _unpacked(planes: list[np.ndarray], kind) -> np.ndarray:
    """Scores of some sites from planes of one and two copies."""
    out = None
    for copies, plane in enumerate(planes, 1):
        bits = np.unpackbits(plane.view(np.uint8), axis=1, bitorder="little")
        out = bits.astype(kind) * copies if out is None else out + bits.astype(kind) * copies
    return out


class _Band:
    """The sites of one tile, in order, and those in reach of them."""

    def __init__(self, columns: dict[str, np.ndarray], planes: dict[str, np.ndarray], owned: np.ndarray, distance: int):
        self.columns, self.planes, self.distance = columns, planes, distance
        self.lefts = np.flatnonzero(owned)
        bits = 64 * planes["het"].shape[1]
        # sums of products of scores up to two are whole numbers up to 4 * bits
        self.kind = np.float32 if 4 * bits < 1 << 24 else np.float64

    def pairs(self):
        """(left, right, inner, n) by blocks: places of all pairs in reach, the sum of their products, and how many have both scores."""
        pos, c = self.columns["pos"], self.columns
        scored = [self.planes[p] for p in ("het", "hom") if p in self.planes]
        gaps = self.planes["missing"].any(1)
        for x in range(0, len(self.lefts), LEFT):
            left = self.lefts[x : x + LEFT]
            first, last = left[0] + 1, np.searchsorted(pos, pos[left[-1]] + self.distance, "right")
            a = _unpacked([p[left] for p in scored], self.kind)
            a_gaps = _unpacked([self.planes["missing"][left]], self.kind) if gaps[left].any() else None
            for y in range(first, last, RIGHT):
                right = np.arange(y, min(y + RIGHT, last))
                gap = pos[right][None] - pos[left][:, None]
                i, j = np.nonzero((gap >= 1) & (gap <= self.distance))
                if not len(i):
                    continue
                inner = (a @ _unpacked([p[right] for p in scored], self.kind).T)[i, j].astype(np.float64)
                both = 0.0
                if a_gaps is not None and gaps[right].any():
                    both = (a_gaps @ _unpacked([self.planes["missing"][right]], self.kind).T)[i, j].astype(np.float64)
                i, j = left[i], right[j]
                yield i, j, inner, c["n_present"][i] + both - c["n_missing"][j]


def _bands(by: Sequence[str], distance: int, unphased: bool, extra: Sequence[str], value, least: float):
    """Pairs (by, loc_a, loc_b, r2, bad) of rows in order of tile and position. ``value(columns, i, j, covariance)`` gives r2."""
    names = ["pos", "n_present", "n_missing", "mean", "variance", *extra]
    held = ["het", *(["hom"] if unphased else []), "missing"]

    def results(key, parts):
        columns = {n: np.concatenate([p[n] for p in parts]) for n in names}
        planes = {n: np.concatenate([p[n] for p in parts]) for n in held}
        owned = np.concatenate([p["owned"] for p in parts])
        for i, j, inner, n in _Band(columns, planes, owned, distance).pairs():
            with np.errstate(all="ignore"):
                r2 = value(columns, i, j, (inner - n * columns["mean"][i] * columns["mean"][j]) / (n - 1))
                bad = ~((r2 <= ERROR) & (r2 >= 0))
                r2 = np.where(~bad & (r2 > 1), 1.0, r2)
                on = bad | (r2 >= least)
            m = int(on.sum())
            if m:
                keys = [pa.array([k] * m) for k in key[:-1]]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x[on]) for x in (columns["pos"][i], columns["pos"][j], r2, bad))], names=[*by, "loc_a", "loc_b", "r2", "bad"])

    def band(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_pylist() for c in (*by, "tile")]
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*names, "owned")}
            columns |= {n: batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in held}
            own = list(zip(*keys, strict=True))
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if own[x] != key and parts:
                    yield from results(key, parts)
                    parts = []
                key = own[x]
                parts.append({n: v[x:y] for n, v in columns.items()})
        if parts:
            yield from results(key, parts)

    return band


def _correlated(sites: DataFrame, distance: int, least: float, unphased: bool, extra: Sequence[str], value, by: Sequence[str]) -> DataFrame:
    """Sites are dealt to tiles of the distance, each to its own and to the one before it: planes are shuffled twice, however many pairs there are."""
    width = max(int(distance), 1)
    own = F.floor(F.col("pos") / width)
    held = ["het", *(["hom"] if unphased else []), "missing"]
    dealt = sites.select(*by, F.explode(F.array(own, own - 1)).alias("tile"), "pos", *(F.col(c).cast("double").alias(c) for c in ("n_present", "n_missing", "mean", "variance", *extra)), *held)
    dealt = dealt.withColumn("owned", F.floor(F.col("pos") / width) == F.col("tile")).repartition(*by, "tile").sortWithinPartitions(*by, "tile", "pos")
    fields = [*(sites.schema[c] for c in by), *(T.StructField(n, t) for n, t in (("loc_a", T.LongType()), ("loc_b", T.LongType()), ("r2", T.DoubleType()), ("bad", T.BooleanType())))]
    return dealt.mapInArrow(_bands(by, int(distance), unphased, extra, value, least), T.StructType(fields))


def correlate(sites: DataFrame, distance: int, least: float = 0.0, unphased: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(loc_a, loc_b, r2, bad) of all pairs of ``sites`` within ``distance``.

    Means are over each site's own scores, so r2 may exceed 1 where scores are
    missing: above 1.01 (or not a number) a pair is marked ``bad`` instead of
    ending the run, below it is 1. A tile's inner products are matrix products of
    its sites' scores.
    """

    def value(c, i, j, covariance):
        return covariance * covariance / (c["variance"][i] * c["variance"][j])

    return _correlated(sites, distance, least, unphased, (), value, by)


def correlate_shrunk(sites: DataFrame, distance: int, individuals: int, effective_size: float, least: float = 0.0, unphased: bool = False, kind: str = "single", by: Sequence[str] = ()) -> DataFrame:
    """As correlate, with covariances shrunk by the map distance of ``sites.cm`` and variances by the mutation parameter."""
    t = theta(individuals, kind)

    def value(c, i, j, covariance):
        decay = np.exp((c["cm"][i] - c["cm"][j]) * (4.0 * effective_size / (2.0 * individuals)))
        covariance = (1 - t) ** 2 * decay * covariance
        shrunk = [(1 - t) ** 2 * c["variance"][x] + t / 2 * (1 - t / 2) for x in (i, j)]
        return covariance * covariance / (shrunk[0] * shrunk[1])

    return _correlated(sites, distance, least, unphased, ("cm",), value, by)


def without_map(sites: DataFrame, genetic_map: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sites that the map lacks, removed ones too. Shrinkage needs this to be empty."""
    return sites.join(genetic_map, [*by, "pos"], "left_anti").select(*by, "pos").distinct()


def with_map(sites: DataFrame, genetic_map: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sites.join(genetic_map.select(*by, "pos", "cm"), [*by, "pos"])
