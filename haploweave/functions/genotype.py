"""Genotype calls as expressions: scores, counts, and bit planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a plane's word that are used; all of a LONG.
BITS = 64


def _allele(call: Column, at: int) -> Column:
    return F.substring(call, at, 1)


def phased_scores(calls: Column) -> Column:
    """Scores of both haplotypes of each call, one after the other: 0 or 1, null where missing or of another allele."""
    one = lambda a: F.when(a == "0", 0).when(a == "1", 1)
    return F.flatten(F.transform(calls, lambda c: F.array(one(_allele(c, 1)), one(_allele(c, 3)))))


def phased_multiallelic(calls: Column) -> Column:
    other = lambda a: ~a.isin("0", "1", ".")
    return F.exists(calls, lambda c: other(_allele(c, 1)) | other(_allele(c, 3)))


def unphased_scores(calls: Column) -> Column:
    """Copies of the second allele in each call: 0, 1 or 2, null where either is missing or is a further allele."""
    return F.transform(calls, lambda c: F.when(_allele(c, 1).isin("0", "1") & _allele(c, 3).isin("0", "1"), _allele(c, 1).cast("int") + _allele(c, 3).cast("int")))


def unphased_multiallelic(calls: Column) -> Column:
    """Any call without missing alleles that has one beyond 0 and 1."""
    known = lambda a: a != "."
    other = lambda a: ~a.isin("0", "1")
    return F.exists(calls, lambda c: known(_allele(c, 1)) & known(_allele(c, 3)) & (other(_allele(c, 1)) | other(_allele(c, 3))))


def count_of(scores: Column, value: int | None) -> Column:
    return F.size(F.filter(scores, lambda s: s.isNull() if value is None else s == value)).cast("long")


def plane(scores: Column, width: int, value: int | None) -> Column:
    """Words whose bits tell which scores equal ``value`` (None: are missing), for ``width`` scores."""
    hit = lambda s: s.isNull() if value is None else F.coalesce(s == value, F.lit(False))
    words = []
    for at in range(0, width, BITS):
        part = F.slice(scores, at + 1, min(BITS, width - at))
        indexed = F.transform(part, lambda s, i: F.when(hit(s), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(indexed, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


def common_bits(left: Column, right: Column, words: int) -> Column:
    """How many bits two planes have in common. Few words are written out, so that the sum stays in generated code."""
    if words <= 32:
        return sum((F.bit_count(left[i].bitwiseAND(right[i])) for i in range(words)), F.lit(0)).cast("long")
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b).cast("long")
