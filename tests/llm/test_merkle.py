"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from haploweave.llm import merkle


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(b"".join(b"-" if v is None else str(len(x := str(v).encode())).encode() + b":" + x for v in fields))


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        start = i // arity * arity
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + arity])))
        i //= arity
    return out


def is_tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


TAMPERED = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def plain(rows, arity=16):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [tree([leaf(r, r["text"]) for r in groups[s]], arity) for s in order]
    top = tree([t[-1][0] for t in trees], arity)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = path(trees[k], i, arity) + path(top, k, arity)
            back = leaf(r, lower(r["text"]) if is_tampered(r["doc_id"]) else r["text"])
            for a, b in steps:
                back = digest(a + back + b)
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), back, back == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted((tuple(r) for r in merkle.manifest(docs, F.expr(TAMPERED), **options).collect()), key=str)


@pytest.mark.parametrize("options", [{"part_rows": 23, "fan_in": 2}, {"part_rows": 50, "arity": 3}])
def test_manifest_by_plain_trees(spark, sf_dir, options):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(docs.collect(), options.get("arity", 16))
    assert found(docs, **options) == want
    assert {v for *_, v in want} == {True, False}


def test_many_sources(spark, sf_dir):
    """More sources than siblings, some of one row, and one with a third of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("Ä")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("s"), F.col("doc_id"))))
    assert found(docs, part_rows=40, fan_in=3) == plain(docs.collect())


@pytest.mark.parametrize("rows", [0, 1, 2, 17])
def test_few_rows(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(rows)
    docs = docs.withColumn("source", F.lit("one"))
    assert found(docs) == (plain(docs.collect()) if rows else [])


def test_odd_rows(spark):
    """Nulls anywhere, an empty source beside a null one, repeated rows, a long text, other columns."""
    long = "Word " * 200_000
    rows = [(1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "abc"), (None, None, None, None, None), (None, "", None, 0, ""), (2, None, "en", 5, long), (3, "é", "fr", None, "É"), (4, "Z", "", 1, None)]
    rows += [(i, "a", None, i, f"X{i}") for i in range(5, 300)] + [(7, "hot", "en", 1, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(5)
    want = plain(docs.collect())
    odd = docs.withColumns({n: F.lit("x") for n in ("row", "part", "place", "tree", "leaf", "tampered", "first", "index", "n")})
    assert found(odd, part_rows=64) == want
    assert len(want) == len(rows)


def test_merging_is_associative():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    nodes = [(0, 100, 0, i, d, 0, 0) for i, d in enumerate(leaves)]

    def fragment(own):
        out = merkle.Fragment(1, 4)
        for n in own:
            out.add(n)
        return out

    want = bytes.fromhex(tree([d.hex() for d in leaves], 4)[-1][0])
    a, b, c = nodes[:30], nodes[30:31], nodes[31:]
    assert fragment(a).merge(fragment(b)).merge(fragment(c)).root == want
    assert fragment(a).merge(fragment(b).merge(fragment(c))).root == want
    assert fragment(c).merge(fragment(a)).merge(fragment(b)).root == want
    assert len(list(fragment(a).nodes())) <= 2 * 3 * 4
