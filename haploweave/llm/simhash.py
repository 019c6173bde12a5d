"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at
most ``DISTANCE`` bits, some segment starts a chain in which, for every length l,
the first l segments differ in at most l * DISTANCE / SEGMENTS bits together. The
first two of these budgets (0 and 1 bits here) are tested by equality of keys:
each fingerprint files one key for each start, and one more for each set bit of
the second segment with that bit cleared. The longer chains are tested on the
pairs that share a key, before the full Hamming check.

A key's fingerprints are linked by a spanning forest, never by all pairs: small
groups are compared pairwise, larger ones by a search from the fingerprint that
is nearest to the group's majority. A key with too many fingerprints is dealt to
cells, one for each pair of its blocks, so that every pair still meets somewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import Filter, as_bytes, materialize, may_be_among, mixed, pieces, table, text_key, trimmed, unused
from haploweave.llm.components import components

DISTANCE, SEGMENTS = 4, 5
WIDTHS = [13, 13, 13, 13, 12]
STARTS = [0, 13, 26, 39, 52]
#: Fingerprints that one cell of a key compares among themselves, about.
CELL = 1 << 16
#: Groups up to this size are compared pairwise at once, for many keys together.
SMALL = 12
#: Words hashed at once, of a longer text.
PART = 1 << 16


def _masks(length: int) -> np.ndarray:
    """For each start, the bits of ``length`` consecutive segments of the ring."""
    return np.array([sum(((1 << WIDTHS[(i + k) % SEGMENTS]) - 1) << STARTS[(i + k) % SEGMENTS] for k in range(length)) for i in range(SEGMENTS)], np.uint64)


CHAINS = [(_masks(n), n * DISTANCE // SEGMENTS) for n in range(2, SEGMENTS + 1)]


def ones(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, in how many hashes it is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, k: int = 4) -> int:
    """The SimHash of a text's word k-shingles, repeats included; 0 without words."""
    words = text.lower().split()
    n = max(1, len(words) - k + 1) if words else 0
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        part = words[at : at + PART + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = min(PART, n - at)
        last = ends[k - 1 :][:m] if len(part) >= k else ends[-1:]
        counts += ones(np.array([digest(joined[s:e], 42) for s, e in zip(starts[:m].tolist(), last.tolist(), strict=True)], np.uint64))
    return majority(counts, n) if n else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment(f: np.ndarray, i: int) -> np.ndarray:
    return (f >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _own_keys(f: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """For each start, the key: salt, start, two segments."""
    return [(salt << 29) | (i << 26) | (_segment(f, i) << np.uint64(13) | _segment(f, (i + 1) % SEGMENTS)).astype(np.int64) for i in range(SEGMENTS)]


def _file(cleared: bool):
    def file(batches):
        for batch in batches:
            f, salt = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i, key in enumerate(_own_keys(f, salt)):
                rows = [(key, f, np.zeros(len(f), bool))]
                for b in range(WIDTHS[(i + 1) % SEGMENTS]) if cleared else ():
                    on = (key >> b) & 1 == 1
                    rows.append((key[on] ^ (1 << b), f[on], np.ones(int(on.sum()), bool)))
                keys, fps, probe = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.array(probe)], names=["key", "fp", "probe"])

    return file


def forest(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links at DISTANCE or less that connect what such links connect, searched from the group's centre outwards."""
    rest, found = np.unique(f), []
    centre = np.uint64(majority(ones(rest), len(rest)))
    rest = rest[np.argsort(np.bitwise_count(rest ^ centre), kind="stable")]
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= DISTANCE
            if near.any():
                y = rest[near]
                found.append((np.full(len(y), x), y))
                rest = rest[~near]
                front.extend(y)
    return found


def _link(batches):
    """Links within the groups of a stream that is sorted by key and cell."""

    def linked(key, cell, f, probe):
        edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        own = np.add.reduceat((~probe).astype(np.int64), starts)
        useful = (sizes > 1) & (own > 0)
        small = useful & (sizes <= SMALL)
        pick = np.repeat(small, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)[pick]
        k, g, p = (key[pick] >> 26) & 7, f[pick], probe[pick]
        a, b = [], []
        for d in range(1, SMALL):
            if len(g) <= d:
                break
            at = np.flatnonzero((group[d:] == group[:-d]) & ~(p[d:] & p[:-d]) & (g[d:] != g[:-d]))
            for masks, budget in CHAINS:
                x = g[at] ^ g[at + d]
                at = at[np.bitwise_count(x & masks[k[at]]) <= budget]
            a.append(g[at])
            b.append(g[at + d])
        for i in np.flatnonzero(useful & ~small):
            for x, y in forest(f[starts[i] : starts[i] + sizes[i]]):
                a.append(x)
                b.append(y)
        if a:
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            # many keys find the same link
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            salt = int(key[0] >> 29)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), salt)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["salt", "a", "b"])
        return None

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        now[2] = now[2].view(np.uint64)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        # the last group may go on; and one result holds one salt
        cut = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
        held = [x[cut:] for x in now]
        done = [x[:cut] for x in now]
        for s in np.unique(done[0] >> 29):
            on = done[0] >> 29 == s
            if (out := linked(*(x[on] for x in done))) is not None:
                yield out
    if held is not None and (out := linked(*held)) is not None:
        yield out


def link(fingerprints: DataFrame, cell: int = CELL) -> DataFrame:
    """(salt, a, b): links that connect all distinct ``fp`` of equal ``salt`` at DISTANCE bits or less."""
    fingerprints = fingerprints.select("fp", F.col("salt").cast("long"))
    rows = fingerprints.mapInArrow(_file(True), "key long, fp long, probe boolean")
    # a key's rows are its own and those of 13 neighbours at most
    own = fingerprints.mapInArrow(_file(False), "key long, fp long, probe boolean").groupBy("key").count()
    large = materialize(own.where(F.col("count") * 14 > cell).select("key"), "large-keys")
    if large.limit(1).count():
        around = large.select(F.explode(F.concat(F.array("key"), F.expr("transform(sequence(0, 12), b -> key & ~shiftleft(1L, b))"))).alias("key")).distinct()
        cells = rows.join(around, "key", "left_semi").groupBy("key").count().select("key", F.ceil(2 * F.col("count") / cell).alias("blocks")).where("blocks > 1")
        rows = rows.join(materialize(cells, "cells"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own_block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        rows = rows.withColumn("own", own_block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        rows = rows.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    else:
        rows = rows.withColumn("cell", F.lit(0).cast("long"))
    rows = rows.select("key", "cell", "fp", "probe").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return rows.mapInArrow(_link, "salt long, a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, cell: int = CELL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of the lower-cased (A-Z) words' k-shingles link at DISTANCE bits
    or less; a component is named by its smallest doc_id. Null and empty texts
    have fingerprint zero, linked like any other. Repeated rows and equal texts
    share a fingerprint. Null identifiers are members but never names, unless all
    are null. Other columns are not read. An empty table gives an empty result.
    """

    def mark(batches):
        for batch in pieces(batches):
            prints = [_signed(fingerprint(x, k)) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(docs.mapInArrow(mark, "doc_id long, fp long"), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = link(distinct.select("fp", F.lit(0).alias("salt")), cell)
    found = components(links).withColumnRenamed("node", "fp")
    members = materialize(found.join(distinct, "fp"), "simhash-members")
    names = members.groupBy("root").agg(F.min("first").alias("name"))
    named = distinct.join(members.join(names, "root").select("fp", "name"), "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


#: One document of so many tells which shingles are common; this only sets the order of search.
SAMPLED = 8
#: Sets that one cell of a shingle compares among themselves, about.
SETS = 1 << 13


def _similar(k: int, similarity: float):
    def check(batches):
        for batch in pieces(batches, "a_text"):
            kept = []
            for i, (x, y) in enumerate(zip(as_bytes(batch.column("a_text")), as_bytes(batch.column("b_text")), strict=True)):
                s, t = shingle_set(x, k), shingle_set(y, k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= similarity * (len(s) + len(t) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(kept, pa.int64())), batch.column("b").take(pa.array(kept, pa.int64()))], names=["a", "b"])

    return check


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Hashes, sorted, of a text's word k-shingles; of the whole sequence, if it has fewer words."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1) if words else 0
    total = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        total = mixed(total) + hashes[i : i + n]
    return np.unique(mixed(total))


def parities(shingles: np.ndarray, width: int) -> np.ndarray:
    """For each of ``width`` buckets (a power of two), whether it holds an odd number of shingles, as packed bits. Two sets differ in as many shingles at least."""
    at = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little")


def _close(similarity: float):
    """Pairs whose parities, folded to the narrower, differ in no more than similar sets may."""

    def close(batches):
        for batch in batches:
            a, b, n, m, wide, other = (c.to_pylist() for c in batch.columns)
            kept = []
            for i, (x, y) in enumerate(zip(wide, other, strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
                need = np.ceil(similarity / (1 + similarity) * (n[i] + m[i]) - 1e-6)
                if np.bitwise_count(x ^ y).sum(dtype=np.int64) <= n[i] + m[i] - 2 * need:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return close


def _shared(names: list[str]):
    """The rows of a stream sorted by its first column whose value there is not the only one, with ``at``: the how manieth of its value a row is."""

    def share(batches):
        last, place = None, 0  # the row before, and its place among its value's
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                now = [np.concatenate(x) for x in zip(last, now, strict=True)]
            same = now[0][1:] == now[0][:-1]
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            at = np.arange(len(now[0])) - np.repeat(starts, np.diff(np.concatenate((starts, [len(now[0])]))))
            if last is not None:
                at[: starts[1] if len(starts) > 1 else len(at)] += place
            on = (at > 0) | np.concatenate((same, [False]))
            last, place = [x[-1:] for x in now], int(at[-1])
            on[-1] = False  # comes with the next batch
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (*now, at)], names=[*names, "at"])
        if last is not None and place:
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in last), pa.array(np.array([place]))], names=[*names, "at"])

    return share


def _meet(similarity: float, low: int, high: int):
    """Pairs of a stream sorted by key, cell and row that are ``low`` to ``high`` - 1 places apart, or with the group's first in the first round.

    Left out are pairs of one component, and those that can't be similar: by their
    sizes, by the places of the key in both, or as the parities of their shingles
    in 512 buckets differ in more than their sets may.
    """

    def met(key, cell, doc, pos, n, comp, sketch):
        edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        group = np.repeat(np.arange(len(sizes)), sizes)
        found = []

        def test(i, j):
            on = comp[i] != comp[j]
            i, j = i[on], j[on]
            need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
            on = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6) & (np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            i, j, need = i[on], j[on], need[on]
            on = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= n[i] + n[j] - 2 * need
            found.append(np.stack([np.minimum(doc[i[on]], doc[j[on]]), np.maximum(doc[i[on]], doc[j[on]])], 1))

        if low == 1:
            test(np.repeat(starts, sizes), np.arange(len(key)))
        for d in range(low, min(high, int(sizes.max()))):
            test(i := np.flatnonzero(group[d:] == group[:-d]), i + d)
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    seen: set[tuple[int, int]] = set()

    def fresh(found: pa.RecordBatch) -> pa.RecordBatch:
        """Without pairs that this task has returned: sets that are alike share many keys."""
        if len(seen) > 500_000:
            seen.clear()
        new = [i for i, p in enumerate(zip(*(c.to_pylist() for c in found.columns), strict=True)) if p not in seen and not seen.add(p)]
        return found.take(pa.array(new, pa.int64()))

    def meet(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
            now.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[6:]], 1).view(np.uint64))
            # the last group may go on
            cut = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            if cut or (held and (held[0][0][0], held[0][1][0]) != (now[0][0], now[1][0])):
                done = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
                if len(done[0]):
                    yield fresh(met(*done))
                held = []
            held.append([c[cut:] for c in now])
        if held:
            yield fresh(met(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return meet


def _common(docs: DataFrame, k: int) -> Filter:
    """A filter over shingles that several documents of a sample have."""

    def each(batches):
        for batch in pieces(batches):
            found = [shingle_set(x, k) for x in as_bytes(batch.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    def hashes(batches):
        for batch in _shared(["key"])(batches):
            yield np.unique(batch.column(0).to_numpy()).view(np.uint64)

    keys = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(each, "key long")
    return Filter.gather(keys.repartition("key").sortWithinPartitions("key"), hashes, bits=26)


KEYS = ["doc_id", "h0", "h1"]


def near_duplicate_links(docs: DataFrame, **options) -> DataFrame:
    """(a, b): the doc_ids of links that connect all documents whose sets of word k-shingles have at least ``similarity`` in common (Jaccard). Documents of one doc_id are linked like any others."""
    sets, links = near_links(docs, **options)
    names = sets.select("row", "doc_id")
    return links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_links(docs: DataFrame, k: int = 5, similarity: float = 0.8, cell: int = SETS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, h0, h1, ...), a row for each document with a doc_id, and links (a, b) of rows.

    Documents are told apart by doc_id and two hashes of the text (h0, h1), so that
    one doc_id may have several texts.

    The search is exact. Equal sets are searched as one. Two sets that similar share
    one of the first n - similarity * n + 1 shingles of each, in any order common to
    all; here those that a sample finds common come last, so that a passage which
    many texts share brings no two of them together that share little else.

    SimHash comes first: fingerprints of the sets are linked by the pigeonring search
    (``link``), and linked ones checked. Similar sets may differ in far more bits (a
    fifth of a text replaced changes nine on average), so sets that share one of those
    first shingles then meet in rounds, ever further apart in its list, unless links
    verified before have connected them. Every pair that passes the filters of
    ``_meet`` and ``_close`` is checked on whole texts. The rounds end when no list
    is longer or holds two components. A crowded list is dealt to cells, one for
    each pair of its blocks.
    """
    h0, h1 = text_key(docs["text"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h0.alias("h0"), h1.alias("h1")).where("doc_id IS NOT NULL")
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, k))  # of fixed size

    def mark(batches):
        for batch in pieces(batches):
            rows = []
            for x in as_bytes(batch.column("text")):
                u = shingle_set(x, k)
                n = len(u)
                digest = np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), np.int64)
                sketch, wide = parities(u, 512).view(np.int64), parities(u, 1 << max(6, (4 * n).bit_length())).tobytes()
                known = common.value.hold(u)
                first = np.concatenate([u[~known], u[known]])[: n - int(np.ceil(similarity * n - 1e-6)) + 1] if n else u
                rows.append((n, int(digest[0]), int(digest[1]), _signed(majority(ones(u), n)) if n else 0, first.view(np.int64), sketch, wide))
            n, d0, d1, fp, first, sketch, wide = zip(*rows, strict=True)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(fp, pa.int64()), pa.array(first, longs), pa.array(sketch, longs), pa.array(wide, pa.binary())], names=[*KEYS, "n", "d0", "d1", "fp", "first", "sketch", "wide"])

    sets = docs.mapInArrow(mark, "doc_id long, h0 long, h1 long, n long, d0 long, d1 long, fp long, first array<long>, sketch array<long>, wide binary")
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "near-sets")
    names = sets.groupBy("d0", "d1").agg(F.min("row").alias("name"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    same = materialize(sets.select("row", "d0", "d1").join(names, ["d0", "d1"]).where("row != name"), "near-same")
    links = same.select(F.col("name").alias("a"), F.col("row").alias("b"))

    def of(rows: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of some identifiers; what a filter rules out isn't dealt out."""
        return rows.where(may_be_among(F.col("row"), ids)).join(ids, "row", "left_semi")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(row, text), once for each row; repeated rows of a document hold the same text."""
        keys = materialize(of(sets.select("row", *KEYS), ids), "near-keys")
        held = docs.where(may_be_among(F.col("doc_id"), keys.select("doc_id"))).join(keys, KEYS)
        return held.groupBy("row").agg(F.first("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are similar; texts are only dealt of pairs whose parities allow it."""
        pairs = materialize(pairs, "near-met")
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-ids")
        wide = of(sets.select("row", "n", "wide"), ids)
        pairs = pairs.join(wide.toDF("a", "n", "wide"), "a").join(wide.toDF("b", "m", "other"), "b").select("a", "b", "n", "m", "wide", "other")
        pairs = materialize(pairs.mapInArrow(trimmed(_close(similarity)), "a long, b long").distinct(), "near-pairs")
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-ids")
        held = texts_of(ids)
        texts = pairs.join(held.toDF("a", "a_text"), "a").join(held.toDF("b", "b_text"), "b")
        return materialize(texts.mapInArrow(_similar(k, similarity), "a long, b long"), "near-links")

    gone = may_be_among(F.col("row"), same.select("row"))
    own = sets.select("row", "d0", "d1", "n", "fp", "first")
    own = own.where(~gone).unionByName(own.where(gone).join(same.drop("name"), ["row", "d0", "d1"], "left_anti"))
    prints = materialize(own.groupBy("fp").agg(F.min("row").alias("one")), "near-prints")
    alike = own.select("row", "fp").join(prints, "fp").where("row != one").select(F.col("one").alias("a"), F.col("row").alias("b"))
    near = link(prints.select("fp", F.lit(0).alias("salt"))).select("a", "b")
    near = near.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = links.unionAll(verified(alike.unionAll(near).distinct()))

    rows = own.select(F.posexplode("first").alias("pos", "key"), "row", "n").select("key", "row", F.col("pos").cast("long"), "n")
    now = materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_shared(["key", "row", "pos", "n"])), "key long, row long, pos long, n long, at long"), "near-rows")
    # sketches are only dealt of sets that share something
    some = materialize(now.select("row").distinct(), "near-some")
    sketches = of(sets, some).select("row", *(F.col("sketch")[i].alias(f"s{i}") for i in range(8)))
    sketches = materialize(sketches, "near-sketches")
    # the first round is short (each set meets its list's first) and takes all sets as apart
    low, high, lists = 1, 2, now.groupBy("key").agg((F.max("at") + 1).alias("size"))
    widest = (now.agg(F.max("at")).first()[0] or 0) + 1
    now = now.withColumn("comp", F.col("row")).drop("at")
    while widest > low:
        met = now.join(sketches, "row")
        if widest > cell:
            large = materialize(lists.where(F.col("size") > cell).select("key", F.ceil(2 * F.col("size") / cell).alias("blocks")), "near-crowded")
            met = met.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
            met = met.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
            met = met.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        else:
            met = met.withColumn("cell", F.lit(0).cast("long"))
        met = met.select("key", "cell", "row", "pos", "n", "comp", *(f"s{i}" for i in range(8))).repartition("key", "cell")
        # the same order in every round, of a set's rows too
        met = met.sortWithinPartitions("key", "cell", "row", "pos", "n", "s0", "s1")
        links = links.unionAll(verified(met.mapInArrow(trimmed(_meet(similarity, low, high)), "a long, b long").distinct()))
        low, high = high, high * 64
        if widest <= low:
            break
        # lists that links have made one component go, and need not be looked at again
        found = components(links).toDF("row", "root")
        now = now.drop("comp").join(found, "row", "left").withColumn("comp", F.coalesce("root", "row")).drop("root")
        lists = now.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where((F.col("x") < F.col("y")) & (F.col("size") > low))
        lists = materialize(lists.select("key", "size"), "near-lists")
        now = materialize(now.join(lists.select("key"), "key", "left_semi"), "near-now")
        widest = lists.agg(F.max("size")).first()[0] or 0
    return sets, links


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for near copies: of each group the smallest doc_id stays.

    Groups are the components of near_links. Texts without words are copies of each
    other. Documents are told apart by doc_id and text: of one doc_id, texts that are
    unlike stay, and of like ones the one with the smallest hash. Rows with a null
    doc_id stay, as do repeated rows of a document that stays. An empty table gives
    an empty result.
    """
    sets, links = near_links(docs, **options)
    members = components(links).join(sets.select("row", F.struct(*KEYS).alias("who")), F.col("node") == F.col("row")).select("root", "who")
    first = members.groupBy("root").agg(F.min("who").alias("stays"))
    names = [unused(docs.columns, f"gone_{c}") for c in KEYS]
    gone = members.join(first, "root").where("who != stays").select(*(F.col("who")[c].alias(n) for c, n in zip(KEYS, names, strict=True))).distinct()
    gone = materialize(gone, "near-gone")
    own = docs["doc_id"].cast("long")
    may = F.coalesce(may_be_among(own, gone.select(names[0])), F.lit(False))
    same = [x == gone[n] for x, n in zip((own, *text_key(docs["text"])), names, strict=True)]
    return docs.where(~may).unionByName(docs.where(may).join(gone, same, "left_anti"))
