"""Exact dedup by a log-structured merge index.

Flush: every task fills memtables that map the digest of a folded text to an entry
(kept identifier, rows, text). A copy that meets its entry is compared byte by
byte. A full memtable is flushed as a run: entries in digest order, with a filter
over their digests. Compaction: FANOUT runs of a level become one run of the next.
Entries that no other run's filter may hold pass as they are; the others are
merged in digest order. A task ends with one run. The runs of all tasks are then
merged on the digest, in order too: partitions hold ranges of hashes of digests,
each sorted, and equal digests stand next to each other. Of equal texts the
extreme identifier stays.

Only digests of several memtables are hits. Filters over the hits find their
entries and documents again, so that nothing else is dealt out; the texts of the
hits (one for each memtable) are compared byte by byte with the winner's text.
Entries whose bytes differ under one digest are grouped by their bytes instead.

A group of copies reaches the last merge as one entry for each task, so no task
holds a group; its rows find it by memtable and slot, which spreads a hot digest.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import Filter, as_bytes, folded, materialize, may_be_among, pieces, table, unused

#: Runs of a level that are compacted to one of the next.
FANOUT = 4
#: Entries that a task holds in runs at most; then they are written as a run of their own.
RUN_ROWS = 1 << 17

#: Rows of both kinds: entries of runs, and documents of slots with several.
FLUSHED = "entry boolean, memtable long, slot int, pos long, id long, n long, key binary, members array<struct<memtable: long, slot: int, pos: long, id: long, n: long, sha: binary>>"


class Entry:
    """A digest, its rows so far, the extreme (identifier, memtable, position), and a member for each memtable that has it."""

    __slots__ = ("key", "members", "n", "winner")

    def __init__(self, key: bytes, n: int, winner: tuple, members: list[dict]):
        self.key, self.n, self.winner, self.members = key, n, winner, members

    def absorb(self, other: Entry) -> None:
        self.n += other.n
        self.winner = max(self.winner, other.winner)
        self.members += other.members


class Run:
    """Entries in digest order, and a filter over their digests."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.hashes = np.array([_hash(e.key) for e in entries], np.uint64)
        self.filter = Filter.over(self.hashes, max(10, (12 * len(entries)).bit_length()))


def _hash(key: bytes) -> int:
    return int.from_bytes(key[:8], "little")


def _in_order(lists: list[list[Entry]]) -> list[Entry]:
    return list(heapq.merge(*lists, key=lambda e: e.key))


def compact(runs: list[Run]) -> Run:
    """One run of several: what the filters tell apart passes as it is, the rest is merged in digest order."""
    alone, shared = [], []
    for i, run in enumerate(runs):
        may = np.zeros(len(run.entries), bool)
        for j, other in enumerate(runs):
            if i != j:
                may |= other.filter.hold(run.hashes)
        alone.append([e for e, m in zip(run.entries, may.tolist(), strict=True) if not m])
        shared.append([e for e, m in zip(run.entries, may.tolist(), strict=True) if m])
    merged: list[Entry] = []
    for e in _in_order(shared):
        if merged and merged[-1].key == e.key:
            merged[-1].absorb(e)
        else:
            merged.append(e)
    return Run(_in_order([merged, *alone]))


class Index:
    """The runs of a task, by level."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.levels: list[list[Run]] = []
        self.rows = 0

    def add(self, run: Run, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        self.rows += len(run.entries) if level == 0 else 0
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self.add(compact(runs), level + 1)

    def whole(self) -> Run | None:
        runs = [r for level in self.levels for r in level]
        return (runs[0] if len(runs) == 1 else compact(runs)) if runs else None


class Memtable:
    """Entries of one run, bounded by the bytes of its distinct texts and by its rows."""

    def __init__(self, number: int, digest_bytes: int, sign: int):
        self.number, self.k, self.sign = number, digest_bytes, sign
        self.table: dict[bytes, list[list]] = {}
        #: For each slot, a distinct text, its rows as (position, identifier).
        self.slots: list[list[tuple[int, int | None]]] = []
        self.rows = self.bytes = 0

    def put(self, doc_id: int | None, text: bytes) -> None:
        text = text.lower()
        sha = hashlib.sha256(text).digest()
        variants = self.table.setdefault(sha[: self.k], [])
        slot = next((slot for held, slot, _ in variants if held == text), None)
        if slot is None:
            slot = len(self.slots)
            self.slots.append([])
            variants.append([text, slot, sha])
            self.bytes += len(text) + 200
        self.slots[slot].append((self.rows, doc_id))
        self.rows += 1

    def _rank(self, row: tuple[int, int | None]) -> tuple:
        """Larger for the row that stays: a known identifier, the extreme one, the first."""
        return (row[1] is not None, self.sign * (row[1] or 0), -self.number, -row[0])

    def flush(self) -> Run:
        """The run, once; the texts go."""
        entries = []
        for key in sorted(self.table):
            own = []
            for _, slot, sha in self.table[key]:
                pos, doc_id = max(self.slots[slot], key=self._rank)
                member = {"memtable": self.number, "slot": slot, "pos": pos, "id": doc_id, "n": len(self.slots[slot]), "sha": sha if self.k < 32 else None}
                own.append(Entry(key, member["n"], self._rank((pos, doc_id)), [member]))
            for other in own[1:]:
                own[0].absorb(other)
            entries.append(own[0])
        self.table = {}
        return Run(entries)

    def several(self) -> pa.RecordBatch | None:
        """The rows of slots with more than one."""
        rows = [(slot, pos, doc_id) for slot, own in enumerate(self.slots) if len(own) > 1 for pos, doc_id in own]
        if not rows:
            return None
        slot, pos, ids = zip(*rows, strict=True)
        n = len(rows)
        return _batch(pa.array([False] * n), pa.array([self.number] * n, pa.int64()), pa.array(slot, pa.int32()), pa.array(pos, pa.int64()), pa.array(ids, pa.int64()), None, None, None)


_MEMBERS = pa.list_(pa.struct([("memtable", pa.int64()), ("slot", pa.int32()), ("pos", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sha", pa.binary())]))


def _batch(entry, memtable, slot, pos, ids, n, key, members) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), _MEMBERS]
    columns = [pa.nulls(len(entry), k) if c is None else c for c, k in zip((entry, memtable, slot, pos, ids, n, key, members), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["entry", "memtable", "slot", "pos", "id", "n", "key", "members"])


def _written(run: Run, sign: int):
    for at in range(0, len(run.entries), 10_000):
        part = run.entries[at : at + 10_000]
        known, i, memtable, pos = zip(*(e.winner for e in part), strict=True)
        ids = [sign * x if k else None for k, x in zip(known, i, strict=True)]
        yield _batch(pa.array([True] * len(part)), pa.array([-x for x in memtable], pa.int64()), None, pa.array([-x for x in pos], pa.int64()), pa.array(ids, pa.int64()), pa.array([e.n for e in part], pa.int64()), pa.array([e.key for e in part], pa.binary()), pa.array([e.members for e in part], _MEMBERS))


def _flusher(digest_bytes: int, sign: int, memtable_bytes: int, memtable_rows: int, fanout: int):
    def flush(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        index, now = Index(fanout), Memtable(number, digest_bytes, sign)
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                now.put(doc_id, text)
                if now.bytes >= memtable_bytes or now.rows >= memtable_rows:
                    index.add(now.flush())
                    if (rows := now.several()) is not None:
                        yield rows
                    now = Memtable(now.number + 1, digest_bytes, sign)
                    if index.rows >= RUN_ROWS:
                        yield from _written(index.whole(), sign)
                        index = Index(fanout)
        if now.rows:
            index.add(now.flush())
            if (rows := now.several()) is not None:
                yield rows
        if (run := index.whole()) is not None:
            yield from _written(run, sign)

    return flush


def _merger(sign: int):
    """Of a stream of entries in digest order, one row for each digest of several memtables."""

    def rank(row: tuple) -> tuple:
        _, memtable, pos, doc_id, _, _ = row
        return (doc_id is not None, sign * (doc_id or 0), -memtable, -pos)

    def merge(batches):
        held: list | None = None
        found: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == row[0]:
                    if rank(row) > rank(held):
                        held[1:4] = row[1:4]
                    held[4] += row[4]
                    held[5] += row[5]
                    continue
                if held is not None and held[5] > 1:
                    found.append(held)
                held = list(row)
            if found:
                yield _level(found)
                found = []
        if held is not None and held[5] > 1:
            yield _level([held])

    return merge


def _level(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "w_memtable", "w_pos", "keep_id", "size", "entries"])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest_bytes: int = 32, memtable_bytes: int = 32 << 20, memtable_rows: int = 50_000, fanout: int = FANOUT
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep``: ``max`` or
    ``min`` identifier stays. Null texts count as empty; a null identifier stays
    only in a group without others; of rows that tie (repeated rows) exactly one
    is kept. Other columns are not read, whatever their names. An empty table
    gives an empty result. ``digest_bytes`` under 32 makes digests collide, for
    tests: results stay exact.
    """
    sign = 1 if keep == "max" else -1
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    flushed = materialize(docs.mapInArrow(_flusher(digest_bytes, sign, memtable_bytes, memtable_rows, fanout), FLUSHED), "dedup-runs")
    entries, rows = flushed.where("entry"), flushed.where("NOT entry").select("memtable", "slot", "pos", "id")

    # the last compaction: over all tasks
    heads = entries.select("key", "memtable", "pos", "id", "n", F.size("members").cast("long").alias("entries"))
    level = heads.repartition("key").sortWithinPartitions("key").mapInArrow(_merger(sign), "key binary, w_memtable long, w_pos long, keep_id long, size long, entries long")
    level = materialize(level, "dedup-level")
    member = F.explode("members").alias("m")
    own = ["m.memtable", "m.slot", "m.pos", "m.id", F.col("m.n").alias("own"), "key", F.coalesce("m.sha", "key").alias("sha")]
    may = may_be_among(F.xxhash64("key"), level.select(F.xxhash64("key")))
    alone = entries.select("key", F.col("id").alias("keep_id"), F.col("memtable").alias("w_memtable"), F.col("pos").alias("w_pos"), F.col("n").alias("size"), F.size("members").cast("long").alias("entries"), "members", may.alias("may"))
    split = alone.where("may").drop("keep_id", "w_memtable", "w_pos", "size", "entries", "may")
    # entries that the filter lets through by mistake are alone all the same
    suspects = split.join(level, "key").unionByName(alone.where("may").join(level.select("key"), "key", "left_anti").drop("may"))
    merged = alone.where("NOT may").drop("may").unionByName(suspects)
    merged = materialize(merged.select(member, "key", "keep_id", "w_memtable", "w_pos", "size", "entries").select(*own, "keep_id", "w_memtable", "w_pos", "size", "entries"), "dedup-members")

    own_text = folded(F.coalesce("text", F.lit("")))
    hits = merged.where("entries > 1")
    among = F.col("id").isNull() | may_be_among(F.col("id"), hits.select("id"))
    who = [F.coalesce("id", F.lit(0)).alias("some_id"), F.col("id").isNull().alias("no_id")]

    def texts_of(rows: DataFrame) -> DataFrame:
        """Texts by identifier and digest, once for repeated rows, which would else meet each other."""
        own = rows.select(*who, own_text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
        return own.groupBy("some_id", "no_id", "sha").agg(F.first("text").alias("text"))

    read = hits.select("*", *who).join(texts_of(docs.where(among)), ["some_id", "no_id", "sha"])
    read = read.select("memtable", "slot", "pos", "key", "w_memtable", "w_pos", "text")
    read = materialize(read, "dedup-texts")
    winners = read.where("memtable = w_memtable AND pos = w_pos").select("key", F.col("text").alias("w_text"))
    differ = materialize(read.join(winners, "key").where("text != w_text").select("key").distinct(), "dedup-differ")

    groups = merged.drop("entries")
    if differ.limit(1).count():
        # the rows of these digests, each with its text
        here = merged.join(differ, "key", "left_semi")
        rows_here = here.where("own = 1").select("memtable", "slot", "pos", "id").unionByName(rows.join(here.select("memtable", "slot"), ["memtable", "slot"], "left_semi"))
        rows_here = rows_here.join(here.select("memtable", "slot", "key", "sha"), ["memtable", "slot"])
        by_row = rows_here.select("*", *who).join(texts_of(docs), ["some_id", "no_id", "sha"])
        rank = F.struct((F.col("id") * sign).alias("i"), (-F.col("memtable")).alias("r"), (-F.col("pos")).alias("p"))
        by_bytes = by_row.groupBy("key", "text").agg(F.max(rank).alias("w"), F.count("*").alias("size"))
        by_bytes = by_bytes.select("key", "text", (F.col("w.i") * sign).alias("keep_id"), (-F.col("w.r")).alias("w_memtable"), (-F.col("w.p")).alias("w_pos"), "size")
        slots = by_row.select("memtable", "slot", "key", "text").distinct().join(by_bytes, ["key", "text"]).drop("text", "key")
        anew = here.drop("keep_id", "w_memtable", "w_pos", "size", "entries").join(slots, ["memtable", "slot"])
        groups = groups.join(differ, "key", "left_anti").unionByName(anew)

    def result(of: DataFrame) -> DataFrame:
        kept = (F.col("memtable") == F.col("w_memtable")) & (F.col("pos") == F.col("w_pos"))
        return of.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    several = rows.join(groups.where("own > 1").drop("pos", "id"), ["memtable", "slot"])
    return result(groups.where("own = 1")).unionByName(result(several))


def drop_exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Rows are told apart by doc_id and text. Repeated rows of one doc_id and text,
    which only their other columns could tell apart, become one of them.
    """
    found = materialize(exact_dedup(docs, keep=keep).where("NOT kept").select("doc_id", "keep_id", "text_sha256").distinct(), "dedup-gone")
    other_id, other_sha, name = (unused(docs.columns, n) for n in ("other_id", "other_sha", "folded"))
    own_id, own_text = docs["doc_id"].cast("long"), folded(F.coalesce(docs["text"].cast("string"), F.lit("")))

    def among(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_sha))
        return of.join(rows, own_id.eqNullSafe(F.col(other_id)) & (F.sha2(own_text, 256) == F.col(other_sha)), how)

    # only what the filter doesn't clear is dealt out
    may = own_id.isNull() | may_be_among(own_id, found.select("doc_id"))
    left = docs.where(~may).unionByName(among(found, docs.where(may), "left_anti"))
    repeated = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if repeated.limit(1).count():
        again = among(repeated, docs.where(may), "left_semi").withColumn(name, own_text)
        left = left.unionByName(again.dropDuplicates(["doc_id", name]).drop(name))
    return left


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
