"""Packing documents into sequences by linear grouping.

Every task turns its documents into token pieces of at most one sequence and
numbers the pieces of each length. Only the histogram of lengths (as many rows as
a sequence has tokens) reaches the driver, whatever the corpus. There, large
lengths are rounded up within groups of equal cardinality, configurations of the
few rounded sizes are optimised as a linear program by column generation, actual
lengths take the places of the rounded ones, and what is left is best-fitted,
largest first, into the room that stays. The plan says, for each length, which
ranks go to which sequences; pieces then find their place by rank.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploweave.llm._io import as_bytes, materialize, pieces, release, table

SEQUENCE = 2048
#: Parts of texts whose ids a worker keeps at most, and the longest it keeps.
KEPT_PARTS, KEPT_CHARS = 100_000, 64
#: Texts are cut into parts so many bytes at a time: their parts take some fifteen times the room.
TEXT_BYTES = 1 << 20
#: Pieces that share a salt, within which ranks are counted.
SALT_ROWS = 1 << 17
#: (groups, large lengths are over one n-th of a sequence, room a configuration may leave once actual lengths are in): the best plan is taken.
SCHEMES = ((24, 8, 2048), (48, 8, 2048), (48, 4, 2048), (24, 8, 24), (48, 8, 8), (48, 4, 4), (48, 4, 1), (48, 4, 0))


#: Texts and words of these characters only are cut into their pre-tokens here; any other word goes to the tokenizer whole.
PLAIN = re.compile(r"[\x20-\x7e\t\n\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: Pre-tokens of a plain text in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \t\n\ra-z0-9\u00df-\u00f6\u00f8-\u017f]+")

#: Bytes that the vocabulary writes as characters from 256 on: those that aren't printed, in order.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class PartIds(dict):
    """Little-endian unsigned 32-bit ids of parts, made when a part is first asked for.

    A part is a pre-token as it stands, so that only the vocabulary's merges are left
    to do, on its bytes as characters; a word that isn't plain goes to the tokenizer
    whole, under its name after a blank.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.merges = tokenizer, tokenizer.model

    def __missing__(self, part: str) -> bytes:
        if part[0] == " ":
            ids = self.tokenizer.encode_batch_fast([part[1:]], add_special_tokens=False)[0].ids
        else:
            ids = [t.id for t in self.merges.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARS))]
        found = array("I", ids).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = found
        return found


class WordIds:
    """Token ids of texts, from what is known of their parts.

    Parts are the pre-tokens of plain texts and words. White space never enters a
    token, so words that aren't plain are parts by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = PartIds(self.tokenizer)

    def _parts(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return PARTS.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if PLAIN.fullmatch(word) and "<|" not in word:
                out += PARTS.findall(word.lower())
            else:
                out.append(f" {word}")
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids, without special tokens."""
        return [b"".join(map(self.known.__getitem__, self._parts(t))) for t in texts]


#: Vocabularies that a worker has loaded, until its task ends.
_loaded: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def forget() -> None:
    """Drop the vocabularies: an executor's tasks take its workers in turn, more than run at once, and an idle one should hold none. Not in the task's function itself, whose globals are copies."""
    _loaded.clear()
    release()


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt, rank (and ids) of every document's pieces.

    A document is its ids and then ``end_id``; only longer ones are cut. Bytes that
    aren't UTF-8 count as the replacement character. ``rank``
    counts the pieces of equal length and salt. ``tokenizer``: the path of a
    vocabulary file of ``tokenizers`` on the executors; None: word_bpe_49k.json of
    the public tokenizers.
    """
    size = 4 * capacity

    def cut(batches):
        from pyspark import TaskContext

        ids_of = word_ids(tokenizer)
        salt, ranks, count = TaskContext.get().partitionId() << 24, {}, 0
        last = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, size=TEXT_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of([x.decode("utf-8", "replace") for x in as_bytes(batch.column("text"))]), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    n = len(part) // 4
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), salt, rank, part if with_ids else None))
                    count += 1
                    if count == SALT_ROWS:
                        salt, ranks, count = salt + 1, {}, 0
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank", "ids"])
        del ids_of
        forget()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, rank long, ids binary")
    return out if with_ids else out.drop("ids")


def _best_pattern(worth: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: an unbounded knapsack, one item more in each layer."""
    best, layers = np.zeros(capacity + 1), []
    value = np.zeros(capacity + 1)
    for _ in range(capacity // min(sizes)):
        new, item = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            gain = value[: capacity + 1 - s] + worth[g]
            better = gain > new[s:]
            new[s:][better] = gain[better]
            item[s:][better] = g
        layers.append(item)
        value = new
        best = np.vstack([best, value]) if best.ndim > 1 else np.stack([best, value])
        if not np.isfinite(value).any():
            break
    layer, room = np.unravel_index(np.argmax(best), best.shape)
    pattern, total = np.zeros(len(sizes)), float(best[layer, room])
    while layer:
        g = layers[layer - 1][room]
        pattern[g] += 1
        room -= sizes[g]
        layer -= 1
    return total, pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down from the linear program's optimum."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(60 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_pattern(np.maximum(worth, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        use, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(np.floor(use[j] + 1e-9))) for j in range(k) if use[j] >= 1]


@dataclass
class Plan:
    """Where the ranks of each length go: lists of (first rank, first sequence, offset)."""

    capacity: int
    places: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0
    #: Bins by the room left in them: runs of (first sequence, how many).
    room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.places.setdefault(length, []).append((at, first, offset))
        self.used[length] = at + count

    def leave(self, room: int, first: int, count: int) -> None:
        if room not in self.room:
            self.room[room] = []
            bisect.insort(self.rooms, room)
        self.room[room].append((first, count))

    def fill(self, lengths: list[int], first: int, count: int) -> None:
        """Put one piece of each length into each of ``count`` new sequences from ``first`` on."""
        offset = 0
        for length in lengths:
            self.place(length, count, first, offset)
            offset += length
        self.leave(self.capacity - offset, first, count)

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces where they leave the least room, as one by one; open new sequences for the rest."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, n = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room], self.rooms[i]
            else:
                room, first, n = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += n
            each = min(room // length, count)
            bins = min(n, count // each)
            for k in range(each):
                self.place(length, bins, first, self.capacity - room + k * length)
            self.leave(room - each * length, first, bins)
            if n > bins:
                self.leave(room, first + bins, n - bins)
            count -= each * bins


def plan_packing(histogram: dict[int, int], capacity: int = SEQUENCE, groups: int = 48, large: int = 8, slack: int = SEQUENCE) -> Plan:
    """A plan for ``histogram`` (length to count) by linear grouping with ``groups`` groups of lengths over capacity / large.

    Configurations that leave more than ``slack`` once actual lengths stand in them are given up; their pieces are best-fitted.
    """
    plan = Plan(capacity)
    whole = histogram.get(capacity, 0)
    if whole:
        plan.place(capacity, whole, 0, 0)
        plan.sequences = whole
    lengths = sorted((x for x in histogram if capacity // large < x < capacity and histogram[x]), reverse=True)
    total, left = sum(histogram[x] for x in lengths), {x: histogram[x] for x in histogram if x < capacity}
    runs: dict[int, list[list[int]]] = {}
    each, held, size = max(1, -(-total // groups)), 0, None
    for x in lengths:
        count = histogram[x]
        while count:
            if size is None or held == each:
                size, held = x, 0
            n = min(count, each - held)
            runs.setdefault(size, []).append([x, n])
            held, count = held + n, count - n
    sizes = list(runs)
    if sizes:
        for pattern, times in configurations(sizes, [sum(n for _, n in runs[s]) for s in sizes], capacity):
            slots = [s for g, s in enumerate(sizes) for _ in range(pattern[g])]
            while times:
                # each slot takes its own piece: the longest run for which all slots keep their lengths
                mine: dict[int, int] = {}
                for s in slots:
                    mine[s] = mine.get(s, 0) + 1
                n = times
                for s, k in mine.items():
                    while runs[s] and not runs[s][0][1]:
                        runs[s].pop(0)
                    if not runs[s]:
                        n = 0
                        break
                    if runs[s][0][1] >= k:
                        n = min(n, runs[s][0][1] // k)
                    else:
                        n = min(n, 1)
                if not n:
                    break
                taken = []
                for s, k in mine.items():
                    if runs[s][0][1] >= k * n:
                        runs[s][0][1] -= k * n
                        taken += [runs[s][0][0]] * k
                    else:
                        for _ in range(k):
                            while runs[s] and not runs[s][0][1]:
                                runs[s].pop(0)
                            if runs[s]:
                                runs[s][0][1] -= 1
                                taken.append(runs[s][0][0])
                times -= n
                if capacity - sum(taken) > slack:
                    continue
                for x in taken:
                    left[x] -= n
                plan.fill(sorted(taken, reverse=True), plan.sequences, n)
                plan.sequences += n
    for x in sorted((x for x, n in left.items() if n), reverse=True):
        plan.best_fit(x, left[x])
    return plan


def best_plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    return min((plan_packing(histogram, capacity, *scheme) for scheme in SCHEMES), key=lambda p: p.sequences)


def _placer(plan: Plan):
    """One sorted array of (length, first rank) with the sequence and offset from there on."""
    spots = sorted((length, at, first, offset) for length, own in plan.places.items() for at, first, offset in own)
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in zip(*spots, strict=True)) if spots else (np.zeros(0, np.int64),) * 4
    keys = (lengths << 48) | ranks

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            columns = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            columns |= {"sequence_id": pa.array(firsts[at] + rank - ranks[at]), "offset": pa.array(offsets[at])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return place


def pack(parts: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``parts`` (of token_pieces) with sequence_id and offset instead of salt and rank.

    Sequences hold at most ``capacity`` tokens and have no gaps. Null and empty
    texts are one token, the end. Repeated rows are packed each; null identifiers
    too. An empty table gives an empty result.
    """
    parts = materialize(parts, "pack-pieces")
    counts = materialize(parts.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    # the sums grow with the salts, so neither side is broadcast
    ranked = parts.hint("merge").join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(best_plan(histogram, capacity)), schema)


def op3_pack(spark, sf_dir):
    packed = pack(token_pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
