"""A Merkle manifest of a dataset, by an associative sparse forest.

Rows are leaves of one tree for each source; the sources' roots are leaves of one more
tree. Nodes are known by tree, level and index, and as every tree's number of leaves is
known, so is how many siblings any run of them has. A fragment holds nodes whose run
isn't complete yet. Merging two fragments puts their nodes together and replaces every
complete run by the node above it, which is associative: any grouping gives the root.

Rows are sorted by source and identifier into parts. Each part folds its leaves to a
fragment of at most some thirty nodes a level. Fragments are then merged as a tree,
FANIN neighbours at a time, in rounds that are written to the shared folder (a
reduction that only returned its end would lose the runs that proofs are made of).
The runs that rounds complete go back to the parts whose leaves lie below them: a run
or two for each level. With these and its own leaves each part makes all its proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploweave.llm._io import folded, materialize, table

#: Siblings of a full run.
ARITY = 16
#: Fragments that are merged at once.
FANIN = 16
#: Rows of a part, about.
PART_ROWS = 1 << 16
#: The tree of the sources' roots; sources count from 0.
TOP = -1
#: A node: its tree, that tree's leaves, level, index, digest (binary), and the first and last part with leaves below it.
NODE = ("tree", "leaves", "level", "index", "digest", "first", "last")
_NODE = "tree long, leaves long, level int, index long, digest binary, first long, last long"
_NODE_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def digest_of(digests: Iterable[bytes]) -> bytes:
    """The node above some: the SHA-256 of their digests' hexadecimal text, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level."""
    return -(-leaves // arity**level)


class Fragment:
    """Unresolved nodes; ``add`` resolves runs as they become complete, and ``done`` holds those runs until it is taken."""

    def __init__(self, sources: int, arity: int = ARITY):
        self.sources, self.arity = sources, arity
        self.runs: dict[tuple[int, int, int], dict[int, tuple]] = {}
        self.done: list[tuple[tuple, list[bytes]]] = []
        self.root: bytes | None = None

    def add(self, node: tuple) -> None:
        tree, leaves, level, index, digest, first, last = node
        while width(leaves, level, self.arity) == 1:
            if tree == TOP:
                self.root = digest
                return
            tree, leaves, level, index = TOP, self.sources, 0, tree
        run = self.runs.setdefault((tree, level, index // self.arity), {})
        run[index] = (tree, leaves, level, index, digest, first, last)
        start = index // self.arity * self.arity
        if len(run) < min(self.arity, width(leaves, level, self.arity) - start):
            return
        del self.runs[tree, level, index // self.arity]
        digests = [run[i][4] for i in sorted(run)]
        first, last = min(n[5] for n in run.values()), max(n[6] for n in run.values())
        above = (tree, leaves, level + 1, index // self.arity, digest_of(digests), first, last)
        self.done.append((above, digests))
        self.add(above)

    def merge(self, other: Fragment) -> Fragment:
        for node in other.nodes():
            self.add(node)
        self.root = self.root or other.root
        return self

    def nodes(self) -> Iterator[tuple]:
        for run in self.runs.values():
            yield from run.values()

    def result(self) -> tuple | None:
        """What there is to hand on: the unresolved nodes, or the root once it is known."""
        return (TOP, self.sources, -1, 0, self.root, 0, 0) if self.root else None


def leaf_digest(columns: list[str], of) -> F.Column:
    """SHA-256, in lower-case hexadecimal, of each column's byte count, a colon and its value, or ``-`` for null."""
    def field(c):
        value = of(c).cast("string").cast("binary")
        return F.coalesce(F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(":").cast("binary"), value), F.lit("-").cast("binary"))

    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def _nodes_batch(rows: list[tuple], extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *(extra or {}).values()], names=[*NODE, *(extra or {})])


def _fold(sources: int, arity: int):
    """Of leaves in order of part and place: each part's fragment."""

    def fold(batches):
        part, now = None, None

        def out(part, now):
            rows = list(now.nodes()) + ([now.result()] if now.root else [])
            if rows:
                yield _nodes_batch(rows, {"part": pa.array([part] * len(rows), pa.int64())})

        for batch in batches:
            for own, tree, leaves, index, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "leaves", "index", "leaf")), strict=True):
                if own != part:
                    if now is not None:
                        yield from out(part, now)
                    part, now = own, Fragment(sources, arity)
                now.add((tree, leaves, 0, index, leaf, own, own))
                now.done.clear()  # a part finds its own runs again
        if now is not None:
            yield from out(part, now)

    return fold


def _merge(sources: int, arity: int):
    """Of nodes in order of group and part: each group's fragment, and the runs completed, as rows with ``run``."""

    def merge(batches):
        group, part, now, other = None, None, None, None

        def out(group, now):
            rows = [(n, None) for n in now.nodes()] + list(now.done) + ([(now.result(), None)] if now.root else [])
            if rows:
                extra = {"part": pa.array([group] * len(rows), pa.int64()), "run": pa.array([r for _, r in rows], pa.list_(pa.binary()))}
                yield _nodes_batch([n for n, _ in rows], extra)

        for batch in batches:
            for own, at, *node in zip(*(batch.column(c).to_pylist() for c in ("group", "part", *NODE)), strict=True):
                if (own, at) != (group, part):
                    if now is not None:
                        now.merge(other)
                    if own != group:
                        if now is not None:
                            yield from out(group, now)
                        now = Fragment(sources, arity)
                    group, part, other = own, at, Fragment(sources, arity)
                if node[2] < 0:
                    other.root = node[4]
                else:
                    other.runs.setdefault((node[0], node[2], node[3] // arity), {})[node[3]] = tuple(node)
        if now is not None:
            now.merge(other)
            yield from out(group, now)

    return merge


class Known:
    """All nodes on the paths of one part's leaves, from its leaves and the runs that others completed."""

    def __init__(self, runs: dict[tuple[int, int, int], list[bytes]], sources: int, arity: int):
        self.runs, self.sources, self.arity = runs, sources, arity
        self.tails: dict[tuple[int, int, int], str] = {}
        self.folds: dict[tuple[int, int, int, bytes], bytes] = {}

    def grow(self, tree: int, leaves: int, start: int, digests: list[bytes]) -> bytes:
        """Takes the tree's leaves from ``start`` on; returns its root, which is the tree's only leaf or the last run's digest."""
        level, nodes = 0, dict(enumerate(digests, start))
        while width(leaves, level, self.arity) > 1:
            above = {}
            for r in range(min(nodes) // self.arity, max(nodes) // self.arity + 1):
                own = range(r * self.arity, min((r + 1) * self.arity, width(leaves, level, self.arity)))
                if (tree, level, r) not in self.runs:
                    self.runs[tree, level, r] = [nodes[i] for i in own]
                above[r] = digest_of(self.runs[tree, level, r])
            level, nodes = level + 1, above
        return nodes[0]

    def tail(self, tree: int, leaves: int, level: int, index: int) -> str:
        """All siblings of a node and of those above it, left to right, level by level, as text."""
        if width(leaves, level, self.arity) == 1:
            return "" if tree == TOP else self.tail(TOP, self.sources, 0, tree)
        key = (tree, level, index)
        if key not in self.tails:
            run = self.runs[tree, level, index // self.arity]
            own = index % self.arity
            text = "".join(d.hex() for i, d in enumerate(run) if i != own) + self.tail(tree, leaves, level + 1, index // self.arity)
            if level == 0 and tree != TOP:
                return text  # only one leaf's
            self.tails[key] = text
        return self.tails[key]

    def fold(self, tree: int, leaves: int, level: int, index: int, digest: bytes) -> bytes:
        """The root that a node's digest gives with the siblings of its path."""
        if width(leaves, level, self.arity) == 1:
            return digest if tree == TOP else self.fold(TOP, self.sources, 0, tree, digest)
        key = (tree, level, index, digest)
        if key not in self.folds:
            run = list(self.runs[tree, level, index // self.arity])
            run[index % self.arity] = digest
            found = self.fold(tree, leaves, level + 1, index // self.arity, digest_of(run))
            if level == 0 and tree != TOP:
                return found
            if len(self.folds) > 100_000:
                self.folds.clear()
            self.folds[key] = found
        return self.folds[key]


def _prove(sources: int, root: bytes, arity: int):
    """Of leaves, and runs before them, in order of part: proofs."""
    names = ("part", "kind", "tree", "leaves", "level", "index", "leaf", "tampered", "doc_id", "run")

    def rows_of(held: list[tuple], runs: dict) -> Iterator[pa.RecordBatch]:
        known, roots = Known(runs, sources, arity), {}
        start = 0
        while start < len(held):
            stop = start
            tree, leaves, index = held[start][:3]
            while stop < len(held) and held[stop][0] == tree:
                stop += 1
            roots[tree] = known.grow(tree, leaves, index, [h[3] for h in held[start:stop]])
            start = stop
        trees = sorted(roots)
        known.grow(TOP, sources, trees[0], [roots[t] for t in trees])
        text = hashlib.sha256
        for at in range(0, len(held), 10_000):
            out = []
            for tree, leaves, index, leaf, tampered, doc_id in held[at : at + 10_000]:
                proof = text(known.tail(tree, leaves, 0, index).encode()).hexdigest()
                back = known.fold(tree, leaves, 0, index, leaf if tampered is None else tampered)
                out.append((doc_id, leaf.hex(), roots[tree].hex(), root.hex(), proof, back.hex(), back == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    def prove(batches):
        part, held, runs = None, [], {}
        for batch in batches:
            for own, kind, tree, leaves, level, index, leaf, tampered, doc_id, run in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if own != part:
                    if held:
                        yield from rows_of(held, runs)
                    part, held, runs = own, [], {}
                if kind == 0:
                    runs[tree, level, index] = run
                else:
                    held.append((tree, leaves, index, leaf, tampered, doc_id))
        if held:
            yield from rows_of(held, runs)

    return prove


def manifest(docs: DataFrame, tampered: F.Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", part_rows: int = PART_ROWS, arity: int = ARITY, fan_in: int = FANIN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``.

    A leaf digests ``columns``, all else is not read. Leaves of a source ascend by
    identifier (null first), then digest; repeated rows are leaves each. Sources
    ascend bytewise, null first; an empty source is another than null. ``tampered``:
    on which rows the text that is checked has its A-Z lower-cased (null: not);
    ``folded_root`` is what the checked leaf and the proof's siblings give. A source
    of one row has its leaf as root, one source's root is the root; the proof without
    siblings is the SHA-256 of nothing. An empty table gives an empty result.

    ``part_rows``: about how many rows one task holds, as digests.
    """
    spark = docs.sparkSession
    own = leaf_digest(list(columns), F.col)
    other = leaf_digest(list(columns), lambda c: folded(F.col(c).cast("string")) if c == text_col else F.col(c))
    leaves = docs.select(
        F.col(group_col).cast("string").cast("binary").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(own).alias("leaf"),
        F.when(tampered, F.unhex(other)).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    n = leaves.count()
    order = ["source", "doc_id", "leaf", "row"]
    ranged = leaves.repartitionByRange(max(-(-n // part_rows), min(spark.sparkContext.defaultParallelism, -(-n // ARITY)), 1), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the part, and the place in it
    line = materialize(ranged.select("source", "doc_id", "leaf", "tampered", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "merkle-line")

    # a row for each source of a part: which source it is, and how many of its leaves came before
    held = line.groupBy("part", "source").agg(F.min("place").alias("place0"), F.count("*").alias("n"))
    local = held.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("place0")))
    ends = local.groupBy("part").agg(F.count("*").alias("n_sources"), F.min_by(F.struct("source", "n"), "place0").alias("head"), F.max_by(F.struct("source", "n"), "place0").alias("end"))
    parts = Window.orderBy("part")  # one row a part
    before = F.lag("end").over(parts)
    goes_on = F.coalesce(F.lag("part").over(parts).isNotNull() & before["source"].eqNullSafe(F.col("head.source")), F.lit(False))
    ends = ends.select("part", "n_sources", goes_on.alias("goes_on")).withColumn("tree0", F.sum(F.col("n_sources") - F.col("goes_on").cast("int")).over(parts) - F.col("n_sources"))
    trees = local.join(ends.select("part", "tree0"), "part").select("part", "source", "place0", "n", (F.col("tree0") + F.col("nth") - 1).alias("tree"))
    sums = trees.groupBy("tree").agg(F.sum("n").alias("leaves"), F.count("*").alias("parts"))
    # a source of several parts has one row for each
    over = trees.join(sums.where("parts > 1"), "tree").select("part", "tree", "leaves", (F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")).alias("index0"))
    trees = trees.join(over, ["part", "tree"], "left").select("part", "source", "place0", "tree", F.coalesce("leaves", "n").alias("leaves"), F.coalesce("index0", F.lit(0)).cast("long").alias("index0"))
    trees = materialize(trees, "merkle-trees")
    sources = (trees.agg(F.max("tree")).first()[0] if n else None) or 0
    sources += 1
    same = (line["part"] == trees["part"]) & line["source"].eqNullSafe(trees["source"])
    placed = line.join(trees, same).select(line["part"], "tree", "leaves", (F.col("place") - F.col("place0") + F.col("index0")).alias("index"), "leaf", "tampered", "doc_id")
    placed = materialize(placed, "merkle-placed")

    by_part = placed.repartition("part").sortWithinPartitions("part", "tree", "index")
    now = materialize(by_part.mapInArrow(_fold(sources, arity), f"{_NODE}, part long"), "merkle-fragments")
    runs = None
    count = (ends.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # rounds: the logarithm of the parts to the base FANIN
        grouped = now.withColumn("group", F.floor(F.col("part") / fan_in)).repartition("group").sortWithinPartitions("group", "part")
        merged = materialize(grouped.select("group", "part", *NODE).mapInArrow(_merge(sources, arity), f"{_NODE}, part long, run array<binary>"), "merkle-merged")
        done = merged.where("run IS NOT NULL").select("tree", (F.col("level") - 1).alias("level"), "index", "run", "first", "last")
        runs = done if runs is None else runs.unionByName(done)
        now, count = merged.where("run IS NULL").drop("run"), -(-count // fan_in)
        if count == 1:
            break
    top = now.where("level < 0").select("digest").first()
    if top is None:
        root = b""
    else:
        root = bytes(top[0])
    back = runs.select(F.explode(F.sequence("first", "last")).alias("part"), F.lit(0).alias("kind"), "tree", F.lit(0).cast("long").alias("leaves"), "level", "index", "run")
    both = placed.select("*", F.lit(1).alias("kind"), F.lit(0).alias("level")).unionByName(back, allowMissingColumns=True)
    both = both.select("part", "kind", "tree", "leaves", "level", "index", "leaf", "tampered", "doc_id", "run").repartition("part").sortWithinPartitions("part", "kind", "tree", "index")
    return both.mapInArrow(_prove(sources, root, arity), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


_FIELDS = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")]
SQL = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, * FROM documents),
ids AS (SELECT DISTINCT doc_id AS c FROM documents WHERE doc_id IS NOT NULL),
crc(c, d, i, x) AS (
  SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, d, i + 1, xor(y >> 1, CAST(CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END AS BIGINT))
  FROM (SELECT c, d, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ord(substr(d, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE x END AS y FROM crc WHERE i < 8 * length(d))),
bad AS (SELECT c FROM crc WHERE i = 8 * length(d) AND xor(x, CAST(4294967295 AS BIGINT)) % 5 = 0),
f AS (SELECT k, doc_id, source, sha256({" || ".join(_FIELDS)}) AS h,
  sha256({" || ".join([*_FIELDS[:-1], _FIELDS[-1].replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")])}) AS t FROM d),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM documents)),
leaves AS MATERIALIZED (SELECT k, doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, CASE WHEN c IS NULL THEN h ELSE t END AS t
  FROM f JOIN src ON src.source IS NOT DISTINCT FROM f.source LEFT JOIN bad ON bad.c = doc_id),
tree(s, l, i, h) AS (
  SELECT s, 0, i, h FROM leaves
  UNION ALL SELECT s, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM tree) WHERE n > 1 GROUP BY s, l, i // 16),
tops AS (SELECT s, max(l) AS top, arg_max(h, l) AS h FROM tree GROUP BY s),
upper_tree(l, i, h) AS (
  SELECT 0, s, h FROM tops
  UNION ALL SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1 GROUP BY l, i // 16),
root AS (SELECT max(l) AS top, arg_max(h, l) AS h FROM upper_tree),
beside AS MATERIALIZED (SELECT tree.s, l, i, coalesce(string_agg(tree.h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(tree.h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM tree JOIN tops ON tops.s = tree.s AND l < top WINDOW w AS (PARTITION BY tree.s, l, i // 16 ORDER BY i)),
above AS MATERIALIZED (SELECT l, i, coalesce(string_agg(upper_tree.h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(upper_tree.h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM upper_tree JOIN root ON l < top WINDOW w AS (PARTITION BY l, i // 16 ORDER BY i)),
steps AS (SELECT k, l AS j, a, b FROM leaves JOIN beside ON beside.s = leaves.s AND beside.i = leaves.i >> (4 * l) UNION ALL SELECT k, 100 + l, a, b FROM leaves JOIN above ON above.i = leaves.s >> (4 * l)),
path AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY j) AS j, a, b FROM steps),
proof AS (SELECT k, string_agg(a || b, '' ORDER BY j) AS p FROM path GROUP BY k),
fold(k, j, h) AS (SELECT k, CAST(0 AS BIGINT), t FROM leaves UNION ALL SELECT fold.k, path.j, sha256(a || h || b) FROM fold JOIN path ON path.k = fold.k AND path.j = fold.j + 1),
folded AS (SELECT k, arg_max(h, j) AS h FROM fold GROUP BY k)
SELECT doc_id, leaves.h AS leaf, tops.h AS subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
FROM leaves JOIN tops ON tops.s = leaves.s JOIN folded ON folded.k = leaves.k LEFT JOIN proof ON proof.k = leaves.k, root
"""
