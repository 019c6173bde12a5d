"""A trie of conversations' prefixes, by smallest-member ownership.

Every node of the trie is owned by the smallest of its members. A member of a node is
a member of the nodes above it too, so what a conversation owns is a suffix of its
path. Windows over each conversation give every prefix a key (a running exclusive or
of hashes of depth and turn) and the tokens from there on; one group-by finds the
owners, and a conversation's first owned depth marks its suffix. Then, for every
node, its members' tokens from it on (one count for each occurrence) less those they
own below it (one for each node) are what sharing saves, and flags of owned leaves
and owned children count these. All of it is one more group-by of sums and minima, so
a prefix that a third of all conversations share is aggregated before it is dealt out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploweave.llm._io import materialize, table

#: Of a prefix: 240 bits, as four numbers.
KEY = ("x0", "x1", "x2", "x3")
NODE = ("depth", *KEY)
#: Identifiers that are joined to one text before a node's text is hashed.
JOINED = 4096


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, k, digest, size): each conversation's turns from 1, with a SHA-256 of role and text and the text's bytes.

    Turns come by number (null first), then role, then digest; null roles and texts
    count as empty; repeated rows stay. Rows without a conversation go. Other columns
    are not read. Texts themselves are not dealt out.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv IS NOT NULL")
    line = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv", F.row_number().over(line).alias("k"), "digest", "size")


def share_heads(turns: DataFrame, among: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """``ordered`` turns rebuilt so that neighbours share a head, and (conv, length) of all conversations, those left without turns too.

    Conversation c gets the first h turns of conversation c - c % ``among`` (all if
    it has fewer, none if there is none), then its own turns after its first h, where
    h is the CRC-32 of its decimal number modulo ``modulus``.
    """
    sizes = turns.groupBy("conv").agg(F.max("k").alias("n"))
    every = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % among).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % modulus).cast("int").alias("h"))
    every = every.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    every = materialize(every.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    first = turns.where(F.col("k") < modulus).withColumnRenamed("conv", "base").join(every.where("head > 0").select("conv", "base", "head"), "base").where("k <= head")
    rest = turns.join(every.select("conv", "h", "head"), "conv").where("k > h").withColumn("k", F.col("k") - F.col("h") + F.col("head"))
    columns = ["conv", "k", "digest", "size"]
    return first.select(columns).unionByName(rest.select(columns)), every.select("conv", "length")


def _limbs(depth, digest):
    """The four hashes of a turn at a depth."""
    word = F.sha2(F.concat(depth.cast("string").cast("binary"), F.lit(":").cast("binary"), digest), 256)
    return [F.conv(F.substring(word, 15 * i + 1, 15), 16, 10).cast("long") for i in range(4)]


def _joined(batches):
    """Of rows in order of node and conversation: decimal identifiers, joined for each node, JOINED at most to a row."""
    for batch in batches:
        keys, out = [batch.column(c).to_pylist() for c in NODE], []
        convs = batch.column("conv").to_pylist()
        for i, key in enumerate(zip(*keys, strict=True)):
            if out and out[-1][0] == key and len(out[-1][1]) < JOINED:
                out[-1][1].append(convs[i])
            else:
                out.append((key, [convs[i]]))
        if out:
            key = list(zip(*(k for k, _ in out), strict=True))
            columns = [pa.array(key[0], pa.int32()), *(pa.array(k, pa.int64()) for k in key[1:]), pa.array([ids[0] for _, ids in out], pa.int64()), pa.array([",".join(map(str, ids)) for _, ids in out])]
            yield pa.RecordBatch.from_arrays(columns, names=[*NODE, "first", "ids"])


def _hashed(batches):
    """Of texts in order of node and first identifier: each node's SHA-256. Nothing but the running hash is held."""
    last, now = None, None

    def row(found):
        keys = list(zip(*(k for k, _ in found), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), *(pa.array(k, pa.int64()) for k in keys[1:]), pa.array([h for _, h in found])], names=[*NODE, "ends"])

    for batch in batches:
        found = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if last is not None:
                    found.append((last, now.hexdigest()))
                last, now = key, hashlib.sha256()
            else:
                now.update(b",")
            now.update(ids.encode())
        if found:
            yield row(found)
    if last is not None:
        yield row([(last, now.hexdigest())])


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns(conv, k, digest, size)``, k from 1 without gaps, of ``members(conv, length)``, each once.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and n_ends. The root, at depth 0, has no text; a conversation
    without turns ends there. ``saved_tokens`` sums over the subtree each node's
    members but one times the bytes of its text. No members, no rows. Should two
    different turns share a key, that is an error, not a wrong result.

    Each conversation's turns pass through a window in one task, in order and not
    held in memory.
    """
    digest = F.col("digest")
    limbs = turns.join(members, "conv").select("conv", F.col("k").cast("int").alias("depth"), "digest", "size", F.col("length").cast("int").alias("length"), *(x.alias(n) for n, x in zip(KEY, _limbs(F.col("k"), digest), strict=True)))
    line = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("size").over(line) - F.col("size")
    total = F.sum("size").over(Window.partitionBy("conv"))
    below = limbs.select("conv", "depth", "length", "digest", (total - before).alias("rest"), *(F.bit_xor(x).over(line).alias(x) for x in KEY))
    top = members.join(turns.groupBy("conv").agg(F.sum("size").alias("rest")), "conv", "left")
    top = top.select("conv", F.lit(0).alias("depth"), F.col("length").cast("int").alias("length"), F.lit(None).cast("binary").alias("digest"), F.coalesce("rest", F.lit(0)).cast("long").alias("rest"), *(F.lit(0).cast("long").alias(x) for x in KEY))
    paths = materialize(below.unionByName(top), "trie-paths")

    nodes = paths.groupBy(*NODE).agg(F.min(F.struct("conv", "rest", "digest")).alias("o"), F.max("length").alias("longest"))
    nodes = materialize(nodes.select(*NODE, F.col("o.conv").alias("conv"), F.col("o.rest").alias("rest"), F.col("o.digest").alias("digest"), (F.col("longest") == F.col("depth")).alias("leaf")), "trie-nodes")
    owned = nodes.groupBy("conv").agg(F.min(F.struct("depth", "rest", "digest", *KEY)).alias("at"), F.max("leaf").alias("leaf"))
    owned = owned.select("conv", "leaf", F.col("at.depth").alias("since"), F.col("at.rest").alias("own"), F.col("at.digest").alias("digest"), *(F.col(f"at.{x}").alias(x) for x in KEY))
    # the node above a suffix: its key without the suffix's first turn
    above = owned.select("conv", "leaf", "since", "own", (F.col("since") - 1).alias("depth"), *(F.col(x).bitwiseXOR(v).alias(x) for x, v in zip(KEY, _limbs(F.col("since"), digest), strict=True)))
    marks = above.join(nodes.select(*NODE, F.col("conv").alias("parent")), list(NODE), "left").select("conv", "leaf", "since", "own", "parent")
    marks = materialize(marks, "trie-marks")

    marked = paths.join(marks, "conv", "left")
    owns, one = F.coalesce(F.col("depth") >= F.col("since"), F.lit(False)), lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = marked.groupBy(*NODE).agg(
        F.min(F.struct("conv", F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv")).alias("parent"))).alias("o"),
        F.count("*").alias("n_convs"),
        one(F.coalesce(F.col("depth") + 1 >= F.col("since"), F.lit(False)) & (F.col("depth") < F.col("length"))).alias("n_children"),
        one(F.coalesce("leaf", F.lit(False))).alias("n_leaves"),
        F.sum(F.when(owns, 0).otherwise(F.col("rest") - F.coalesce("own", F.lit(0)))).cast("long").alias("saved_tokens"),
        one(F.col("depth") == F.col("length")).alias("n_ends"),
        F.when(F.min("digest").eqNullSafe(F.max("digest")), F.lit(True)).otherwise(F.raise_error(F.lit("two turns share a key")).cast("boolean")).alias("exact"),
    )
    ends = paths.where("depth = length").select(*NODE, "conv")
    joined = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_joined, "depth int, x0 long, x1 long, x2 long, x3 long, first long, ids string")
    hashed = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth int, x0 long, x1 long, x2 long, x3 long, ends string")
    out = sums.where("exact").join(hashed, list(NODE), "left")
    return out.select(
        F.col("o.conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.col("o.parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        "n_ends",
    )


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """prefix_trie of conversations as they are: ``turns(conv_id, turn, role, text)``, in the order of ``ordered``."""
    rows = materialize(ordered(turns, **columns), "trie-turns")
    return prefix_trie(rows, rows.groupBy("conv").agg(F.max("k").alias("length")))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(*share_heads(materialize(ordered(table(spark, sf_dir, "conversations")), "trie-turns")))


SQL = r"""
WITH RECURSIVE
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, max(k) AS n FROM t GROUP BY c),
crc(c, d, i, x) AS (
  SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, d, i + 1, xor(y >> 1, CAST(CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END AS BIGINT))
  FROM (SELECT c, d, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ord(substr(d, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE x END AS y FROM crc WHERE i < 8 * length(d))),
h AS (SELECT c, xor(x, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(d)),
e AS (SELECT ids.c, h, ids.n, ids.c - ids.c % 5 AS base, least(h, coalesce(o.n, 0)) AS head FROM ids JOIN h ON h.c = ids.c LEFT JOIN ids o ON o.c = ids.c - ids.c % 5),
r AS (SELECT e.c, t.k AS d, s, b FROM e JOIN t ON t.c = e.base AND t.k <= e.head UNION ALL SELECT e.c, t.k - h + head, s, b FROM e JOIN t ON t.c = e.c AND t.k > h),
p AS (SELECT c, d, string_agg(s, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key, b FROM r UNION ALL SELECT c, 0, '', 0 FROM ids),
ends AS (SELECT arg_max(key, d) AS key, c FROM p GROUP BY c),
ended AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids, count(*) AS n FROM ends GROUP BY key),
nodes AS (SELECT d, key, min(c) AS c, count(*) AS n, any_value(b) AS b FROM p GROUP BY d, key),
kids AS (SELECT left(key, CAST(64 * (d - 1) AS BIGINT)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
up AS (SELECT left(nodes.key, CAST(64 * a.d AS BIGINT)) AS key, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((nodes.n - 1) * b) AS saved
  FROM nodes LEFT JOIN kids ON kids.key = nodes.key, LATERAL (SELECT unnest(range(nodes.d + 1)) AS d) a GROUP BY 1)
SELECT nodes.c AS conv_id, nodes.d AS depth, par.c AS parent_conv_id, nodes.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ended.ids, '')) AS ends_sha256, CAST(coalesce(ended.n, 0) AS BIGINT) AS n_ends
FROM nodes LEFT JOIN nodes par ON nodes.d > 0 AND par.d = nodes.d - 1 AND par.key = left(nodes.key, CAST(64 * (nodes.d - 1) AS BIGINT)) LEFT JOIN kids ON kids.key = nodes.key JOIN up ON up.key = nodes.key LEFT JOIN ended ON ended.key = nodes.key
"""
