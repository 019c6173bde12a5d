"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

from haploweave.llm import prefix_trie

SHAPE = "conv_id long, turn long, role string, text string"


def conversations(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((t is not None, t or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    return {c: [(role, text) for _, role, _, text in sorted(own)] for c, own in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(own):
    nodes, children = {}, {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    below = {}
    for n in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        kids = children.get(n, [])
        below[n] = (sum(below[k][0] for k in kids) if kids else 1, saved + sum(below[k][1] for k in kids))
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(own[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children.get(n, [])), *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "long " * 50])))
    return rows + [(1000 + i, 0, "user", "a") for i in range(300)]  # a crowd of copies


def test_trie_by_plain_trie(spark):
    rows = random_rows(3, 120)
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SHAPE).repartition(4))
    assert rows_of(found) == plain(conversations(rows))


def test_shared_heads(spark, sf_dir):
    rows = random_rows(4, 90) + [(2001 + 5 * i, 0, "user", "a") for i in range(20)]  # none of these has one to share with
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    own = rebuilt(conversations(rows))
    assert rows_of(prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.ordered(df)))) == plain(own)
    assert any(not turns for turns in own.values())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.op13_prefix_trie(spark, sf_dir)) == plain(rebuilt(conversations(rows)))


def test_joined_ends_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [(c, 0, "user", "same") for c in range(-20, 500)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SHAPE).repartition(6))) == plain(conversations(rows))


def test_odd_conversations(spark):
    """Nulls, repeated turns, equal numbers, a long text, other columns, one turn given twice, and no rows."""
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (None, 0, "user", "x"), (2, None, None, "first"), (2, 0, "user", ""), (3, 1, "b", "x"), (3, 1, "a", "x"), (3, 1, "a", "w"), (4, 0, "user", "hi " * 200_000), (5, 0, "u", "ser")]
    rows += [(c, 0, "u", "seré") for c in range(6, 16)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS conv", "2 AS k", "3 AS digest", "4 AS depth", "5 AS x0", "6 AS length")
    assert rows_of(prefix_trie.conversation_trie(df)) == plain(conversations(rows))
    assert rows_of(prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.ordered(df)))) == plain(rebuilt(conversations(rows)))
    assert prefix_trie.conversation_trie(df.where("false")).count() == 0
    assert prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.ordered(df.where("false")))).count() == 0
