"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names, for every operator and stage."""

import math

import corpus_pipeline
import pytest

from haploweave.llm import ann, chat, exact_dedup, mixing, packing, pii, quality, simhash, token_counts, toxicity

LONG = "word " * 300_000 + "end"
TEXTS = [
    (1, "a b c d e f g", "s1"), (1, "a b c d e f g", "s1"), (2, "A b c d e f g", None), (3, None, "s1"), (4, "", "s2"), (5, "  \t\n ", "s2"),
    (None, "a b c d e f g", "s1"), (None, None, None), (6, LONG, "s1"), (7, LONG, "s2"), (8, "écho ça \U0001f600 x", "s3"), (9, "one", None),
]
SHAPE = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "size", "fp", "run", "key", "pos", "score", "copies", "piece", "log_weight", "node", "_gone", "folded", "mixed_id", "toxic", "n", "lang", "n_chars"]
    return spark.createDataFrame(TEXTS, SHAPE).repartition(3).withColumns({n: F.lit("x") for n in names}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, None, None), (2, 0, 1), (None, 1, 1), (99, 1, 1), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x or 0))


ALL = sorted((r[0] for r in TEXTS), key=lambda x: (x is not None, x or 0))


def test_exact_dedup(odd, none):
    found = exact_dedup.exact_dedup(odd).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i in ALL)
    group = [r for r in found if r["group_size"] == 4]
    assert {r["doc_id"] for r in group} == {1, 2, None}
    assert [(r["doc_id"], r["keep_id"]) for r in group if r["kept"]] == [(2, 2)]
    empty = [r for r in found if r["doc_id"] == 4 or (r["doc_id"] is None and r["group_size"] == 3) or r["doc_id"] == 3]
    assert len(empty) == 3
    assert sum(r["kept"] for r in empty) == 1
    assert {r["keep_id"] for r in empty} == {4}
    assert exact_dedup.exact_dedup(none).count() == 0
    smallest = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(odd, keep="min").collect() if r["doc_id"] is not None}
    assert smallest == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert ids(left) == [2, 4, 5, 7, 8, 9]
    assert ids(exact_dedup.drop_exact_duplicates(odd, keep="min")) == [1, 3, 5, 6, 8, 9]


def test_simhash(odd, none):
    found = simhash.simhash_components(odd).collect()
    assert len(found) == len(TEXTS)
    zero = {r["doc_id"] for r in found if r["fingerprint"] == "0" * 16}
    assert zero == {3, 4, 5, None}
    assert {r["component_id"] for r in found if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}
    assert simhash.simhash_components(none).count() == 0
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert ids(left) == [None, None, 1, 1, 3, 6, 8, 9]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_mixing(odd, none):
    found = mixing.mix(mixing.sized(odd)).collect()
    assert len(found) == len(TEXTS)
    assert all(0 <= r["copies"] <= 3 for r in found)
    assert all(len(r["by_copy"]) == r["copies"] for r in found)
    total = sum(r["size"] for r in found)
    targets = {r["source_names"][0]: (r["source_sizes"][0], r["targets"][0]) for r in found}
    assert list(targets) and math.isclose(sum(t for _, t in targets.values()), total)
    assert all(t <= 3 * s for s, t in targets.values())
    assert mixing.mix(mixing.sized(none)).count() == 0


def test_packing(odd, none):
    found = packing.pack(packing.token_pieces(odd), packing.SEQUENCE).collect()
    assert sorted(str(r["doc_id"]) for r in found if r["piece"] == 0) == sorted(str(i) for i in ALL)
    spots = {}
    for r in found:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert {r["length"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}
    assert packing.pack(packing.token_pieces(none)).count() == 0


def test_token_counts(odd, none):
    found = {(r["doc_id"], r["n_pretokens"]): r["n_tokens"] for r in token_counts.count_tokens(odd).collect()}
    assert found[3, 0] == found[4, 0] == found[5, 0] == found[None, 0] == 0
    assert found[6, 300_001] == found[7, 300_001] >= 300_001
    assert token_counts.count_tokens(none).count() == 0


def test_quality(odd, none, labels):
    found = quality.select_quality(odd, labels).collect()
    assert len(found) == len(TEXTS)
    assert {r["log_weight"] for r in found if r["doc_id"] in (3, 4, 5)} == {0.0}
    kept = quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns
    assert ids(kept) == sorted((r["doc_id"] for r in found if r["selected"]), key=lambda x: (x is not None, x or 0))
    assert quality.select_quality(none, labels).count() == 0
    assert quality.select_quality(odd, labels.where("false")).where("NOT selected").count() == 0
    assert quality.select_quality(odd, labels, k=10**9).where("selected").count() == len(TEXTS)
    assert quality.select_quality(odd, labels, k=0).where("selected").count() == 0


def test_toxicity(odd, none, labels):
    found = toxicity.score_toxicity(odd, labels).collect()
    assert len(found) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score_toxicity(none, labels).count() == 0
    many = odd.sparkSession.createDataFrame([(i % 10, f"text {i} bad" if i % 2 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    marks = odd.sparkSession.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(many, marks, limit=10).count() == 1000
    assert toxicity.sampled(many, marks, 10).count() == 10
    assert toxicity.score_toxicity(odd, labels.where("false")).count() == len(TEXTS)


def test_pii(odd, none):
    found = pii.replace_pii(odd, b"k").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(i), str(t)) for i, t, _ in TEXTS)
    assert pii.replace_pii(none, b"k").count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "yes", "x"), (1, 1, "assistant", "yes", "x"), (2, None, None, None, "x"), (None, 0, "tool", "[ROLE] t", "x"), (3, 0, "user", "hi " * 200_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    found = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert set(found) == {1, 2, 3, None}
    assert [tuple(t) for t in found[1]["turns"]] == [("user", ""), ("assistant", "yes"), ("assistant", "yes")]
    assert (found[1]["valid"], found[1]["first_bad"], found[1]["loss_text"]) == (False, 2, "yesyes")
    assert [tuple(t) for t in found[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in found[None]["turns"]] == [("tool", "[ROLE] t")]
    assert found[3]["valid"] and found[3]["turns"][0]["text"] == "hi " * 200_000
    assert chat.format_chats(turns.where("false")).count() == 0


def test_ann(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0, 1.0]), (10, [1e-30, 1e-30, 0.0]), (50, [-1e30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int".replace(", id int", "")).selectExpr("*", "1 AS id", "2 AS v", "3 AS block")
    found = [tuple(r) for r in ann.search(df, 50).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in found if q == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (0, 4, 50)]
    assert [round(s, 12) for q, _, _, s in found if q == 0] == [1.0, 1.0, round(math.sqrt(0.5), 12), -1.0]
    assert len([1 for q, *_ in found if q == 50]) == 5
    assert ann.search(df.where("false"), 50).count() == 0


def test_stages(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() >= docs.count()
    mixed = corpus_pipeline.mixing(spark, odd, str(tmp_path))
    assert mixed.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0] <= 6


def test_whole_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0
    assert found.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0


def test_bytes_that_are_no_utf8(spark, tmp_path, labels):
    """Texts that aren't UTF-8 are read by every operator, and come back as they are."""
    from pyspark.sql import functions as F

    raw = ["66FF6F20FFC320616263", "FFFE", "FFFD", "C3", "746F6B656E3D61FF6263646566", "66FF6F20FFC320616263"]
    rows = spark.createDataFrame([(i, x, "s") for i, x in enumerate(raw)], "doc_id long, hex string, source string")
    docs = rows.select("doc_id", F.unhex("hex").cast("string").alias("text"), "source")
    back = lambda df: {r["doc_id"]: r["h"] for r in df.select("doc_id", F.hex("text").alias("h")).collect()}
    assert back(docs) == dict(enumerate(raw))
    found = back(pii.replace_pii(docs, b"k"))
    assert {i: x for i, x in found.items() if i != 4} == {i: x for i, x in enumerate(raw) if i != 4}
    assert found[4] != raw[4] and len(found[4]) == len(raw[4])
    assert {r["doc_id"]: r["n_pretokens"] for r in token_counts.count_tokens(docs).collect()} == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1, 5: 3}
    assert quality.select_quality(docs, labels).count() == toxicity.score_toxicity(docs, labels).count() == simhash.simhash_components(docs).count() == len(raw)
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert groups == {0: (5, 2), 1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 2)}
    assert ids(exact_dedup.drop_exact_duplicates(docs)) == [1, 2, 3, 4, 5]
    assert ids(simhash.drop_near_duplicates(docs)) == [0, 1, 2, 3, 4]
    assert packing.pack(packing.token_pieces(docs)).count() == mixing.mix(mixing.sized(docs)).count() == len(raw)


def test_one_identifier_of_several_texts(spark, tmp_path):
    """Unlike texts of one doc_id are documents of their own: none goes with another's copy, and each is taken as often as the mix takes it."""
    from pyspark.sql import functions as F

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a30", "other")
    rows = [(3, a, "s"), (5, near, "s"), (5, b, "s"), (9, c, "s"), (9, c + " more", "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    left = simhash.drop_near_duplicates(docs)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    assert [x for x in kept if x[0] != "9"] == sorted([("3", a), ("5", b), ("None", a)])
    assert len([x for x in kept if x[0] == "9"]) == 1
    rows = [(1, "w " * 50, "x"), (1, "w " * 7, "y"), (2, "w " * 3, "y"), (2, "", "x"), (3, "w " * 41, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for r in mixing.mix(mixing.sized(docs, key=F.col("text"))).collect():
        if r["copies"]:
            sizes[r["doc_id"], r["key"]] = r["copies"]
    found = corpus_pipeline.mixing(spark, docs, str(tmp_path)).groupBy("doc_id", "text").count().collect()
    assert {(r["doc_id"], r["text"]): r["count"] for r in found} == sizes


@pytest.mark.parametrize("doc_id", [4, None])
def test_many_rows_of_one_identifier(spark, doc_id):
    """Repeated rows over many memtables don't meet each other, which would be 30 million rows here."""
    rows = [(doc_id, f"text {i % 3}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = exact_dedup.exact_dedup(docs, memtable_rows=30).groupBy("text_sha256", "group_size", "kept").count().collect()
    assert sorted((r["group_size"], r["kept"], r["count"]) for r in found) == [(10_000, False, 9_999)] * 3 + [(10_000, True, 1)] * 3
