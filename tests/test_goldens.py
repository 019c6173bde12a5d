"""Worked examples: a graph of six sites, four individuals, penalties, and two partitions."""

import math
import random

import pytest

from haploweave.functions import statistics
from haploweave.operators import blocks, consensus, edges, pairs, penalty, sites
from haploweave.sources import text, vcf

LINES = ["100 200 0.9", "300 100 -0.8", "200 300 0.7", "400 400 1.0", "400\t500   0.6", "300 400 0.05", "500 600 0.5", " 100 600 0.02"]


@pytest.fixture(scope="module")
def graph(spark):
    return edges.canonical(text.parse_edges(spark.createDataFrame([(x,) for x in LINES], "line string"))).cache()


@pytest.fixture(scope="module")
def line(graph):
    return blocks.chromosome(edges.positions([graph])).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_graph(graph, line):
    assert graph.count() == 7
    assert (100, 300, 0.8) in rows(graph, "loc_a", "loc_b", "r")
    assert rows(line, "pos", "idx") == [(100 * (i + 1), i) for i in range(6)]


def test_degrees(graph):
    found = {r["pos"]: r for r in edges.normalized_degree(graph).collect()}
    want = {100: (1.72, 0.643694), 200: (1.6, 0.598785), 300: (1.55, 0.580073), 400: (0.65, 0.243256), 500: (1.1, 0.411665), 600: (0.52, 0.194605)}
    for pos, (k, norm) in want.items():
        assert found[pos]["k"] == pytest.approx(k)
        assert found[pos]["k_norm"] == pytest.approx(norm, abs=1e-6)
    assert edges.total_weight(graph).first()["m"] == pytest.approx(3.57)


def test_background(graph):
    r = edges.background(graph, 150).first()
    assert (r["n_edges"], r["n_long"]) == (7, 2)
    assert r["penalty"] == pytest.approx(1.19)
    assert edges.background(graph, 300).first()["penalty"] == pytest.approx(0.02)
    with pytest.raises(Exception, match="no edge is longer"):
        edges.background(graph, 1000).collect()


SCORES = {
    100: {100: -0.3, 200: 0, 300: 0.6, 400: -0.55},
    200: {200: -0.3, 300: -0.2, 400: -1.05, 500: -1.65},
    300: {300: -0.3, 400: -0.85, 500: -1.15, 600: -1.85},
    400: {400: -0.3, 500: -0.3, 600: -0.7},
    500: {500: -0.3, 600: -0.4},
    600: {600: -0.3},
}


def test_constant_scores_and_blocks(graph, line):
    scores = blocks.window_scores(blocks.weights(line, graph, penalty.Constant(0.3), 300))
    found = {(r["pos_i"], r["pos_j"]): r["score"] for r in scores.collect()}
    assert found == {(i, j): pytest.approx(s, abs=1e-9) for i, own in SCORES.items() for j, s in own.items()}
    dp = blocks.optimum(scores)
    assert [(p, pytest.approx(o, abs=1e-9), b) for p, o, b in rows(dp, "pos", "opt", "brk")] == [(100, 0.0, 300), (200, -0.8, 300), (300, -0.9, 300), (400, -0.6, 500), (500, -0.4, 600), (600, -0.3, 600)]
    assert rows(blocks.blocks(dp), "block_start", "block_end") == [(100, 300), (400, 500), (600, 600)]
    s = blocks.summary(blocks.blocks(dp)).first()
    assert (s["n_blocks"], s["uncovered_bp"], s["max_gap"]) == (3, 198, 99)


def test_modularity(graph, line):
    sized = line.join(edges.normalized_degree(graph).select("pos", "k_norm"), "pos")
    dp = blocks.optimum(blocks.window_scores(blocks.weights(sized, graph, penalty.Modularity(500 / 300), 300)))
    want = [(100, -1.01606, 300), (200, -0.760784, 300), (300, -0.284314, 300), (400, 0.276494, 600), (500, 0.020915, 600), (600, -0.063119, 600)]
    assert rows(dp, "pos", "opt", "brk") == [(p, pytest.approx(o, abs=1e-5), b) for p, o, b in want]
    assert rows(blocks.blocks(dp), "block_start", "block_end") == [(100, 300), (400, 600)]


@pytest.mark.parametrize(
    ("longest", "most", "want"),
    [(300, 4, [(100, 100, 400), (200, 200, 500), (300, 600, 600)]), (300, 5, [(100, 200, 500), (300, 600, 600)]), (300, 6, [(100, 600, 600)]), (100, 3, [(100, 200, 300), (300, 400, 500), (500, 600, 600)])],
)
def test_chunks(line, longest, most, want):
    assert rows(blocks.chunks(line, longest, most), "start_bp", "end_bp", "buffer_end_bp") == want


def test_chunks_too_small(line):
    with pytest.raises(Exception, match="too few sites"):
        blocks.chunks(line, 300, 3).collect()


VCF = """##fileformat=VCFv4.2
#CHROM POS  ID REF ALT QUAL FILTER INFO FORMAT S1  S2  S3  S4
21     1000 .  A   G   .    .      .    GT     0|0 0|1 1|1 1|0
21     2000 .  A   G   .    .      .    GT     0|0 0|1 1|1 0|0
21     3000 .  A   G   .    .      .    GT     0|1 .|0 1|1 1|0
21     4000 .  A   G   .    .      .    GT     0|2 0|0 1|0 0|0
21     5000 .  A   G   .    .      .    GT     0|0 0|0 0|0 0|0
21     6000 .  A   G   .    .      .    GT     0|1 0|1 0|1 0|1""".split("\n")


def counted(spark, phased):
    lines = spark.createDataFrame([(x if phased else x.replace("|", "/"),) for x in VCF], "line string")
    return sites.variance(sites.with_reason(sites.count_scores(sites.decode(vcf.scan(lines), phased)), phased=phased))


def test_sites(spark):
    got = {r["pos"]: r for r in counted(spark, True).collect()}
    assert {p: (r["n_present"], r["n_missing"], r["reason"]) for p, r in got.items()} == {
        1000: (8, 0, None), 2000: (8, 0, None), 3000: (7, 1, None), 4000: (7, 1, "multiallelic"), 5000: (8, 0, "no_variation"), 6000: (8, 0, None)
    }
    assert got[3000]["mean"] == pytest.approx(4 / 7)
    got = {r["pos"]: r for r in counted(spark, False).collect()}
    assert {p: r["reason"] for p, r in got.items()} == {1000: None, 2000: None, 3000: None, 4000: "multiallelic", 5000: "no_variation", 6000: "no_variation"}
    assert (got[3000]["n_present"], got[3000]["n_missing"]) == (3, 1)
    maf = sites.with_reason(counted(spark, False).drop("reason"), 0.0, phased=False)
    assert {r["pos"] for r in maf.where("reason = 'maf'").collect()} == {1000, 3000}


@pytest.mark.parametrize(
    ("phased", "want"),
    [
        (True, {(1000, 2000): (0.6, False), (1000, 3000): (0.340278, False), (2000, 3000): (0.090741, False)}),
        (False, {(1000, 2000): (0.727273, False), (1000, 3000): (1.125, True), (2000, 3000): (0.818182, False)}),
    ],
)
def test_correlation(spark, phased, want):
    packed = sites.pack(counted(spark, phased).where("reason IS NULL AND pos <= 3000"), 8 if phased else 4)
    found = {(r["loc_a"], r["loc_b"]): (r["r2"], r["bad"]) for r in pairs.correlate(packed, 5000, unphased=not phased).collect()}
    assert found == {k: (pytest.approx(v, abs=1e-6), bad) for k, (v, bad) in want.items()}


def test_shrinkage(spark):
    packed = sites.pack(counted(spark, True).where("pos <= 2000"), 8)
    at = spark.createDataFrame([(1000, 0.01), (2000, 0.02)], "pos long, cm double")
    r = pairs.correlate_shrunk(pairs.with_map(packed, at), 5000, 4, 100.0).first()
    assert r["r2"] == pytest.approx(0.143520, abs=1e-6)


def test_many_words(spark):
    """More individuals than one word holds, against plain sums."""
    rng = random.Random(3)
    data = [(p, [rng.choice([0, 1, 2, None]) for _ in range(150)]) for p in range(1, 5)]
    rows_ = spark.createDataFrame(data, "pos long, scores array<int>")
    packed = sites.pack(sites.variance(sites.count_scores(rows_)), 150)
    found = {(r["a_pos"], r["b_pos"]): (r["inner"], r["n"]) for r in pairs.pair_counts(packed, 10, 3).collect()}
    for a, x in data:
        for b, y in data:
            if a < b:
                inner = sum(s * t for s, t in zip(x, y) if s is not None and t is not None)
                both = sum(s is None and t is None for s, t in zip(x, y))
                assert found[a, b] == (inner, sum(s is not None for s in x) + both - sum(t is None for t in y))


def test_penalties():
    assert statistics.chi_square_critical(0.05) == pytest.approx(3.841459, abs=1e-6)
    assert statistics.chi_penalty(200) == pytest.approx(0.019207, abs=1e-6)
    assert statistics.fisher_penalty(200) == pytest.approx(0.019250, abs=1e-6)
    assert statistics.solve_alpha(200, 0.3, 0.8) == pytest.approx(0.000671351, rel=1e-5)
    assert statistics.power_penalty(200, 0.3, 0.8) == pytest.approx(0.0578347, rel=1e-5)
    assert statistics.solve_w(200, 0.05, 0.8) == pytest.approx(0.198102, abs=1e-6)
    assert statistics.theta(4) == pytest.approx(1 / 9)
    assert statistics.theta(4, "harmonic") == pytest.approx((1 / sum(1 / i for i in range(1, 8))) / (8 + 1 / sum(1 / i for i in range(1, 8))))
    with pytest.raises(ValueError, match="unknown model"):
        penalty.check_model("other")


def test_consensus(spark):
    sets = spark.createDataFrame([("A", 100, 300), ("A", 400, 600), ("B", 100, 200), ("B", 300, 600)], "pop string, block_start long, block_end long")
    found = consensus.merged(sets, 20)
    assert rows(found, "start", "stop") == [(100, 291), (310, 600)]
    assert rows(consensus.repaired(sets, 20, 100), "start", "stop") == [(100, 291), (310, 600)]
    assert consensus.coverage(found, consensus.extremes(sets)).first()["coverage_percent"] == pytest.approx(96.2)


@pytest.mark.parametrize("bad", ["10 20", "10 20 0.5 x", "", "a b r", "-1 20 0.5", "10 20.5", "4294967296 3 0.1"])
def test_lines_that_are_no_edges(spark, bad):
    df = spark.createDataFrame([(bad,)], "line string")
    with pytest.raises(Exception, match="not an edge"):
        text.parse_edges(df).collect()
    assert text.parse_edges(df, "keep").first()["bad"] == bad


def test_nearest(spark):
    from haploweave.operators import ranges

    rng = random.Random(7)
    pos = sorted(rng.sample(range(0, 500), 60))
    line = blocks.chromosome(spark.createDataFrame([(p,) for p in pos], "pos long"))
    points = sorted(set(rng.sample(range(-20, 540), 100)) | set(pos[:5]))
    found = ranges.nearest(spark.createDataFrame([(p,) for p in points], "point long"), line)
    assert rows(found, "point", "pos") == [(p, min(pos, key=lambda q: (abs(q - p), q))) for p in points]


def test_zero_weights_and_duplicates(spark):
    zero = spark.createDataFrame([(1, 2, 0.0)], "loc_a long, loc_b long, r double")
    with pytest.raises(Exception, match="all weights are 0"):
        edges.total_weight(zero).collect()
    assert edges.duplicates(zero.union(zero)).count() == 1
    with pytest.raises(Exception, match="out of range"):
        edges.assert_unit(spark.createDataFrame([(1, 2, 1.5)], "loc_a long, loc_b long, r double")).collect()


def _best(n, ok, score):
    """The best partition of n sites by trying all."""
    if n == 0:
        return 0.0
    best = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = max(score[i, j] + best[j + 1] for j in range(i, n) if ok(i, j))
    return best[0]


@pytest.mark.parametrize("seed", range(3))
def test_random_chromosomes(spark, seed):
    """Several chromosomes at once: closed form of the scores, best total, cover, chunks make no difference, combine is idempotent."""
    rng = random.Random(seed)
    edge_rows, sites_ = [], {}
    for chrom in ("x", "y"):
        pos = sorted(rng.sample(range(1, 200), 14))
        sites_[chrom] = pos
        edge_rows += [(chrom, a, b, round(rng.random(), 3)) for i, a in enumerate(pos) for b in pos[i + 1 :] if rng.random() < 0.7]
    graph = spark.createDataFrame(edge_rows, "chrom string, loc_a long, loc_b long, r double")
    by = ["chrom"]
    line = blocks.chromosome(edges.positions([graph], by), by)
    grid = blocks.weights(line, graph, penalty.Constant(0.37), 60, by)
    scores = blocks.window_scores(grid, by).cache()
    got = {(r["chrom"], r["i"], r["j"]): r["score"] for r in scores.collect()}
    known = {(c, a, b): r for c, a, b, r in edge_rows}
    dp = blocks.optimum(scores, by)
    totals = {r["chrom"]: r["opt"] for r in blocks.best_total(dp, by).collect()}
    found = blocks.blocks(dp, by).collect()
    for chrom in ("x", "y"):
        pos = sorted({p for c, a, b, _ in edge_rows if c == chrom for p in (a, b)})
        n = len(pos)
        want = {(i, j): sum(known.get((chrom, pos[p], pos[q]), 0.0) - 0.37 for p in range(i, j + 1) for q in range(p, j + 1)) for i in range(n) for j in range(i, n) if pos[j] - pos[i] <= 60}
        assert {k[1:]: v for k, v in got.items() if k[0] == chrom} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
        assert totals[chrom] == pytest.approx(_best(n, lambda i, j: (i, j) in want, want), abs=1e-9)
        cover = sorted(p for r in found if r["chrom"] == chrom for p in pos if r["block_start"] <= p <= r["block_end"])
        assert cover == pos
        assert totals[chrom] == pytest.approx(sum(want[pos.index(r["block_start"]), pos.index(r["block_end"])] for r in found if r["chrom"] == chrom), abs=1e-9)
    chunked = blocks.optimum(blocks.chunk_scores(line, graph, penalty.Constant(0.37), 60, blocks.chunks(line, 60, 12, by), 60, by), by)
    assert rows(chunked, "chrom", "pos", "brk") == rows(dp, "chrom", "pos", "brk")
    assert rows(edges.combine([graph, graph], by), "chrom", "loc_a", "loc_b", "r") == sorted(edge_rows)
    assert math.isfinite(sum(totals.values()))


def test_degrees_of_freedom():
    assert statistics._gamma_share(0.5, 3.841458820694124 / 2)[1] == pytest.approx(0.05, abs=1e-12)
    assert statistics.chi_square_critical(0.05, 2) == pytest.approx(-2 * math.log(0.05), abs=1e-9)
    assert statistics.chi_square_critical(0.05, 5) == pytest.approx(11.070497693516351, abs=1e-8)
    assert statistics.chi_penalty(50, 0.01, 2) == pytest.approx(-2 * math.log(0.01) / 50, abs=1e-9)
    # the effect that two degrees of freedom need for a power of 0.8 at 0.05
    assert 100 * statistics.solve_w(100, 0.05, 0.8, 2) ** 2 == pytest.approx(9.6347, abs=1e-3)
    alpha = statistics.solve_alpha(100, 0.3, 0.8, 3)
    assert statistics.power_of(100, 0.3, alpha, 3) == pytest.approx(0.8, abs=1e-9)
    assert statistics.power_penalty(100, 0.3, 0.8, 3) == pytest.approx(statistics.chi_square_critical(alpha, 3) / 100)


def test_parts_of_a_partition(spark):
    """Parts solved apart, whatever their size and reach, against one pass over each line."""
    rng = random.Random(1)
    n, rows = 150, []
    for c in "ab":
        for i in range(n):
            rows += [(c, i, j, i * 10, j * 10, rng.uniform(-1, 1)) for j in range(i, min(n, i + rng.choice([3, 8, 12])))]
    scores = spark.createDataFrame(rows, "c string, i long, j long, pos_i long, pos_j long, score double").cache()
    want = {}
    for c in "ab":
        opt = [0.0] * (n + 1)
        for i in reversed(range(n)):
            opt[i], brk = max((s + opt[j + 1], -j) for d, k, j, _, _, s in rows if (d, k) == (c, i))
            want[c, i] = (pytest.approx(opt[i]), -brk * 10)
    for size, ahead in ((37, 3), (64, 16), (1000, 10), (1, 1)):
        found = blocks.optimum(scores, ["c"], size, ahead).collect()
        assert {(r["c"], r["idx"]): (r["opt"], r["brk"]) for r in found} == want
        for c in "ab":
            own = sorted((r["pos"], r["brk"]) for r in found if r["c"] == c and r["starts"])
            assert own[0][0] == 0 and own[-1][1] == 10 * (n - 1)
            assert all(a[1] + 10 == b[0] for a, b in zip(own, own[1:]))


def test_lines_in_stretches(spark):
    """Ranks, neighbours, running values and islands do not depend on how a line is cut."""
    from haploweave.operators import ranges

    rng = random.Random(3)
    points = sorted(rng.sample(range(3000), 200))
    chrom = spark.createDataFrame([(p,) for p in points], "pos long")
    whole = rows(ranges.ranked(chrom), "pos", "idx")
    assert whole == [(p, i) for i, p in enumerate(points)]
    assert rows(ranges.ranked(chrom, width=64), "pos", "idx") == whole
    line = ranges.ranked(chrom)
    columns = ("pos", "right_idx", "right_pos", "left_idx", "left_pos")
    near = rows(ranges.neighbours(line, 90), *columns)
    assert rows(ranges.neighbours(line, 90, width=50), *columns) == near
    for p, r, q, l, m in near:
        reach = [x for x in points if abs(x - p) <= 90]
        assert (q, m, r, l) == (reach[-1], reach[0], points.index(reach[-1]), points.index(reach[0]))
    spans = spark.createDataFrame([(float(a), float(a + rng.randint(1, 40))) for a in rng.choices(range(2000), k=150)], "start double, stop double")
    merged = rows(consensus.islands(spans), "start", "stop")
    assert rows(consensus.islands(spans, width=32), "start", "stop") == merged
    assert all(a[1] <= b[0] for a, b in zip(merged, merged[1:]))
