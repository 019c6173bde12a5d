"""Scores and partitions by tiles, and walks by pointer doubling, against plain passes over the line."""

import random

import pytest

from haploweave.operators import blocks, chains, edges, penalty, tiles


def plain(pos, known, cost, longest):
    """Scores of windows, best totals and ends of first blocks. ``cost(i, j)`` of places i <= j."""
    n, scores = len(pos), {}
    for i in reversed(range(n)):
        row = 0.0
        for j in range(i, n):
            if pos[j] - pos[i] > longest:
                break
            row += known.get((pos[i], pos[j]), 0.0) - cost(i, j)
            scores[i, j] = row + scores.get((i + 1, j), 0.0)
    opt, brk = [0.0] * (n + 1), [0] * n
    for i in reversed(range(n)):
        opt[i], brk[i] = max(((s + opt[j + 1], -j) for (k, j), s in scores.items() if k == i), key=lambda x: (round(x[0], 9), x[1]))
        brk[i] = -brk[i]
    return scores, opt, brk


def graph_of(spark, seed, chroms=("x", "y"), n=120):
    """Lines with crowded and empty stretches, and edges longer than the longest window."""
    rng = random.Random(seed)
    lines, rows = {}, []
    for c in chroms:
        pos = sorted({*rng.sample(range(300), n // 2), *rng.sample(range(700, 1500), n // 2)})
        lines[c] = pos
        rows += [(c, a, b, rng.random()) for i, a in enumerate(pos) for b in pos[i + 1 : i + 15] if rng.random() < 0.5]
    sites = spark.createDataFrame([(c, p, i) for c, pos in lines.items() for i, p in enumerate(pos)], "chrom string, pos long, idx long")
    return lines, rows, sites, spark.createDataFrame(rows, "chrom string, loc_a long, loc_b long, r double").repartition(3)


@pytest.mark.parametrize("width,ahead", [(40, 40), (160, 160), (1000, 500)])
def test_tiles_by_plain_passes(spark, width, ahead):
    lines, rows, sites, graph = graph_of(spark, width)
    cost, by = penalty.Constant(0.2), ["chrom"]
    scores = {(r["chrom"], r["i"], r["j"]): r["score"] for r in tiles.window_scores(sites, graph, cost, 40, by, width).collect()}
    dp = blocks.partition(sites, graph, cost, 40, by, width, ahead, stretch=16).collect()
    for c, pos in lines.items():
        want, opt, brk = plain(pos, {(a, b): r for d, a, b, r in rows if d == c}, lambda i, j: 0.2, 40)
        assert {k[1:]: s for k, s in scores.items() if k[0] == c} == {k: pytest.approx(s, abs=1e-9) for k, s in want.items()}
        own = {r["idx"]: r for r in dp if r["chrom"] == c}
        assert {i: (r["opt"], r["brk"]) for i, r in own.items()} == {i: (pytest.approx(opt[i], abs=1e-9), pos[brk[i]]) for i in range(len(pos))}
        at, starts = 0, []
        while at < len(pos):
            starts.append(at)
            at = brk[at] + 1
        assert sorted(i for i, r in own.items() if r["starts"]) == starts


@pytest.mark.parametrize("model", ["modularity", "chromosome"])
def test_other_penalties(spark, model):
    lines, rows, sites, graph = graph_of(spark, 5)
    by = ["chrom"]
    if model == "modularity":
        sites = sites.join(edges.normalized_degree(graph, by=by).select("chrom", "pos", "k_norm"), [*by, "pos"], "left").fillna(0.0)
        cost = penalty.Modularity(3.0)
    else:
        sites, cost = sites.selectExpr("*", "CASE chrom WHEN 'x' THEN 0.3D ELSE 0.1D END AS penalty"), penalty.OfChromosome()
    scores = tiles.window_scores(sites, graph, cost, 40, by).collect()
    grid = blocks.window_scores(blocks.weights(sites, graph, cost, 40, by), by).collect()
    key = lambda r: (r["chrom"], r["i"], r["j"], r["pos_i"], r["pos_j"])
    assert {key(r): r["score"] for r in scores} == {key(r): pytest.approx(r["score"], abs=1e-9) for r in grid}
    dp = {(r["chrom"], r["idx"]): r["opt"] for r in blocks.partition(sites, graph, cost, 40, by).collect()}
    want = {(r["chrom"], r["idx"]): r["opt"] for r in blocks.optimum(blocks.window_scores(blocks.weights(sites, graph, cost, 40, by), by), by).collect()}
    assert dp == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert set(lines) == {"x", "y"}


@pytest.mark.parametrize("n", [400, 401])
def test_chains_out_of_step(spark, n):
    """All pairs of neighbours alike: a tile's choices depend on the parity of all sites after it. Two rounds do."""
    rows = [(i, i + 1, 1.0) for i in range(n - 1)]
    sites = spark.createDataFrame([(i, i) for i in range(n)], "pos long, idx long")
    graph = spark.createDataFrame(rows, "loc_a long, loc_b long, r double")
    _, opt, brk = plain(list(range(n)), {(a, b): r for a, b, r in rows}, lambda i, j: 0.125, 2)
    found = tiles.optimum(sites, graph, penalty.Constant(0.125), 2, width=32, ahead=16).collect()
    assert {r["idx"]: (r["opt"], r["brk"]) for r in found} == {i: (pytest.approx(opt[i]), brk[i]) for i in range(n)}
    assert blocks.best_total(blocks.optimum(blocks.window_scores(blocks.weights(sites, graph, penalty.Constant(0.125), 2)), sites=32, ahead=16)).first()[0] == pytest.approx(opt[0])


def test_resumed_partitions(spark):
    """From the right, in three runs, each with the sites its blocks may reach."""
    lines, rows, sites, graph = graph_of(spark, 9)
    by, cost = ["chrom"], penalty.Constant(0.2)
    whole = {(r["chrom"], r["idx"]): (r["opt"], r["brk"]) for r in blocks.partition(sites, graph, cost, 40, by).collect()}
    earlier = None
    for start, end in ((900, 2000), (250, 899), (0, 249)):
        near = sites.where(f"pos BETWEEN {start} AND {end + 40}")
        part = blocks.partition(near, graph.where(f"loc_a >= {start} AND loc_b <= {end + 40}"), cost, 40, by, 50, 50, end, earlier)
        earlier = spark.createDataFrame([(r["chrom"], r["idx"], r["pos"], r["opt"], r["brk"]) for r in part.collect()], "chrom string, idx long, pos long, opt double, brk long")
    assert {(r["chrom"], r["idx"]): (r["opt"], r["brk"]) for r in earlier.collect()} == {k: (pytest.approx(o, abs=1e-9), b) for k, (o, b) in whole.items()}
    assert len(whole) == sum(map(len, lines.values()))


@pytest.mark.parametrize("stretch", [16, 1 << 16])
def test_walks(spark, stretch):
    rng = random.Random(stretch)
    rows, want = [], []
    for c in "ab":
        following = [min(i + rng.randint(1, 9), 700) for i in range(700)]
        rows += [(c, i + 3, n + 3) for i, n in enumerate(following)]
        at = 0
        while at < 700:
            want.append((c, at + 3))
            at = following[at]
    steps = spark.createDataFrame(rows, "c string, idx long, next long").repartition(5)
    assert sorted((r["c"], r["idx"]) for r in chains.visited(steps, ["c"], stretch).collect()) == want
    assert chains.visited(steps.where("false"), ["c"]).count() == 0


@pytest.mark.parametrize("unphased", [True, False])
def test_bands_by_joined_planes(spark, monkeypatch, unphased):
    """Matrix products of tiles, in small blocks, against the bits that joined planes have in common."""
    from pyspark.sql import functions as F

    from haploweave.operators import pairs, sites

    monkeypatch.setattr(pairs, "LEFT", 3)
    monkeypatch.setattr(pairs, "RIGHT", 4)
    rng = random.Random(7)
    data = [(c, p, [rng.choice([0, 1, 2, None] if unphased else [0, 1]) for _ in range(150)]) for c in "ab" for p in sorted(rng.sample(range(200), 40))]
    packed = sites.pack(sites.variance(sites.count_scores(spark.createDataFrame(data, "c string, pos long, scores array<int>"))), 150)
    n = F.col("n").cast("double")
    covariance = (F.col("inner") - n * F.col("a_mean") * F.col("b_mean")) / (n - 1)
    joined = pairs.pair_counts(packed, 30, 3, unphased, ["c"]).withColumn("r2", covariance * covariance / (F.col("a_variance") * F.col("b_variance")))
    want = {(r["c"], r["a_pos"], r["b_pos"]): pytest.approx(min(r["r2"], 1.0), abs=1e-12) for r in joined.collect()}
    found = pairs.correlate(packed, 30, unphased=unphased, by=["c"]).collect()
    assert {(r["c"], r["loc_a"], r["loc_b"]): r["r2"] for r in found} == want
    assert not any(r["bad"] for r in found)
    few = pairs.correlate(packed, 30, 0.01, unphased, ["c"]).collect()
    assert {(r["c"], r["loc_a"], r["loc_b"]) for r in few} == {(r["c"], r["loc_a"], r["loc_b"]) for r in found if r["r2"] >= 0.01}


def test_levels_of_a_pyramid(spark, sf_dir):
    """Each level equals the squares binned at its width; two pyramids merge into that of all edges; one shuffle makes it."""
    from haploweave.operators import matrix
    from haploweave.plans import synth

    graph = synth.items(spark, sf_dir)
    graph = spark.createDataFrame(graph.collect(), graph.schema)
    squares = matrix.pyramid(graph, 20, 4)
    assert squares._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for level in range(4):
        own = {(r["bin_a"], r["bin_b"]): r["total"] / r["n"] for r in squares.where(f"level = {level}").collect()}
        plain = {(r["bin_a"], r["bin_b"]): r["r"] for r in matrix.binned(graph, 20 << level).collect()}
        assert own == pytest.approx(plain)
    halves = [matrix.pyramid(graph.where(f"loc_b % 2 = {k}"), 20, 4) for k in (0, 1)]
    rows = lambda s: sorted((r["level"], r["bin_a"], r["bin_b"], r["n"], round(r["total"], 9), r["most"]) for r in s.collect())
    assert rows(matrix.merge_pyramids(halves)) == rows(squares)
    assert matrix.level_for(0, 79, 20, 4, 4) == 0
    assert matrix.level_for(0, 80, 20, 4, 4) == 1
    assert matrix.level_for(0, 10**6, 20, 4, 4) == 3
    assert matrix.pyramid(graph.limit(0), 20, 4).count() == 0


def test_edges_of_a_square_lie_in_one_task(spark, sf_dir, monkeypatch):
    """What ld_matrix_pyramid sums: tasks grow in number, not in size, and each holds whole squares, so that it keeps few partial sums."""
    from pyspark.sql import functions as F

    from haploweave.plans import synth

    monkeypatch.setattr(edges, "TASK_EDGES", 50)
    graph = synth.items(spark, sf_dir)
    assert graph.rdd.getNumPartitions() == -(-synth.raw_items(spark, sf_dir).count() // 50)
    squares = graph.select(F.floor(F.col("loc_a") / edges.NEAR).alias("a"), F.floor(F.col("loc_b") / edges.NEAR).alias("b"), F.spark_partition_id().alias("task")).distinct()
    assert squares.groupBy("a", "b").count().where("count > 1").count() == 0
    assert squares.select("task").distinct().count() > 1
    plain = edges.combine([synth.raw_items(spark, sf_dir)])
    assert sorted(map(tuple, graph.collect())) == sorted(map(tuple, plain.collect()))
