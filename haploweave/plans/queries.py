"""One query for each operator, on inputs derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haploweave.functions import statistics
from haploweave.operators import blocks, consensus, edges, matrix, pairs, penalty, ranges, sites, tiles
from haploweave.plans import synth
from haploweave.sources import genotypes, shared, sinks, text, vcf


def _r(column: str | Column, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, digits) + F.lit(0.0)).alias(column if isinstance(column, str) else "value")


def edge_parse_text(spark, d):
    return text.parse_edges(synth.item_lines(spark, d), "keep").groupBy(F.col("bad").isNotNull().alias("is_bad")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("loc_a", "sum_a"), ("loc_b", "sum_b"))), _r(F.coalesce(F.sum("r"), F.lit(0.0)), 4).alias("sum_r"))


def edge_canonicalize(spark, d):
    return edges.canonical(synth.raw_items(spark, d))


def edge_duplicates(spark, d):
    return edges.duplicates(edges.canonical(synth.raw_items(spark, d)))


def variant_list(spark, d):
    return blocks.chromosome(edges.positions([edges.canonical(synth.raw_items(spark, d))]))


def chromosome_extent(spark, d):
    return blocks.extent(variant_list(spark, d))


def combine_max(spark, d):
    raw = synth.raw_items(spark, d)
    return edges.combine([raw.where("loc_a % 2 = 0"), raw.where("loc_a % 2 = 1")], parts=edges.parts_for(raw.count(), spark.sparkContext.defaultParallelism))


def _stored(spark, d) -> list[DataFrame]:
    """Both halves of the edges as bucketed tables, of more buckets the more edges there are."""
    raw, out = synth.raw_items(spark, d), []
    rows = raw.count()
    for k in (0, 1):
        at = shared.folder(spark, "edges")
        half = edges.combine([raw.where(f"loc_a % 2 = {k}")], parts=edges.parts_for(rows // 2, spark.sparkContext.defaultParallelism))
        out.append(sinks.write_bucketed(half, at.rsplit("/", 1)[1].replace("-", "_"), at, edges.parts_for(rows, 8)))
    return out


def combine_bucketed(spark, d):
    return edges.merge(_stored(spark, d))


def degree_bucketed(spark, d):
    return edges.degree_of_buckets(edges.merge(_stored(spark, d))).select("pos", _r("k"))


def degree_k(spark, d):
    return edges.degree(synth.items(spark, d)).select("pos", _r("k"))


def total_weight_m(spark, d):
    return edges.total_weight(synth.items(spark, d)).select(_r("m"))


def degree_normalized(spark, d):
    return edges.normalized_degree(synth.items(spark, d)).select("pos", _r("k_norm", 9))


def background_penalty(spark, d):
    return edges.background(synth.items(spark, d), 100).select("n_edges", "n_long", _r("penalty", 9))


def _observations(spark, d) -> int:
    """Observations of the phased table: two for each individual."""
    return 2 * vcf.samples_in(synth.vcf_lines(spark, d, True)).count()


def chi_penalty(spark, d):
    n = _observations(spark, d)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), _r(F.lit(statistics.chi_penalty(n)), 9).alias("penalty"))


def fisher_penalty(spark, d):
    n = _observations(spark, d)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), _r(F.lit(statistics.fisher_penalty(n)), 9).alias("penalty"))


def power_penalty(spark, d):
    n = _observations(spark, d)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), _r(F.lit(statistics.solve_alpha(n, 0.3, 0.8)), 9).alias("alpha"), _r(F.lit(statistics.power_penalty(n, 0.3, 0.8)), 9).alias("penalty"), _r(F.lit(statistics.solve_w(n, 0.05, 0.8)), 9).alias("w"))


def _ids(spark) -> DataFrame:
    """Individuals asked for: every third, and one that isn't there."""
    return spark.range(0, 33, 3).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample"))


def sample_semi_join(spark, d):
    found = vcf.samples_in(synth.vcf_lines(spark, d, True), _ids(spark))
    return found.select(F.col("column").cast("long").alias("column"), "sample")


def sample_individuals(spark, d):
    names = synth.table(spark, d, "customer").select(F.col("c_name").alias("sample"))
    return text.sample_ids(names, 100)


def sample_edges(spark, d):
    return text.sample_rows(synth.items(spark, d), 100, ["loc_a", "loc_b"])


def panel_by_superpop(spark, d):
    c, n, r = (synth.table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.select(F.concat_ws("\t", F.regexp_replace("c_name", r"\s", "_"), F.regexp_replace("n_name", r"\s", "_"), F.regexp_replace("r_name", r"\s", "_")).alias("line"))
    lines = lines.unionByName(spark.range(1).select(F.lit("sample\tpop\tsuper_pop\tgender").alias("line")))
    return text.ids_by_super_pop(text.parse_panel(lines)).select("super_pop", "n_samples", F.element_at("samples", 1).alias("first_sample"), F.element_at("samples", -1).alias("last_sample"))


_COUNTS = ["pos", "n0", "n1", "n2", "n_missing", "n_present"]


def geno_counts_phased(spark, d):
    return synth.counted(spark, d, True).select(*_COUNTS, _r("mean", 9), "multiallelic")


def geno_counts_unphased(spark, d):
    return synth.counted(spark, d, False).select(*_COUNTS, _r("mean", 9), "multiallelic")


def geno_counts_selected(spark, d):
    return synth.counted(spark, d, True, _ids(spark)).select(*_COUNTS, _r("mean", 9), "multiallelic")


def geno_counts_files(spark, d):
    """The same individuals, from files that the data source reads."""
    at = shared.folder(spark, "genotypes")
    synth.write_vcf(spark, d, at)
    rows = sites.count_scores(sites.decode(genotypes.read(spark, at, _ids(spark)).drop("chrom"), True))
    return rows.select(*_COUNTS, _r("mean", 9), "multiallelic")


def site_row_counts(spark, d):
    """Rows for each position, where every 50th is repeated."""
    lines = synth.table(spark, d, "embeddings").select(F.explode(F.array_repeat("vec_id", F.when(F.col("vec_id") % 50 == 0, 2).otherwise(1))).alias("pos"))
    return sites.row_counts(lines).where("n_rows > 1")


def _reasons(spark, d) -> DataFrame:
    rows = synth.counted(spark, d, True)
    return sites.with_reason(rows.unionByName(rows.where("pos % 50 = 5")), 0.4)


def site_filter_reasons(spark, d):
    return sites.reason_counts(_reasons(spark, d))


def maf_filter(spark, d):
    return _reasons(spark, d).where("reason IS NULL").select("pos", _r("mean", 9))


def high_missingness(spark, d):
    return sites.high_missingness(synth.counted(spark, d, False), 0.04).select("pos", "n_missing")


def variance(spark, d):
    return synth.scored_sites(spark, d, False).select("pos", _r("variance", 9))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("loc_a", "loc_b", _r("r2", 9), "bad")


def pair_r2_phased(spark, d):
    return _pairs(pairs.correlate(synth.packed(spark, d, True), synth.LONGEST, 0.001, unphased=False))


def pair_r2_unphased_missing(spark, d):
    return _pairs(pairs.correlate(synth.packed(spark, d, False), synth.LONGEST, 0.001))


def pair_r2_wide(spark, d):
    """Of sites with 1,024 individuals: 16 words a plane."""
    return _pairs(pairs.correlate(synth.wide(spark, d), synth.LONGEST, 0.001))


def _map(spark, d) -> DataFrame:
    return text.parse_genetic_map(synth.genetic_map_lines(spark, d))


def pair_r2_shrinkage(spark, d):
    mapped = pairs.with_map(synth.packed(spark, d, True), _map(spark, d))
    return _pairs(pairs.correlate_shrunk(mapped, synth.LONGEST, 32, 100.0, 0.001))


def gmap_missing_sites(spark, d):
    return pairs.without_map(synth.chrom(spark, d), _map(spark, d))


def genetic_map_lookup(spark, d):
    return pairs.with_map(synth.chrom(spark, d), _map(spark, d)).select("pos", _r("cm"))


def _part_line(spark, d) -> DataFrame:
    """Positions with gaps of different lengths."""
    return blocks.chromosome(synth.table(spark, d, "part").select((F.col("p_partkey") * 3 + F.col("p_size") % 3 + 40 * F.floor(F.col("p_partkey") / 4)).alias("pos")))


def right_neighbor(spark, d):
    return ranges.neighbours(_part_line(spark, d), 100).select("pos", "right_idx", "right_pos")


def left_neighbor(spark, d):
    return ranges.neighbours(_part_line(spark, d), 100).select("pos", "left_idx", "left_pos")


def _chunks(spark, d) -> DataFrame:
    return blocks.chunks(synth.chrom(spark, d), synth.LONGEST, 150)


def chunk_intervals(spark, d):
    return _chunks(spark, d)


def chunk_edge_subset(spark, d):
    found = edges.by_chunk(synth.graph(spark, d), _chunks(spark, d), 4, synth.LONGEST)
    return found.groupBy("start_bp", "buffer_end_bp", "sub_bucket").agg(F.count("*").alias("n_edges"), _r(F.sum("r"), 4).alias("sum_r"))


def _grid(spark, d) -> DataFrame:
    return blocks.weights(synth.chrom(spark, d), synth.graph(spark, d), penalty.Constant(synth.PENALTY), synth.LONGEST)


def pair_weights_threshold(spark, d):
    return _grid(spark, d).select("i", "j", "pos_i", "pos_j", _r("w", 9))


def window_scores_threshold(spark, d):
    return tiles.window_scores(synth.chrom(spark, d), synth.graph(spark, d), penalty.Constant(synth.PENALTY), synth.LONGEST, width=4 * synth.LONGEST).select("pos_i", "pos_j", _r("score"))


def window_scores_grid(spark, d):
    """The same scores by way of a row for each pair, which serves any penalty."""
    return blocks.window_scores(_grid(spark, d)).select("pos_i", "pos_j", _r("score"))


def window_scores_modularity(spark, d):
    """The coefficient, the line's length over the longest block, is dealt to both sides of a pair."""
    graph = synth.graph(spark, d)
    line = synth.chrom(spark, d).join(edges.normalized_degree(graph).select("pos", "k_norm"), "pos")
    root = blocks.extent(synth.chrom(spark, d)).select(F.sqrt(F.col("length_bp") / synth.LONGEST).alias("root"))
    line = line.crossJoin(F.broadcast(root)).select("pos", "idx", (F.col("k_norm") * F.col("root")).alias("k_norm"))  # one row
    return tiles.window_scores(line, graph, penalty.Modularity(1.0), synth.LONGEST, width=4 * synth.LONGEST).select("pos_i", "pos_j", _r("score"))


#: Sites of a part of the partition: few, as the line is short.
PART, AHEAD = 512, 128


def _optimum(spark, d, **more) -> DataFrame:
    return blocks.partition(synth.chrom(spark, d), synth.graph(spark, d), penalty.Constant(synth.PENALTY), synth.LONGEST, stretch=PART, **more)


def opt_scores(spark, d):
    return _optimum(spark, d).select("pos", _r("opt"), "brk")


def opt_blocks(spark, d):
    return blocks.blocks(_optimum(spark, d))


def best_total(spark, d):
    return blocks.best_total(_optimum(spark, d)).select(_r("opt"))


def partition_summary(spark, d):
    found = blocks.summary(opt_blocks(spark, d))
    return found.select("n_blocks", "start_bp", "end_bp", "uncovered_bp", "max_gap", _r("uncovered_percent"))


def chunked_opt_scores(spark, d):
    scores = blocks.chunk_scores(synth.chrom(spark, d), synth.graph(spark, d), penalty.Constant(synth.PENALTY), synth.LONGEST, _chunks(spark, d), synth.LONGEST)
    return blocks.optimum(scores, sites=PART, ahead=AHEAD).select("pos", _r("opt"), "brk")


BUFFER, REACH = 40, 200


def consensus_shrunk(spark, d):
    return consensus.shrunk(synth.block_sets(spark, d), BUFFER).select("pop", "start", "stop")


def consensus_intervals(spark, d):
    return consensus.merged(synth.block_sets(spark, d), BUFFER)


def consensus_coverage(spark, d):
    sets = synth.block_sets(spark, d)
    return consensus.coverage(consensus.merged(sets, BUFFER), consensus.extremes(sets)).select("covered", _r("coverage_percent"))


def consensus_violations(spark, d):
    sets = synth.block_sets(spark, d)
    return consensus.violations(sets, consensus.merged(sets, BUFFER), REACH)


def consensus_repaired(spark, d):
    return consensus.repaired(synth.block_sets(spark, d), BUFFER, REACH)


def interval_overlaps(spark, d):
    sets = synth.block_sets(spark, d)
    side = lambda p, s, e: sets.where(F.col("pop") == p).select(F.col("block_start").alias(s), (F.col("block_end") + 1).alias(e))
    return ranges.overlaps(side("P0", "s", "e"), side("P1", "u", "v"), ("s", "e", "u", "v"), 250)


def interval_overlaps_levels(spark, d):
    """Of intervals whose lengths differ by up to 65,536 times."""
    long = lambda key, most: F.pow(F.lit(2.0), F.col(key) % most).cast("long")
    left = synth.table(spark, d, "part").select((F.col("p_partkey") * 50).alias("s"), (F.col("p_partkey") * 50 + long("p_partkey", 13)).alias("e"))
    right = synth.table(spark, d, "supplier").select((F.col("s_suppkey") * 997).alias("u"), (F.col("s_suppkey") * 997 + long("s_suppkey", 17)).alias("v"))
    return ranges.overlaps(left, right, ("s", "e", "u", "v"), 16)


def block_triangles(spark, d):
    return consensus.triangles(synth.block_sets(spark, d), ["pop"])


def blocks_shown(spark, d):
    return matrix.blocks_shown(synth.block_sets(spark, d), 1000, 20000)


def nearest_variant(spark, d):
    points = synth.table(spark, d, "supplier").select((F.col("s_suppkey") * 17 % 6000).alias("point")).distinct()
    return ranges.nearest(points, _part_line(spark, d))


def next_variant(spark, d):
    return ranges.following(_part_line(spark, d))


def ld_matrix_long(spark, d):
    return matrix.matrix_long(synth.graph(spark, d), 100, 200).select("loc_a", "loc_b", _r("r", 9))


def ld_matrix_dense(spark, d):
    """A square of the matrix, a column for each right end."""
    found = matrix.matrix(synth.graph(spark, d), 100, 106)
    return found.select("loc_a", *(F.round(c, 9).alias(c) for c in found.columns if c != "loc_a"))


def ld_matrix_binned(spark, d):
    return matrix.binned(synth.items(spark, d), 100).select("bin_a", "bin_b", _r("r"))


LEVELS = 5


def ld_matrix_pyramid(spark, d):
    return matrix.pyramid(synth.items(spark, d), 25, LEVELS).select("level", "bin_a", "bin_b", "n", _r("total"), _r("most"))


def ld_matrix_shown(spark, d):
    """Of two halves of the edges, merged: what a display of at most 40 squares a side takes."""
    graph = synth.items(spark, d)
    squares = matrix.merge_pyramids([matrix.pyramid(graph.where(f"(loc_a + loc_b) % 2 = {k}"), 25, LEVELS) for k in (0, 1)])
    return matrix.shown(squares, 0, 1999, 25, LEVELS, 40).select("bin_a", "bin_b", "start_a", "start_b", _r("r"), _r("most"))


def edge_bucket_counts(spark, d):
    """Left ends whose edges fall into more than one bucket: none. And how many edges there are."""
    rows = synth.items(spark, d).withColumn("bucket", edges.bucket(F.col("loc_a"), 16))
    return rows.groupBy("loc_a").agg(F.countDistinct("bucket").alias("n_buckets"), F.count("*").alias("n_edges"))


def long_range_edges(spark, d):
    return edges.longer(synth.items(spark, d), 100)


def edges_in_range(spark, d):
    return edges.subset(synth.items(spark, d), 10, 60)


def degree_range(spark, d):
    return edges.normalized_degree(synth.items(spark, d)).where(F.col("pos").between(100, 300)).select("pos", _r("k_norm", 9))


def dp_resume(spark, d):
    """The partition again, where the optimum right of position 300 is taken from an earlier run."""
    line = synth.chrom(spark, d)
    right = blocks.partition(line.where("pos > 300"), synth.graph(spark, d).where("loc_a > 300"), penalty.Constant(synth.PENALTY), synth.LONGEST)
    return _optimum(spark, d, earlier=right.select("idx", "pos", "opt", "brk")).select("pos", _r("opt"), "brk")


def dp_resume_scores(spark, d):
    """The same from tables of window scores."""
    scores = blocks.window_scores(_grid(spark, d))
    earlier = blocks.optimum(scores.where("pos_i > 300"))
    return blocks.optimum(blocks.resume(scores.where("pos_i <= 300"), earlier)).select("pos", _r("opt"), "brk")


QUERIES = {
    f.__name__: f
    for f in (
        edge_parse_text, edge_canonicalize, edge_duplicates, variant_list, chromosome_extent, combine_max, combine_bucketed, degree_k, degree_bucketed, total_weight_m, degree_normalized, degree_range,
        background_penalty, long_range_edges, edges_in_range, chi_penalty, fisher_penalty, power_penalty, sample_semi_join, sample_individuals, sample_edges, panel_by_superpop, geno_counts_phased,
        geno_counts_unphased, geno_counts_selected, geno_counts_files, site_row_counts, site_filter_reasons, maf_filter, high_missingness, variance, pair_r2_phased, pair_r2_unphased_missing,
        pair_r2_wide, pair_r2_shrinkage, gmap_missing_sites, genetic_map_lookup, right_neighbor, left_neighbor, chunk_intervals, chunk_edge_subset, pair_weights_threshold,
        window_scores_threshold, window_scores_grid, window_scores_modularity, opt_scores, opt_blocks, best_total, partition_summary, chunked_opt_scores, dp_resume, dp_resume_scores, consensus_shrunk,
        consensus_intervals, consensus_coverage, consensus_violations, consensus_repaired, interval_overlaps, interval_overlaps_levels, block_triangles, blocks_shown, nearest_variant, next_variant,
        ld_matrix_long, ld_matrix_dense, ld_matrix_binned, ld_matrix_pyramid, ld_matrix_shown, edge_bucket_counts,
    )
}
