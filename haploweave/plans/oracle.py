"""The queries of ``queries`` in SQL, each written for itself from the tables at hand."""

from __future__ import annotations

ITEMS_RAW = "raw AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE * l_discount AS r FROM lineitem)"
CANON = f"{ITEMS_RAW}, canon AS (SELECT least(a, b) AS loc_a, greatest(a, b) AS loc_b, abs(r) AS r FROM raw WHERE a <> b)"
ITEMS = f"{CANON}, items AS (SELECT loc_a, loc_b, max(r) AS r FROM canon GROUP BY ALL)"
DEGREE = f"{ITEMS}, k AS (SELECT pos, sum(r) AS k FROM (SELECT loc_a AS pos, r FROM items UNION ALL SELECT loc_b, r FROM items) GROUP BY pos)"

VALUES = "v AS (SELECT vec_id AS pos, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
HAPS = f"{VALUES}, s AS (SELECT pos, idx, CASE WHEN v > 0 THEN 1 ELSE 0 END AS x FROM v)"
DOSES = f"{VALUES}, s AS (SELECT pos, idx, CASE WHEN (pos * 7 + idx) % 29 = 0 THEN NULL WHEN v < CAST(-0.05 AS DOUBLE) THEN 0 WHEN v < CAST(0.05 AS DOUBLE) THEN 1 ELSE 2 END AS x FROM v)"
#: Sixteen vectors a site; individuals of a vector that isn't there are missing.
WIDE = f"""{DOSES.replace("s AS", "one AS")}, every AS (SELECT pos, idx FROM (SELECT DISTINCT pos // 16 AS pos FROM one), (SELECT unnest(range(1024)) AS idx)),
  s AS (SELECT every.pos, every.idx, x FROM every LEFT JOIN one ON one.pos // 16 = every.pos AND one.pos % 16 * 64 + one.idx = every.idx)"""
#: The phased table as its text says: first individual of each 20th position has a third allele, each 40th varies nowhere.
TEXT_HAPS = f"""{VALUES}, s AS (SELECT pos, idx, CASE WHEN pos % 20 = 10 AND idx = 0 THEN 0 WHEN pos % 20 = 10 AND idx = 1 THEN NULL WHEN pos % 20 <> 10 AND pos % 40 = 20 THEN 0 WHEN v > 0 THEN 1 ELSE 0 END AS x,
  pos % 20 = 10 AND idx = 1 AS other FROM v)"""
COUNTS = "count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 2) AS n2, count(*) FILTER (x IS NULL) AS n_missing, count(x) AS n_present, round(avg(CAST(x AS DOUBLE)), 9) AS mean"
REASONS = f"""{TEXT_HAPS}, c AS (SELECT pos, {COUNTS.replace("round(avg(CAST(x AS DOUBLE)), 9)", "avg(CAST(x AS DOUBLE))")}, bool_or(other) AS multiallelic FROM s GROUP BY pos),
  q AS (SELECT *, CASE WHEN multiallelic OR pos % 50 = 5 THEN 'multiallelic' WHEN n_present = 0 THEN 'missing' WHEN n0 = n_present OR n1 = n_present OR n2 = n_present THEN 'no_variation' WHEN mean <= CAST(0.4 AS DOUBLE) OR mean >= CAST(1 - 0.4 AS DOUBLE) THEN 'maf' END AS reason FROM c)"""


def _moments(distance: int) -> str:
    return f"""st AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS m, var_samp(CAST(x AS DOUBLE)) AS var, count(x) AS present, count(*) - count(x) AS missing FROM s GROUP BY pos),
  i AS (SELECT p.pos AS loc_a, q.pos AS loc_b, coalesce(sum(p.x * q.x), 0) AS inn, count(*) FILTER (p.x IS NULL AND q.x IS NULL) AS both_missing
        FROM s p JOIN s q ON p.idx = q.idx AND q.pos > p.pos AND q.pos <= p.pos + {distance} GROUP BY ALL),
  n AS (SELECT i.*, a.m AS ma, b.m AS mb, a.var AS va, b.var AS vb, CAST(a.present + both_missing - b.missing AS DOUBLE) AS n FROM i JOIN st a ON a.pos = loc_a JOIN st b ON b.pos = loc_b),
  cov AS (SELECT *, (CAST(inn AS DOUBLE) - n * ma * mb) / (n - 1) AS cov FROM n)"""


def _r2(value: str, source: str, least: float = 0.001) -> str:
    return f"""SELECT loc_a, loc_b, round(CASE WHEN r2 > 1 AND r2 <= 1.01 THEN 1.0 ELSE r2 END, 9) + 0.0 AS r2, r2 > 1.01 AS bad FROM (SELECT loc_a, loc_b, {value} AS r2 FROM {source}) WHERE r2 >= {least}"""


GRAPH = f"{HAPS}, {_moments(50)}, graph AS (SELECT loc_a, loc_b, least(cov * cov / (va * vb), 1.0) AS r FROM cov)"
LINE = "line AS (SELECT vec_id AS pos, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM (SELECT DISTINCT vec_id FROM embeddings))"
GRID = f"""{GRAPH}, {LINE}, grid AS MATERIALIZED (SELECT p.idx AS i, q.idx AS j, p.pos AS pos_i, q.pos AS pos_j, coalesce(r, 0.0) - CAST(0.06 AS DOUBLE) AS w
  FROM line p JOIN line q ON q.pos >= p.pos AND q.pos <= p.pos + 50 LEFT JOIN graph ON loc_a = p.pos AND loc_b = q.pos)"""
SCORES = """down AS (SELECT *, sum(w) OVER (PARTITION BY j ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS d FROM grid),
  c AS MATERIALIZED (SELECT i, j, pos_i, pos_j, sum(d) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) AS score FROM down)"""
#: opts[k] is the optimum k - 1 sites after the site at hand.
DP = f"""{GRID}, {SCORES}, size AS (SELECT max(idx) AS last FROM line),
  dp(i, opts, brk) AS (SELECT (SELECT last FROM size) + 1, [CAST(0 AS DOUBLE)], CAST(NULL AS BIGINT)
    UNION ALL SELECT b.i, list_prepend(b.opt, list_slice(any_value(dp.opts), 1, 60)), b.brk FROM dp,
      LATERAL (SELECT c.i, max(c.score + dp.opts[c.j - c.i + 1]) AS opt, arg_min(c.j, (-(c.score + dp.opts[c.j - c.i + 1]), c.j)) AS brk FROM c WHERE c.i = dp.i - 1 GROUP BY c.i) b GROUP BY b.i, b.opt, b.brk),
  opt AS MATERIALIZED (SELECT dp.i AS idx, line.pos, dp.opts[1] AS opt, e.pos AS brk, dp.brk AS brk_idx FROM dp JOIN line ON line.idx = dp.i JOIN line e ON e.idx = dp.brk)"""
OPT = f"WITH RECURSIVE {DP} SELECT pos, round(opt, 6) + 0.0 AS opt, brk FROM opt"
BLOCKS = f"""{DP}, chain(nxt, block_start, block_end) AS (SELECT brk_idx + 1, pos, brk FROM opt WHERE idx = 0
    UNION ALL SELECT opt.brk_idx + 1, opt.pos, opt.brk FROM chain JOIN opt ON opt.idx = chain.nxt)"""
NEAR = """near AS (SELECT pos, idx, max(idx) OVER r AS right_idx, max(pos) OVER r AS right_pos, min(idx) OVER l AS left_idx, min(pos) OVER l AS left_pos FROM line
  WINDOW r AS (ORDER BY pos RANGE BETWEEN CURRENT ROW AND {0} FOLLOWING), l AS (ORDER BY pos RANGE BETWEEN {0} PRECEDING AND CURRENT ROW))"""
CHUNKS = f"""{LINE}, {NEAR.format(50)}, top AS (SELECT max(idx) AS last FROM line),
  step AS (SELECT n.idx, n.pos, CASE WHEN least(n.idx + 149, last) = last THEN last ELSE m.left_idx END AS e FROM near n, top JOIN near m ON m.idx = least(n.idx + 149, last)),
  chunk(nxt, start_bp, end_bp, buffer_end_bp) AS (SELECT e + 1, step.pos, n.pos, n.right_pos FROM step JOIN near n ON n.idx = e WHERE step.idx = 0
    UNION ALL SELECT e + 1, step.pos, n.pos, n.right_pos FROM chunk JOIN step ON step.idx = chunk.nxt JOIN near n ON n.idx = e)"""
PART_LINE = "line AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS idx FROM (SELECT DISTINCT p_partkey * 3 + p_size % 3 + 40 * (p_partkey // 4) AS pos FROM part))"
#: Every 40 positions one that no part maps.
GMAP = "gmap AS (SELECT p_partkey + p_partkey // 39 AS pos, CAST(p_partkey AS DOUBLE) / 1000 + p_size / CAST(1e6 AS DOUBLE) AS cm FROM part)"
SETS = """sets AS (SELECT 'P' || p AS pop, k * 100 + (k * k * 7 + p * 13) % 60 AS block_start, (k + 1) * 100 + ((k + 1) * (k + 1) * 7 + p * 13) % 60 - 1 AS block_end
  FROM (SELECT c_custkey AS k, unnest(range(4)) AS p FROM customer))"""
SHORT = f"{SETS}, short AS (SELECT pop, block_start + CAST(20 AS DOUBLE) AS start, block_end + 1 - CAST(20 AS DOUBLE) AS stop FROM sets WHERE block_start + 20 < block_end + 1 - 20)"
MERGED = f"""{SHORT}, ends AS (SELECT min(block_start) AS lo, max(block_end) AS hi FROM sets), inner_ends AS (SELECT min(start) AS slo, max(stop) AS shi FROM short),
  pieces AS (SELECT start, stop FROM short UNION ALL SELECT lo, slo + 1 FROM ends, inner_ends UNION ALL SELECT greatest(shi, slo + 1) - 1, hi FROM ends, inner_ends),
  marked AS (SELECT *, coalesce(start >= max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM pieces WHERE start < stop),
  isl AS (SELECT *, sum(fresh) OVER (ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM marked),
  cons AS (SELECT min(start) AS start, max(stop) AS stop FROM isl GROUP BY k)"""

OBSERVED = "64"
ORACLE = {
    "edge_parse_text": """SELECT l_orderkey % 1000 = 7 AS is_bad, count(*) AS n, CAST(coalesce(sum(l_partkey) FILTER (l_orderkey % 1000 <> 7), 0) AS BIGINT) AS sum_a, CAST(coalesce(sum(l_suppkey) FILTER (l_orderkey % 1000 <> 7), 0) AS BIGINT) AS sum_b,
      round(coalesce(sum(round(l_discount, 2)) FILTER (l_orderkey % 1000 <> 7), 0), 4) + 0.0 AS sum_r FROM lineitem GROUP BY 1""",
    "edge_canonicalize": f"WITH {CANON} SELECT * FROM canon",
    "edge_duplicates": f"WITH {CANON} SELECT loc_a, loc_b, count(*) AS n FROM canon GROUP BY ALL HAVING count(*) > 1",
    "variant_list": f"WITH {CANON}, p AS (SELECT loc_a AS pos FROM canon UNION SELECT loc_b FROM canon) SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS idx FROM p",
    "chromosome_extent": f"WITH {CANON}, p AS (SELECT loc_a AS pos FROM canon UNION SELECT loc_b FROM canon) SELECT min(pos) AS start_bp, max(pos) AS end_bp, max(pos) - min(pos) AS length_bp, count(*) AS n_sites FROM p",
    "combine_max": f"WITH {ITEMS} SELECT * FROM items",
    "combine_bucketed": f"WITH {ITEMS} SELECT * FROM items",
    "degree_k": f"WITH {DEGREE} SELECT pos, round(k, 6) + 0.0 AS k FROM k",
    "degree_bucketed": f"WITH {DEGREE} SELECT pos, round(k, 6) + 0.0 AS k FROM k",
    "total_weight_m": f"WITH {ITEMS} SELECT round(sum(r), 6) + 0.0 AS m FROM items",
    "degree_normalized": f"WITH {DEGREE} SELECT pos, round(k / sqrt(2 * (SELECT sum(r) FROM items)), 9) + 0.0 AS k_norm FROM k",
    "degree_range": f"WITH {DEGREE} SELECT pos, round(k / sqrt(2 * (SELECT sum(r) FROM items)), 9) + 0.0 AS k_norm FROM k WHERE pos BETWEEN 100 AND 300",
    "background_penalty": f"WITH {ITEMS} SELECT count(*) AS n_edges, count(*) FILTER (loc_b - loc_a > 100) AS n_long, round(avg(r) FILTER (loc_b - loc_a > 100) + 2 * stddev_pop(r) FILTER (loc_b - loc_a > 100), 9) + 0.0 AS penalty FROM items",
    "long_range_edges": f"WITH {ITEMS} SELECT * FROM items WHERE loc_b - loc_a > 100",
    "edges_in_range": f"WITH {ITEMS} SELECT * FROM items WHERE loc_a >= 10 AND loc_b <= 60",
    # the 95 % quantile of chi-square with one degree of freedom
    "chi_penalty": f"SELECT CAST({OBSERVED} AS BIGINT) AS n, round(CAST(3.841458820694124 AS DOUBLE) / {OBSERVED}, 9) + 0.0 AS penalty",
    "fisher_penalty": f"WITH t AS (SELECT exp(2 * CAST(1.96 AS DOUBLE) / sqrt({OBSERVED} - 3)) AS e) SELECT CAST({OBSERVED} AS BIGINT) AS n, round(pow((e - 1) / (e + 1), 2), 9) + 0.0 AS penalty FROM t",
    "sample_semi_join": "SELECT CAST(9 + i AS BIGINT) AS \"column\", 'S' || i AS sample FROM range(0, 32, 3) t(i)",
    "sample_individuals": "SELECT c_name AS sample FROM customer ORDER BY md5('sample:' || c_name), c_name LIMIT 100",
    "sample_edges": f"WITH {ITEMS} SELECT * FROM items ORDER BY md5('sample:' || loc_a || ':' || loc_b), loc_a, loc_b LIMIT 100",
    "panel_by_superpop": r"""SELECT regexp_replace(r_name, '\s', '_', 'g') AS super_pop, count(*) AS n_samples, min(regexp_replace(c_name, '\s', '_', 'g')) AS first_sample, max(regexp_replace(c_name, '\s', '_', 'g')) AS last_sample
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "geno_counts_phased": f"WITH {TEXT_HAPS} SELECT pos, {COUNTS}, bool_or(other) AS multiallelic FROM s GROUP BY pos",
    "geno_counts_unphased": f"WITH {DOSES} SELECT pos, {COUNTS}, false AS multiallelic FROM s GROUP BY pos",
    "geno_counts_selected": f"WITH {TEXT_HAPS} SELECT pos, {COUNTS}, bool_or(other) AS multiallelic FROM s WHERE (idx // 2) % 3 = 0 GROUP BY pos",
    "geno_counts_files": f"WITH {TEXT_HAPS} SELECT pos, {COUNTS}, bool_or(other) AS multiallelic FROM s WHERE (idx // 2) % 3 = 0 GROUP BY pos",
    "site_row_counts": "SELECT vec_id AS pos, CAST(2 AS BIGINT) AS n_rows FROM embeddings WHERE vec_id % 50 = 0",
    "site_filter_reasons": f"WITH {REASONS} SELECT reason, count(*) AS n_sites FROM q WHERE reason IS NOT NULL GROUP BY reason",
    "maf_filter": f"WITH {REASONS} SELECT pos, round(mean, 9) AS mean FROM q WHERE reason IS NULL",
    "high_missingness": f"WITH {DOSES} SELECT pos, count(*) - count(x) AS n_missing FROM s GROUP BY pos HAVING count(*) - count(x) >= CAST(0.04 AS DOUBLE) * count(*)",
    "variance": f"WITH {DOSES} SELECT pos, round(var_samp(CAST(x AS DOUBLE)), 9) + 0.0 AS variance FROM s GROUP BY pos",
    "pair_r2_phased": f"WITH {HAPS}, {_moments(50)} {_r2('cov * cov / (va * vb)', 'cov')}",
    "pair_r2_unphased_missing": f"WITH {DOSES}, {_moments(50)} {_r2('cov * cov / (va * vb)', 'cov')}",
    "pair_r2_wide": f"WITH {WIDE}, {_moments(50)} {_r2('cov * cov / (va * vb)', 'cov')}",
    "pair_r2_shrinkage": f"""WITH {HAPS}, {_moments(50)}, {GMAP}, t AS (SELECT CAST(1 AS DOUBLE) / 65 AS t),
      g AS (SELECT cov.*, t, pow(1 - t, 2) * exp((a.cm - b.cm) * 4 * 100 / (2 * 32)) * cov AS sc FROM cov JOIN gmap a ON a.pos = loc_a JOIN gmap b ON b.pos = loc_b, t)
      {_r2('sc * sc / ((pow(1 - t, 2) * va + t / 2 * (1 - t / 2)) * (pow(1 - t, 2) * vb + t / 2 * (1 - t / 2)))', 'g')}""",
    "gmap_missing_sites": f"WITH {LINE}, {GMAP} SELECT pos FROM line WHERE pos NOT IN (SELECT pos FROM gmap)",
    "genetic_map_lookup": f"WITH {LINE}, {GMAP} SELECT line.pos, round(cm, 6) + 0.0 AS cm FROM line JOIN gmap ON line.pos = gmap.pos",
    "right_neighbor": f"WITH {PART_LINE}, {NEAR.format(100)} SELECT pos, right_idx, right_pos FROM near",
    "left_neighbor": f"WITH {PART_LINE}, {NEAR.format(100)} SELECT pos, left_idx, left_pos FROM near",
    "chunk_intervals": f"WITH RECURSIVE {CHUNKS} SELECT start_bp, end_bp, buffer_end_bp FROM chunk",
    "chunk_edge_subset": f"""WITH RECURSIVE {CHUNKS}, {GRAPH} SELECT start_bp, buffer_end_bp, loc_a % 4 AS sub_bucket, count(*) AS n_edges, round(sum(r), 4) + 0.0 AS sum_r
      FROM graph JOIN chunk ON loc_a >= start_bp AND loc_b <= buffer_end_bp GROUP BY ALL""",
    "pair_weights_threshold": f"WITH {GRID} SELECT i, j, pos_i, pos_j, round(w, 9) + 0.0 AS w FROM grid",
    "window_scores_threshold": f"WITH {GRID}, {SCORES} SELECT pos_i, pos_j, round(score, 6) + 0.0 AS score FROM c",
    "window_scores_grid": f"WITH {GRID}, {SCORES} SELECT pos_i, pos_j, round(score, 6) + 0.0 AS score FROM c",
    "window_scores_modularity": f"""WITH {GRAPH}, {LINE}, k AS (SELECT pos, sum(r) / sqrt(2 * (SELECT sum(r) FROM graph)) AS k FROM (SELECT loc_a AS pos, r FROM graph UNION ALL SELECT loc_b, r FROM graph) GROUP BY pos),
      len AS (SELECT CAST(max(pos) - min(pos) AS DOUBLE) / 50 AS f FROM line),
      grid AS MATERIALIZED (SELECT p.idx AS i, q.idx AS j, p.pos AS pos_i, q.pos AS pos_j, coalesce(r, 0.0) - f * a.k * b.k AS w FROM line p JOIN line q ON q.pos >= p.pos AND q.pos <= p.pos + 50
        LEFT JOIN graph ON loc_a = p.pos AND loc_b = q.pos JOIN k a ON a.pos = p.pos JOIN k b ON b.pos = q.pos, len), {SCORES} SELECT pos_i, pos_j, round(score, 6) + 0.0 AS score FROM c""",
    "opt_scores": OPT,
    "chunked_opt_scores": OPT,
    "dp_resume": OPT,
    "dp_resume_scores": OPT,
    "opt_blocks": f"WITH RECURSIVE {BLOCKS} SELECT block_start, block_end FROM chain",
    "best_total": f"WITH RECURSIVE {DP} SELECT round(opt, 6) + 0.0 AS opt FROM opt WHERE idx = 0",
    "partition_summary": f"""WITH RECURSIVE {BLOCKS}, g AS (SELECT *, greatest(coalesce(block_start - lag(block_end) OVER (ORDER BY block_start) - 1, 0), 0) AS gap FROM chain)
      SELECT count(*) AS n_blocks, min(block_start) AS start_bp, max(block_end) AS end_bp, CAST(sum(gap) AS BIGINT) AS uncovered_bp, max(gap) AS max_gap, round(100.0::DOUBLE * sum(gap) / (max(block_end) - min(block_start)), 6) + 0.0 AS uncovered_percent FROM g""",
    "consensus_shrunk": f"WITH {SHORT} SELECT pop, start, stop FROM short",
    "consensus_intervals": f"WITH {MERGED} SELECT start, stop FROM cons",
    "consensus_coverage": f"WITH {MERGED} SELECT sum(stop - start) AS covered, round(100 * sum(stop - start) / (SELECT hi - lo FROM ends), 6) + 0.0 AS coverage_percent FROM cons",
    "consensus_violations": f"WITH {MERGED} SELECT pop, block_start, block_end, count(*) AS n FROM sets JOIN cons ON block_start < stop AND start < block_end + 1 GROUP BY ALL HAVING count(*) > 1",
    # the intervals as one list; block after block, all that overlap it but the longest (the first of equals) lose what they share with it
    "consensus_repaired": f"""WITH RECURSIVE {MERGED}, over AS (SELECT pop, block_start AS s, block_end + 1 AS e FROM sets JOIN cons ON block_start < stop AND start < block_end + 1 GROUP BY ALL HAVING count(*) > 1),
      bad AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pop, s) AS k, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM over),
      fold(k, p) AS (SELECT CAST(0 AS BIGINT), (SELECT list({{'a': start, 'z': stop}} ORDER BY start) FROM cons)
        UNION ALL SELECT k, flatten(list_transform(p, lambda x, i: CASE WHEN i = longest OR x.z <= s OR x.a >= e THEN [x] ELSE list_filter([{{'a': x.a, 'z': least(x.z, s)}}, {{'a': greatest(x.a, e), 'z': x.z}}], lambda y: y.a < y.z) END))
        FROM (SELECT bad.k, s, e, p, list_position(met, list_max(met)) AS longest FROM (SELECT bad.k, bad.s, bad.e, p, list_transform(p, lambda x: least(x.z, bad.e) - greatest(x.a, bad.s)) AS met FROM fold JOIN bad ON bad.k = fold.k + 1) bad)),
      final AS (SELECT unnest(p) AS x FROM (SELECT p FROM fold ORDER BY k DESC LIMIT 1)) SELECT x.a AS start, x.z AS stop FROM final""",
    "interval_overlaps": f"WITH {SETS} SELECT p.block_start AS s, p.block_end + 1 AS e, q.block_start AS u, q.block_end + 1 AS v FROM sets p JOIN sets q ON p.pop = 'P0' AND q.pop = 'P1' AND p.block_start < q.block_end + 1 AND q.block_start < p.block_end + 1",
    "interval_overlaps_levels": """WITH a AS (SELECT p_partkey * 50 AS s, p_partkey * 50 + CAST(pow(2, p_partkey % 13) AS BIGINT) AS e FROM part), b AS (SELECT s_suppkey * 997 AS u, s_suppkey * 997 + CAST(pow(2, s_suppkey % 17) AS BIGINT) AS v FROM supplier)
      SELECT s, e, u, v FROM a JOIN b ON s < v AND u < e""",
    "block_triangles": f"""WITH {SETS}, h AS (SELECT *, CAST(block_end - block_start AS DOUBLE) / 2 AS half FROM sets)
      SELECT pop, block_start, block_end, n, CASE n WHEN 0 THEN block_start WHEN 1 THEN block_start + half ELSE block_end END::DOUBLE AS x, CASE n WHEN 1 THEN half ELSE 0 END::DOUBLE AS y FROM h, (SELECT unnest([0, 1, 2])::INT AS n)""",
    "blocks_shown": f"WITH {SETS} SELECT * FROM sets WHERE block_start >= 1000 AND block_end <= 20000 AND block_start <> block_end",
    "nearest_variant": f"""WITH {PART_LINE}, p AS (SELECT DISTINCT s_suppkey * 17 % 6000 AS point FROM supplier), q AS (SELECT point, pos, idx, row_number() OVER (PARTITION BY point ORDER BY abs(point - pos), idx) AS k FROM p, line)
      SELECT point, pos, idx FROM q WHERE k = 1""",
    "next_variant": f"WITH {PART_LINE} SELECT * FROM (SELECT pos, lead(pos) OVER (ORDER BY pos) AS next_pos FROM line) WHERE next_pos IS NOT NULL",
    "ld_matrix_long": f"WITH {GRAPH} SELECT loc_a, loc_b, round(r, 9) + 0.0 AS r FROM graph WHERE loc_a BETWEEN 100 AND 200 AND loc_b BETWEEN 100 AND 200 AND r > CAST(0.0001 AS DOUBLE)",
    "ld_matrix_dense": f"""WITH {GRAPH}, m AS (SELECT loc_a, loc_b, round(r, 9) AS r FROM graph WHERE loc_a BETWEEN 100 AND 106 AND loc_b BETWEEN 100 AND 106 AND r > CAST(0.0001 AS DOUBLE))
      SELECT loc_a, {", ".join(f'max(r) FILTER (loc_b = {c}) AS "{c}"' for c in range(101, 107))} FROM m GROUP BY loc_a""",
    "ld_matrix_binned": f"WITH {ITEMS} SELECT loc_a // 100 AS bin_a, loc_b // 100 AS bin_b, round(avg(r), 6) + 0.0 AS r FROM items GROUP BY ALL",
    "ld_matrix_pyramid": f"""WITH {ITEMS}, lv AS (SELECT unnest(range(5))::INT AS level)
      SELECT level, loc_a // (25 << level) AS bin_a, loc_b // (25 << level) AS bin_b, count(*) AS n, round(sum(r), 6) + 0.0 AS total, round(max(r), 6) + 0.0 AS most FROM items, lv GROUP BY ALL""",
    # 2,000 positions are 40 squares of 50
    "ld_matrix_shown": f"""WITH {ITEMS}, b AS (SELECT loc_a // 50 AS bin_a, loc_b // 50 AS bin_b, r FROM items)
      SELECT bin_a, bin_b, bin_a * 50 AS start_a, bin_b * 50 AS start_b, round(avg(r), 6) + 0.0 AS r, round(max(r), 6) + 0.0 AS most FROM b WHERE bin_a BETWEEN 0 AND 39 AND bin_b BETWEEN 0 AND 39 GROUP BY ALL""",
    "edge_bucket_counts": f"WITH {ITEMS} SELECT loc_a, CAST(1 AS BIGINT) AS n_buckets, count(*) AS n_edges FROM items GROUP BY loc_a",
}
