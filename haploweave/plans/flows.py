"""The programs end to end: genotypes to edges, edges to chunks and a null model, edges to blocks, blocks to a consensus.

Tables with a column ``chrom`` are worked on chromosome by chromosome.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from haploweave import schemas
from haploweave.functions import statistics
from haploweave.operators import blocks, consensus, edges, pairs, penalty, sites
from haploweave.sources import sinks, text, vcf


def keys_of(table: DataFrame) -> list[str]:
    return ["chrom"] if "chrom" in table.columns else []


class Correlations(NamedTuple):
    graph: DataFrame
    #: Removed sites with reasons.
    removed: DataFrame
    #: The chi-square penalty.
    penalty: float
    #: After ``graph`` has been computed: n_pairs, n_bad (correlations that can't be right, which it leaves out) and one such pair.
    seen: Observation


def correlate(
    spark: SparkSession, paths: str, longest: int, ids: str | None = None, genetic_map: str | None = None, effective_size: float | None = None, maf: float = 0.0, least: float = 0.0, phased: bool = False
) -> Correlations:
    """Edges within the chromosomes of a genotype table.

    With a map and an effective size correlations are shrunk and ``maf`` isn't
    used; a site that the map lacks is then an error, and so is a second
    chromosome, as a map names none. Otherwise sites are filtered by ``maf``.
    """
    by = ["chrom"]
    lines = text.read_lines(spark, paths)
    wanted = text.parse_ids(text.read_lines(spark, ids)) if ids else None
    individuals = vcf.samples_in(lines, wanted).count()
    width = individuals * (2 if phased else 1)
    shrink = genetic_map is not None and effective_size is not None
    rows = sites.with_reason(sites.count_scores(sites.decode(vcf.scan(lines, wanted), phased)), None if shrink else maf, phased=phased, by=by)
    removed = rows.where("reason IS NOT NULL").select(*by, "pos", "reason").distinct()
    packed = sites.pack(sites.variance(rows.where("reason IS NULL")), width)
    if shrink:
        at = text.parse_genetic_map(text.read_placed(spark, genetic_map))
        if rows.select(*by).distinct().limit(2).count() > 1:
            raise ValueError("a genetic map is of one chromosome, the genotypes are of several")
        lost = pairs.without_map(rows, at).limit(3).collect()
        if lost:
            raise ValueError(f"sites are missing from the map: {[r['pos'] for r in lost]}")
        found = pairs.correlate_shrunk(pairs.with_map(packed, at), longest, individuals, effective_size, least, unphased=not phased, by=by)
    else:
        found = pairs.correlate(packed, longest, least, unphased=not phased, by=by)
    seen = Observation()
    example = F.max(F.when(F.col("bad"), F.concat_ws(" ", *by, "loc_a", "loc_b", "r2")))
    found = found.observe(seen, F.count("*").alias("n_pairs"), F.count_if("bad").alias("n_bad"), example.alias("bad_pair"))
    graph = found.where("NOT bad").select(*by, "loc_a", "loc_b", F.col("r2").alias("r"))
    return Correlations(graph, removed, statistics.chi_penalty(width), seen)


def null_model(graph: DataFrame, model: str, distance: int = 2_000_000) -> DataFrame | None:
    """What a model needs of the graph: normalised degrees, the background penalty, or nothing."""
    penalty.check_model(model)
    if model == "modularity":
        return edges.normalized_degree(edges.assert_unit(graph), by=keys_of(graph))
    return edges.background(graph, distance, keys_of(graph)) if model == "background" else None


def split(graph: DataFrame, longest: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(sites in order, chunks)."""
    by = keys_of(graph)
    line = blocks.chromosome(edges.positions([graph], by), by)
    return line, blocks.chunks(line, longest, most, by)


def score(
    graph: DataFrame, model: str, longest: int, value: float | None = None, most: int | None = None, distance: int = 2_000_000,
    sites: DataFrame | None = None, degree: DataFrame | None = None, start: int = 0, end: int | None = None, buffer: int | None = None, earlier: DataFrame | None = None, unique: bool = False,
) -> DataFrame:
    """The optimum of every site (see blocks.partition).

    ``value``: the penalty of the chi and constant models; ``most``: sites of a chunk,
    where sums are to be bounded by chunks. ``sites`` and ``degree``: what split has
    stored of the whole line, else made of the graph. ``start``, ``end``, ``buffer``: of
    one chunk, whose blocks begin from ``start`` to ``end`` and end up to ``buffer``;
    ``earlier(pos, opt, brk)``: the results of the sites to its right. ``unique``: it
    has been checked that no pair occurs twice.
    """
    by = keys_of(graph)
    line = blocks.chromosome(edges.positions([graph], by) if sites is None else sites, by)
    whole = line
    found = degree if degree is not None and model == "modularity" else null_model(graph, model, distance)
    if model == "modularity":
        # the coefficient, of each chromosome, is dealt to both sides
        lengths = blocks.extent(line, by).select(*by, F.sqrt(F.col("length_bp") / longest).alias("root"))
        line = line.join(found.select(*by, "pos", "k_norm"), [*by, "pos"])
        line = line.join(lengths, by) if by else line.crossJoin(F.broadcast(lengths))  # one row
        line, cost = line.withColumn("k_norm", F.col("k_norm") * F.col("root")).drop("root"), penalty.Modularity(1.0)
    elif model == "background":
        number = found.select(*by, "penalty")
        line, cost = line.join(number, by) if by else line.crossJoin(F.broadcast(number)), penalty.OfChromosome()  # one row
    elif value is None:
        raise ValueError(f"model {model} needs a penalty")
    else:
        cost = penalty.Constant(value)
    if not unique and edges.duplicates(graph, by).limit(1).count():
        raise ValueError("a pair occurs twice")
    last = schemas.MAX_POSITION if buffer is None and end is None else (buffer if buffer is not None else end)
    if start or last != schemas.MAX_POSITION:
        graph, line = edges.subset(graph, start, last), line.where(F.col("pos").between(start, last))
    known = None
    if earlier is not None:
        known = earlier.select(*by, "pos", "opt", "brk").join(whole.select(*by, "pos", "idx"), [*by, "pos"])
    if most is not None:  # chunk by chunk, where an earlier run's sums are to be met
        cut = blocks.chunks(line.select(*by, "pos", "idx"), longest, most, by)
        scores = blocks.chunk_scores(line, graph, cost, longest, cut, longest, by)
        scores = scores if end is None else scores.where(F.col("pos_i") <= end)
        if known is not None:
            scores = blocks.resume(scores.join(known.select(*by, F.col("pos").alias("pos_i")), [*by, "pos_i"], "left_anti"), known, by)
        return blocks.optimum(scores, by)
    return blocks.partition(line, graph, cost, longest, by, last=end, earlier=known)


def agree(spark: SparkSession, populations: dict[str, str], buffer: float, width: int = 100_000, repair: bool = True) -> DataFrame:
    """Consensus intervals (start, stop) of the block files of several populations."""
    sets = None
    for name, paths in populations.items():
        own = text.read_blocks(spark, paths).select(F.lit(name).alias("pop"), "block_start", "block_end")
        sets = own if sets is None else sets.unionByName(own)
    return consensus.repaired(sets, buffer, width) if repair else consensus.merged(sets, buffer)


def write_correlations(graph: DataFrame, value: float, out: str, buckets: int = 96, compat: bool = False) -> None:
    """Edges and penalty in folders of their own, so that neither is read for the other."""
    sinks.write_by_left_end(graph, f"{out}/edges.parquet", buckets, keys_of(graph))
    if compat:
        sinks.write_edges(graph.sparkSession.read.parquet(f"{out}/edges.parquet"), f"{out}/edges.txt", True, keys_of(graph))
    sinks.write_value(graph.sparkSession.range(1).select(F.lit(value).alias("v")), f"{out}/penalty.txt", "v", compat)


def read_graph(spark: SparkSession, paths: str) -> DataFrame:
    """Canonical edges of Parquet folders (their path ends so), with their chromosomes, or of text, which is of one."""
    found = text.paths_of(paths)
    if all(p.rstrip("/").endswith(".parquet") for p in found):
        rows = spark.read.parquet(*found)
        return edges.canonical(rows.select(*keys_of(rows), *(F.col(f.name).cast(f.dataType) for f in schemas.EDGES)))
    return edges.canonical(text.read_edges(spark, found))
