"""python -m haploweave correlate | combine | split | score | run | consensus: the programs on the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from haploweave import schemas
from haploweave.operators import blocks, edges, penalty
from haploweave.plans import flows, run
from haploweave.sources import sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haploweave", description=__doc__)
    todo = p.add_subparsers(dest="todo", required=True)

    def add(name: str, about: str) -> argparse.ArgumentParser:
        q = todo.add_parser(name, help=about)
        q.add_argument("-i", "--input", required=True, help="a file or folder, or several separated by commas")
        q.add_argument("-o", "--output", required=True)
        q.add_argument("--compat", action="store_true", help="text outputs in their rounded layouts too")
        return q

    q = add("correlate", "genotypes to edges")
    q.add_argument("-g", "--group", help="file of the individuals' names")
    q.add_argument("-l", "--length", type=int, required=True, help="longest distance of a pair")
    q.add_argument("-m", "--map", help="genetic map")
    q.add_argument("-s", "--size", type=float, help="effective population size")
    q.add_argument("-f", "--maf", type=float, default=0.0)
    q.add_argument("-r2", "--r2", type=float, default=0.0, help="least correlation")
    q.add_argument("-p", "--phased", action="store_true")
    add("combine", "several edge lists to one")
    q = add("split", "edges to sites, chunks and a null model")
    q.add_argument("-m", "--model", required=True, choices=penalty.MODELS)
    q.add_argument("-l", "--length", type=int, required=True)
    q.add_argument("-v", "--variants", "--variant", type=int, required=True, help="most sites of a chunk")
    q = add("score", "edges to blocks")
    q.add_argument("-m", "--model", required=True, choices=penalty.MODELS)
    q.add_argument("-l", "--length", type=int, required=True)
    q.add_argument("-v", "--variants", type=int, help="most sites of a chunk; none: no chunks")
    q.add_argument("--penalty", help="file of the penalty, for chi and constant")
    q.add_argument("-s", "--start", type=int, default=0, help="first position of a chunk")
    q.add_argument("-e", "--end", type=int, help="last position at which the chunk's blocks begin; none: all")
    q.add_argument("-b", "--buffer", type=int, help="last position at which they end")
    q.add_argument("-f", "--final", action="store_true", help="the last chunk to be scored: write the blocks")
    q.add_argument("--resume", help="output folder of the chunk to the right")
    q.add_argument("--sites", help="file of all sites, as split writes it")
    q.add_argument("--degree", help="file of normalised degrees, as split writes it")
    q = add("run", "edges to blocks, chunk after chunk; goes on where it was stopped")
    q.add_argument("-m", "--model", required=True, choices=penalty.MODELS)
    q.add_argument("-l", "--length", type=int, required=True)
    q.add_argument("-v", "--variants", type=int, default=100_000, help="most sites of a chunk")
    q.add_argument("--penalty", help="file of the penalty, for chi and constant")
    q = add("consensus", "blocks of several populations to common intervals")
    q.add_argument("-b", "--buffer", type=float, required=True)
    q.add_argument("-w", "--width", type=int, default=100_000, help="about the length of a block")
    q.add_argument("--no-repair", action="store_true", help="leave blocks that overlap several intervals")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("haploweave").getOrCreate()
    if a.todo == "correlate":
        made = flows.correlate(spark, a.input, a.length, a.group, a.map, a.size, a.maf, a.r2, a.phased)
        flows.write_correlations(made.graph, made.penalty, a.output, compat=a.compat)
        made.removed.write.parquet(f"{a.output}/removed.parquet")
        seen = made.seen.get
        if seen["n_bad"]:
            print(f"left out {seen['n_bad']} of {seen['n_pairs']} correlations that can't be right, such as {seen['bad_pair']}", file=sys.stderr)
        return 0
    if a.todo == "combine":
        graphs = [flows.read_graph(spark, p) for p in text.paths_of(a.input)]
        by = ["chrom"] if all("chrom" in g.columns for g in graphs) else []
        sinks.write_by_left_end(edges.combine(graphs, by), f"{a.output}/edges.parquet", 96, by)
        return 0
    if a.todo == "consensus":
        names = [p.partition("=") for p in text.paths_of(a.input)]
        sets = {name if path else str(k): path or name for k, (name, _, path) in enumerate(names)}
        sinks.write_intervals(flows.agree(spark, sets, a.buffer, a.width, not a.no_repair), f"{a.output}/consensus.txt")
        return 0
    if a.todo == "run":
        run.whole(spark, a.input, a.output, a.model, a.length, a.variants, text.read_value(spark, a.penalty) if a.penalty else None)
        return 0
    graph = flows.read_graph(spark, a.input)
    by = flows.keys_of(graph)
    if a.todo == "split":
        line, chunks = flows.split(graph, a.length, a.variants)
        sinks.write_positions(line, f"{a.output}/sites.txt", by)
        sinks.write_chunks(chunks, f"{a.output}/chunks.txt", by)
        if a.model == "modularity":
            sinks.write_degree(flows.null_model(graph, a.model), f"{a.output}/degree.txt", a.compat, by)
            sinks.write_value(edges.total_weight(graph, by), f"{a.output}/total_weight.txt", "m", a.compat, by)
        elif a.model == "background":
            sinks.write_value(flows.null_model(graph, a.model), f"{a.output}/penalty.txt", "penalty", a.compat, by)
        return 0
    last = a.buffer if a.buffer is not None else a.end
    dp = flows.score(
        graph, a.model, a.length, text.read_value(spark, a.penalty) if a.penalty else None, a.variants,
        sites=text.read_positions(spark, a.sites, by) if a.sites else None, degree=text.read_degree(spark, a.degree, a.start, schemas.MAX_POSITION if last is None else last, by) if a.degree else None,
        start=a.start, end=a.end, buffer=a.buffer, earlier=text.read_optimum(spark, f"{a.resume}/opt_scores.txt", f"{a.resume}/opt_breaks.txt", by) if a.resume else None,
    )
    sinks.write_optimum(dp, f"{a.output}/opt_scores.txt", f"{a.output}/opt_breaks.txt", a.compat, by)
    if a.final or last is None:
        sinks.write_value(blocks.best_total(dp, by), f"{a.output}/score.txt", "opt", a.compat, by)
        sinks.write_blocks(blocks.blocks(dp, by), f"{a.output}/blocks.txt", by)
        blocks.summary(blocks.blocks(dp, by), by).show(truncate=False)
    dp.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
