"""A whole scoring run, chunk after chunk from the right, that goes on where an earlier one was stopped.

A stage writes a folder of its own; when it is done, a note with what it was made
from is put beside it. A rerun skips stages that have a note, and makes the one
that was cut off again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from haploweave.operators import blocks, edges, penalty
from haploweave.plans import flows
from haploweave.sources import sinks, text


class Stages:
    """The finished stages of the folder ``out``. Other settings than those of the notes there are an error."""

    def __init__(self, spark: SparkSession, out: str, settings: dict):
        self.spark, self.out, self.settings = spark, out.rstrip("/"), json.dumps(settings, sort_keys=True)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _note(self, name: str) -> str | None:
        p, files = self._path(f"{self.out}/_done/{name}.json")
        if not files.exists(p):
            return None
        return "".join(r["value"] for r in self.spark.read.text(p.toString()).collect())  # one line, our own

    def done(self, name: str, work: Callable[[str], None]) -> str:
        """The stage's folder, after ``work(folder)`` unless that has been done."""
        folder, note = f"{self.out}/{name}", self._note(name)
        if note is not None:
            if note != self.settings:
                raise ValueError(f"{folder} was made with {note}, not with {self.settings}")
            return folder
        left, files = self._path(folder)
        files.delete(left, True)  # what a stage that was cut off has left
        work(folder)
        draft, files = self._path(f"{self.out}/_done/{name}.draft")
        stream = files.create(draft, True)
        stream.write(bytearray(self.settings.encode()))
        stream.close()
        files.rename(draft, self._path(f"{self.out}/_done/{name}.json")[0])
        return folder


def size_of(spark: SparkSession, paths: str) -> list[int]:
    """Bytes and files of the paths, by which a changed input is noticed."""
    total = [0, 0]
    for path in text.paths_of(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
        total = [total[0] + found.getLength(), total[1] + found.getFileCount()]
    return total


def _split(graph: DataFrame, model: str, longest: int, most: int, distance: int, folder: str) -> None:
    if edges.duplicates(graph).limit(1).count():
        raise ValueError("a pair occurs twice")
    line, chunks = flows.split(graph, longest, most)
    sinks.write_positions(line, f"{folder}/sites.txt")
    sinks.write_chunks(chunks, f"{folder}/chunks.txt")
    found = flows.null_model(graph, model, distance)
    if model == "modularity":
        sinks.write_degree(found, f"{folder}/degree.txt")
    elif found is not None:
        sinks.write_value(found, f"{folder}/penalty.txt", "penalty")


def _near(chunks: Sequence[Row], k: int) -> list[int]:
    """The chunks right of chunk k whose totals its blocks may need: those its buffer reaches, and the one after."""
    reached = [j for j in range(k) if chunks[j]["start_bp"] <= chunks[k]["buffer_end_bp"]]
    return [j for j in range(max(0, min(reached, default=k) - 1), k)]


def _line(graph: DataFrame, stages: Stages, model: str, longest: int, most: int, value: float | None, distance: int) -> None:
    """One line of sites: split, score every chunk, find the blocks."""
    spark = graph.sparkSession
    split = stages.done("split", lambda folder: _split(graph, model, longest, most, distance, folder))
    chunks = text.read_chunks(spark, f"{split}/chunks.txt").orderBy(F.desc("start_bp")).collect()  # a row for each chunk
    sites = text.read_positions(spark, f"{split}/sites.txt")
    if model == "background":
        model, value = "constant", text.read_value(spark, f"{split}/penalty.txt")
    names = [f"chunks/{c['start_bp']:010d}" for c in chunks]

    def optimum(of: Sequence[int]) -> DataFrame:
        return text.read_optimum(spark, *([f"{stages.out}/{names[j]}/{what}.txt" for j in of] for what in ("opt_scores", "opt_breaks")))

    for k, c in enumerate(chunks):

        def work(folder: str, k: int = k, c: Row = c) -> None:
            degree = text.read_degree(spark, f"{split}/degree.txt", c["start_bp"], c["buffer_end_bp"]) if model == "modularity" else None
            near = _near(chunks, k)
            dp = flows.score(
                graph, model, longest, value, sites=sites, degree=degree, start=c["start_bp"], end=c["end_bp"], buffer=c["buffer_end_bp"],
                earlier=optimum(near) if near else None, unique=True,
            )
            sinks.write_optimum(dp.where(F.col("pos").between(c["start_bp"], c["end_bp"])), f"{folder}/opt_scores.txt", f"{folder}/opt_breaks.txt")

        stages.done(names[k], work)

    def finish(folder: str) -> None:
        line = blocks.chromosome(sites)
        ends = line.select(F.col("pos").alias("brk"), F.col("idx").alias("brk_idx"))
        dp = blocks.marked(optimum(range(len(chunks))).join(line, "pos").join(ends, "brk"))
        found = blocks.blocks(dp)
        sinks.write_blocks(found, f"{folder}/blocks.txt")
        sinks.write_value(blocks.best_total(dp), f"{folder}/score.txt", "opt")
        blocks.summary(text.read_blocks(spark, f"{folder}/blocks.txt")).write.parquet(f"{folder}/summary.parquet")

    if chunks:
        stages.done("result", finish)


def whole(spark: SparkSession, paths: str, out: str, model: str, longest: int, most: int, value: float | None = None, distance: int = 2_000_000) -> None:
    """Sites, chunks, totals, blocks, score and summary of a stored graph in folders of ``out``, one for each chromosome where the graph names them.

    Each chunk writes the totals of its own sites only and reads those of the few
    chunks that its blocks may reach, so the work grows with the sites. An empty graph gives an empty
    list of chunks and no result.
    """
    penalty.check_model(model)
    graph = flows.read_graph(spark, paths)
    settings = {"paths": text.paths_of(paths), "size": size_of(spark, paths), "model": model, "longest": longest, "most": most, "value": value, "distance": distance}
    if not flows.keys_of(graph):
        _line(graph, Stages(spark, out, settings), model, longest, most, value, distance)
        return
    for row in graph.select("chrom").distinct().orderBy("chrom").collect():  # a few chromosomes
        own = graph.where(F.col("chrom").eqNullSafe(row["chrom"])).drop("chrom")
        _line(own, Stages(spark, f"{out}/chrom={row['chrom']}", settings), model, longest, most, value, distance)
