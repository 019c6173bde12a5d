"""Scores of windows of sites, and the partition into blocks with the largest total."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from haploweave.operators import tiles
from haploweave.operators.chains import STRETCH, visited
from haploweave.operators.penalty import Penalty
from haploweave.operators.ranges import neighbours, range_join, ranked, running_max, within
from haploweave.sources.shared import written


def chromosome(positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct positions with ``idx``, their rank from 0."""
    extra = [c for c in positions.columns if c not in (*by, "pos")]
    once = positions.groupBy(*by, "pos").agg(*(F.first(c, True).alias(c) for c in extra)) if extra else positions.select(*by, "pos").distinct()
    return ranked(once, "pos", by)


def extent(chrom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return chrom.groupBy(*by).agg(F.min("pos").alias("start_bp"), F.max("pos").alias("end_bp"), (F.max("pos") - F.min("pos")).alias("length_bp"), F.count("*").alias("n_sites"))


def weights(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, by: Sequence[str] = ()) -> DataFrame:
    """(i, j, pos_i, pos_j, w) of all pairs of sites i <= j within ``longest``: the edge's weight, or 0, less the penalty."""
    extra = [c for c in chrom.columns if c in ("k_norm", "penalty")]
    left = chrom.select(*by, F.col("pos").alias("pos_i"), F.col("idx").alias("i"), *(F.col(c).alias(f"i_{c}") for c in extra))
    right = chrom.select(*by, F.col("pos").alias("pos_j"), F.col("idx").alias("j"), *(F.col(c).alias(f"j_{c}") for c in extra))
    grid = range_join(left, right, "pos_i", "pos_j", longest, by)
    known = edges.select(*by, F.col("loc_a").alias("pos_i"), F.col("loc_b").alias("pos_j"), "r")
    grid = grid.join(known, [*by, "pos_i", "pos_j"], "left")
    return grid.select(*by, "i", "j", "pos_i", "pos_j", (F.coalesce("r", F.lit(0.0)) - penalty.column("i_", "j_")).alias("w"))


def window_scores(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(i, j, pos_i, pos_j, score): for each pair the weights of all pairs between them, by two running sums."""
    column = Window.partitionBy(*by, "j").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    row = Window.partitionBy(*by, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("down", F.sum("w").over(column)).withColumn("score", F.sum("down").over(row)).drop("down", "w")


def chunks(chrom: DataFrame, longest: int, most: int, by: Sequence[str] = ()) -> DataFrame:
    """(start_bp, end_bp, buffer_end_bp): from left to right, chunks of at most ``most`` sites with a buffer of ``longest``.

    Each site's chunk, should one begin there, comes from joins; which of them
    begin is a walk (see chains.visited). A chunk that would end before it starts
    (too few sites for the longest block) is an error.
    """
    near = neighbours(chrom, longest, by)
    ends = chrom.groupBy(*by).agg(F.max("idx").alias("_last"))
    near = near.join(ends, list(by)) if by else near.crossJoin(F.broadcast(ends))  # one row
    near = near.withColumn("_reach", F.least(F.col("idx") + most - 1, F.col("_last")))
    at = near.select(*by, F.col("idx").alias("_reach"), F.col("left_idx").alias("_back"))
    ends = near.join(at, [*by, "_reach"]).withColumn("_end", F.when(F.col("_reach") == F.col("_last"), F.col("_last")).otherwise(F.col("_back")))
    # an end before the start is an error, if the walk comes there
    steps = ends.select(*by, "idx", (F.greatest("idx", "_end") + 1).alias("next"))
    begin = visited(steps, by).join(ends.select(*by, "idx", "pos", "_end"), [*by, "idx"])
    wrong = F.raise_error(F.concat(F.lit("too few sites in a chunk for the longest block, at "), F.col("pos").cast("string"))).cast("long")
    begin = begin.withColumn("start_bp", F.when(F.col("_end") >= F.col("idx"), F.col("pos")).otherwise(wrong)).drop("idx", "pos")
    there = near.select(*by, F.col("idx").alias("_end"), F.col("pos").alias("end_bp"), F.col("right_pos").alias("buffer_end_bp"))
    return begin.join(there, [*by, "_end"]).select(*by, "start_bp", "end_bp", "buffer_end_bp")


def chunk_scores(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, chunk_table: DataFrame, width: int = 1_000_000, by: Sequence[str] = ()) -> DataFrame:
    """tiles.window_scores made chunk by chunk: each from the sites and edges up to its buffer's end, kept for starts up to its own end. ``width``: about the length of a chunk."""
    spans = chunk_table.select(*by, "start_bp", "end_bp", "buffer_end_bp")
    return tiles.chunk_scores(chrom, edges, penalty, longest, lambda rows, low, high: within(rows, low, high, spans, "start_bp", "buffer_end_bp", width, by), by)


def partition(
    chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, by: Sequence[str] = (), width: int | None = None, ahead: int | None = None, last: int | None = None, earlier: DataFrame | None = None, stretch: int = STRETCH
) -> DataFrame:
    """(idx, pos, opt, brk, starts): as optimum, straight from sites and edges (see tiles.optimum), without a row for each pair.

    ``last``: blocks begin up to there. ``earlier(idx, pos, opt, brk)``: an earlier
    optimum of the sites to the right of the others, which stands as it is; sites
    after ``last`` without one add nothing.
    """
    given = None
    if earlier is not None:
        given = earlier.select(*by, "idx", "opt")
    if last is not None:
        past = chrom.where(F.col("pos") > last).select(*by, "idx", F.lit(0.0).alias("opt"))
        given = past if given is None else given.unionByName(past).groupBy(*by, "idx").agg(F.max_by("opt", F.abs("opt")).alias("opt"))
    found = tiles.optimum(chrom, edges, penalty, longest, by, width, ahead, given).select(*by, "idx", "pos", "opt", "brk", "brk_idx")
    if earlier is not None:
        ends = earlier.select(*by, F.col("pos").alias("brk"), F.col("idx").alias("brk_idx"))
        found = found.unionByName(earlier.select(*by, "idx", "pos", "opt", "brk").join(ends, [*by, "brk"]).select(found.columns))
    return marked(found, by, stretch)


def marked(found: DataFrame, by: Sequence[str] = (), stretch: int = STRETCH) -> DataFrame:
    """(idx, pos, opt, brk, starts) of all totals (idx, pos, opt, brk, brk_idx) of a line: whether a block of the best partition starts at a site."""
    found = written(found.select(*by, "idx", "pos", "opt", "brk", "brk_idx"), "partition")
    starts = visited(found.select(*by, "idx", (F.col("brk_idx") + 1).alias("next")), by, stretch).withColumn("starts", F.lit(True))
    return found.join(starts, [*by, "idx"], "left").select(*by, "idx", "pos", "opt", "brk", F.coalesce("starts", F.lit(False)).alias("starts"))


def resume(scores: DataFrame, earlier: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``scores`` with the results (pos, idx, opt, brk) of an ``earlier`` optimum of the sites to their right, which then stand as they are."""
    ends = earlier.select(*by, F.col("pos").alias("brk"), F.col("idx").alias("end_idx"))
    rows = earlier.select(*by, "pos", "idx", "opt", "brk").join(ends, [*by, "brk"]).withColumnsRenamed({"idx": "i", "pos": "pos_i", "opt": "score"})
    # a negative j marks them: the end's index, beyond -1
    rows = rows.withColumn("j", -F.col("end_idx") - 2).withColumn("pos_j", F.col("brk")).drop("brk", "end_idx")
    return scores.unionByName(rows.select(scores.columns))


class _Part:
    """What the partition of one stretch of sites needs while its windows pass from the last start to the first."""

    def __init__(self, key: tuple, first: int, last: int):
        self.key, self.first = key, first
        #: By site, and one past the last: the best total from there on. A site without windows adds nothing.
        self.opt = np.zeros(last - first + 2)
        self.brk, self.pos = np.full(last - first + 2, -1, np.int64), np.full(last - first + 2, -1, np.int64)
        self.reach = np.full(last - first + 2, -1, np.int64)

    def settle(self, i: int, j: np.ndarray, pos_i: np.ndarray, score: np.ndarray) -> None:
        at = i - self.first
        if j[0] < 0:  # a result of an earlier run
            self.opt[at], self.brk[at], self.reach[at] = score[0], -j[0] - 2, -j[0] - 2
        else:
            after = j + 1 - self.first
            total = score + np.where(after < len(self.opt), self.opt[np.minimum(after, len(self.opt) - 1)], 0.0)
            best = int(np.argmax(total))  # the first of equals
            self.opt[at], self.brk[at], self.reach[at] = total[best], j[best], j.max()
        self.pos[at] = pos_i[0]

    def result(self, by: Sequence[str]) -> pd.DataFrame:
        known = np.flatnonzero(self.brk >= 0)
        out = pd.DataFrame({"idx": known + self.first, "pos": self.pos[known], "opt": self.opt[known], "brk": self.brk[known], "reach": self.reach[known]})
        for name, value in zip((*by, "part"), self.key, strict=True):
            out[name] = value
        return out[[*by, "part", "idx", "pos", "opt", "brk", "reach"]]


def _optimizer(by: Sequence[str], sites: int):
    """Reads windows by part, from the last start to the first, and holds four numbers for each site."""

    def solve(frames):
        now, held = None, None

        def settle(frame: pd.DataFrame, bounds: list[int]):
            """Takes the groups between bounds; yields parts that they end."""
            nonlocal now
            i, j, p, s = (frame[c].to_numpy() for c in ("i", "j", "pos_i", "score"))
            keys = [frame[c].to_numpy() for c in (*by, "part")]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = tuple(k[a] for k in keys)
                if now is None or key != now.key:
                    if now is not None:
                        yield now.result(by)
                    now = _Part(key, int(key[-1]) * sites, int(i[a]))
                now.settle(int(i[a]), j[a:b], p[a:b], s[a:b])

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            change = np.zeros(len(frame) - 1, bool)
            for c in ("i", "part", *by):
                column = frame[c].to_numpy()
                change |= column[1:] != column[:-1]
            bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
            yield from settle(frame, bounds)
            held = frame.iloc[bounds[-1] :]  # may go on
        if held is not None and len(held):
            yield from settle(held, [0, len(held)])
            yield now.result(by)

    return solve


def _joiner(by: Sequence[str], sites: int):
    """The parts of one chromosome, the last first, as one result; a part whose totals don't differ from the next one's by a constant gives a row with idx -1 and the last site as pos."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "idx"], ignore_index=True)
        last = int(frame["idx"].max())
        opt, brk, pos = np.zeros(last + 2), np.full(last + 2, -1, np.int64), np.full(last + 2, -1, np.int64)
        columns = [frame[c].to_numpy() for c in ("part", "idx", "pos", "opt", "brk", "reach")]
        parts = columns[0]
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(frame)]))
        good = True
        for a, b in reversed(list(zip(bounds[:-1], bounds[1:], strict=True))):
            part, (_, i, p, o, k, reach) = int(parts[a]), (c[a:b] for c in columns)
            own = i < (part + 1) * sites
            offset = 0.0
            if i[-1] < last and own.any():  # else its totals are those from the line's end
                beyond = (i >= (part + 1) * sites) & (i <= reach[own].max() + 1)
                differ = opt[i[beyond]] - o[beyond]
                # every site that a block of this part may lead to has to be known, and to differ alike
                if reach[own].max() + 1 > i[-1] or (beyond.any() and np.ptp(differ) > 1e-9 * max(1.0, np.abs(opt[i[beyond]]).max())):
                    good = False
                    break
                offset = float(differ[0]) if beyond.any() else 0.0
            at = i[own]
            opt[at], brk[at], pos[at] = o[own] + offset, k[own], p[own]
        if not good:
            out = pd.DataFrame({"idx": [-1], "pos": [last], "opt": [0.0], "brk": [-1], "starts": [False]})
        else:
            known = np.flatnonzero(brk >= 0)
            starts, at = np.zeros(len(opt), bool), int(known[0])
            while at < len(starts) and brk[at] >= 0:
                starts[at] = True
                at = int(brk[at]) + 1
            out = pd.DataFrame({"idx": known, "pos": pos[known], "opt": opt[known], "brk": pos[brk[known]], "starts": starts[known]})
        for name in by:
            out[name] = frame[name].iloc[0]
        return out[[*by, "idx", "pos", "opt", "brk", "starts"]]

    return join


#: Sites of a part of the partition, and how many after it are worked on too, at first.
PART_SITES, AHEAD = 1 << 13, 1 << 11


def optimum(scores: DataFrame, by: Sequence[str] = (), sites: int = PART_SITES, ahead: int = AHEAD) -> DataFrame:
    """(idx, pos, opt, brk, starts): for each site the best total from it on, where its first block ends, and whether a block of the best partition starts there.

    Each site's choice needs the totals of the sites after it, but only up to a
    constant. So parts of ``sites`` sites are solved apart, each with ``ahead`` sites
    more, as if nothing came after these. Where the totals of all sites that a
    part's blocks may lead to differ from the next part's by one constant, the
    part's choices are right and its totals follow. That is so where optimal blocks
    from different ends have fallen into step; if anywhere they have not, a second
    round takes each line as one part. ``partition`` needs no table of scores, and
    solves only what is out of step again. A part's windows stream through one
    task and are not held; a chromosome's totals, five numbers a site, are joined in
    one. Of equal totals the nearest end counts, unless rounding tells them apart.
    """
    fields = [scores.schema[c] for c in by]
    solved = T.StructType([*fields, T.StructField("part", T.LongType()), *(T.StructField(n, T.DoubleType() if n == "opt" else T.LongType()) for n in ("idx", "pos", "opt", "brk", "reach"))])
    final = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("idx", T.LongType()), ("pos", T.LongType()), ("opt", T.DoubleType()), ("brk", T.LongType()), ("starts", T.BooleanType())))])
    while True:
        low = F.greatest(F.floor((F.col("i") - ahead) / sites), F.lit(0))
        rows = scores.select(*by, "i", "j", "pos_i", "score", F.explode(F.sequence(low, F.floor(F.col("i") / sites))).alias("part"))
        rows = rows.repartition(*by, "part").sortWithinPartitions(*by, "part", F.desc("i"), "j")
        parts = rows.mapInPandas(_optimizer(by, sites), solved)
        keyed = parts if by else parts.withColumn("_all", F.lit(0))
        found = keyed.groupBy(*(by or ["_all"])).applyInPandas(_joiner(by, sites), final).persist()
        last = found.where("idx < 0").agg(F.max("pos")).first()[0]
        if last is None or sites > last:
            return found
        found.unpersist()
        # in one part a line can't be out of step: its windows stream through one task
        sites, ahead = last + 1, 0


def blocks(dp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return dp.where("starts").select(*by, F.col("pos").alias("block_start"), F.col("brk").alias("block_end"))


def best_total(dp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(opt): the best partition's total, that of the first site."""
    return dp.groupBy(*by).agg(F.min_by("opt", "pos").alias("opt"))


def summary(block_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(n_blocks, start_bp, end_bp, uncovered_bp, uncovered_percent, max_gap) of a partition, whose blocks don't overlap."""
    rows = running_max(block_table, "block_start", F.col("block_end"), "before", ["block_start"], by)
    gap = F.greatest(F.coalesce(F.col("block_start") - F.col("before") - 1, F.lit(0)), F.lit(0))
    rows = rows.withColumn("gap", gap).groupBy(*by)
    out = rows.agg(F.count("*").alias("n_blocks"), F.min("block_start").alias("start_bp"), F.max("block_end").alias("end_bp"), F.sum("gap").alias("uncovered_bp"), F.max("gap").alias("max_gap"))
    return out.withColumn("uncovered_percent", 100.0 * F.col("uncovered_bp") / F.greatest(F.col("end_bp") - F.col("start_bp"), F.lit(1)))
