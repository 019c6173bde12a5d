"""Scores of windows, and the best partition, without a row for each pair of sites.

Edges and sites are dealt to tiles of a line, each to its own tile and to those before
it whose windows it may lie in: at most two, as a tile is no narrower than the longest
window. A tile's starts pass by from the last to the first, and one row of its
summed-area table is kept: the score of the window from the start at hand to each site
in reach. A start adds its edges' running sum to that row, and takes away its pairs'
penalties, which have a closed form. So edges are shuffled once, or twice near a
tile's edge, and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from haploweave.operators.penalty import Penalty
from haploweave.sources.shared import written

#: Rows of a batch of scores, about.
ROWS = 1 << 16
#: Kinds of a tile's rows, in the order they come in.
FOUND, SITE, EDGE = 0, 1, 2
#: Totals of two tiles that differ by a constant, but for rounding.
CLOSE = 1e-9


class Tile:
    """Sites of a tile and those its windows reach, and the row of the summed-area table for the start at hand.

    Edges are fed from the last left end to the first. Edges between other positions,
    and longer ones than the longest window, don't count.
    """

    def __init__(self, pos: np.ndarray, idx: np.ndarray, values: dict[str, np.ndarray], penalty: Penalty, longest: int):
        self.pos, self.idx = pos, idx
        #: For each site, one past the last in reach.
        self.reach = np.searchsorted(pos, pos + longest, "right")
        self.taken = penalty.running(values)
        self.row = np.zeros(len(pos))
        self.at = len(pos) - 1
        self.held: tuple[int, np.ndarray, np.ndarray] | None = None

    def _step(self, edges: tuple[np.ndarray, np.ndarray] | None) -> tuple[int, np.ndarray]:
        i = self.at
        end = self.reach[i]
        row = self.row[i:end]
        if edges is not None:
            ends, r = edges
            near = ends < end
            add = np.zeros(end - i)
            np.add.at(add, ends[near] - i, r[near])
            row += np.cumsum(add)
        row -= self.taken(i, end)
        self.at -= 1
        return i, row

    def _down_to(self, i: int, edges=None) -> Iterator[tuple[int, np.ndarray]]:
        while self.at > i:
            yield self._step(None)
        yield self._step(edges)

    def feed(self, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Starts that have all their edges now: (place, scores of the windows to each site in reach)."""
        if not len(self.pos):
            return
        i, j = (np.minimum(np.searchsorted(self.pos, x), len(self.pos) - 1) for x in (a, b))
        good = (self.pos[i] == a) & (self.pos[j] == b) & (a < b)
        i, j, r = i[good], j[good], r[good]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(i)], strict=True):
            if x == y:
                continue
            if self.held is not None and self.held[0] == i[x]:
                self.held = (self.held[0], np.concatenate([self.held[1], j[x:y]]), np.concatenate([self.held[2], r[x:y]]))
                continue
            if self.held is not None:
                yield from self._down_to(self.held[0], self.held[1:])
            self.held = int(i[x]), j[x:y], r[x:y]

    def rest(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.held is not None:
            yield from self._down_to(self.held[0], self.held[1:])
        if self.at >= 0:
            yield from self._down_to(0)


def _dealt(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, width: int, ahead: int, by: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """(by, tile, kind, s, p, q, r, penalty's columns, more): sites (position, rank) and edges (ends, weight) of each tile and of what it looks ``ahead``."""
    tile = lambda low, high: F.explode(F.sequence(F.greatest(F.floor((low - ahead - longest) / width), F.lit(0)), F.floor(high / width))).alias("tile")
    pos, a, b = F.col("pos"), F.col("loc_a"), F.col("loc_b")
    extra = [*penalty.columns, *more]
    sites = chrom.select(*by, tile(pos, pos), F.lit(SITE).alias("kind"), pos.alias("s"), pos.alias("p"), F.col("idx").cast("long").alias("q"), F.lit(0.0).alias("r"), *(F.col(c).cast("double").alias(c) for c in extra))
    near = edges.where((b - a <= longest) & (a < b))
    lines = near.select(*by, tile(b, a), F.lit(EDGE).alias("kind"), (-a).alias("s"), a.alias("p"), b.alias("q"), F.col("r").cast("double").alias("r"), *(F.lit(0.0).alias(c) for c in extra))
    return sites.unionByName(lines)


def _tiles(batches, by: Sequence[str], extra: Sequence[str]):
    """Of rows in order of tile and kind: (key, kind, columns) slices, each of one tile and kind; a tile's may be several. At the end (None, None, None)."""
    names = ["kind", "p", "q", "r", *extra]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, "tile", "kind")]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(k[x] for k in keys[:-1]), int(keys[-1][x]), {c: v[x:y] for c, v in columns.items()}
    yield None, None, None


def _passed(batches, by: Sequence[str], extra: Sequence[str], begin, see, end, skip=None):
    """Runs a tile's rows through ``Tile``. ``begin(key, sites)`` gives a Tile, ``see(key, tile, i, row)`` takes each start and ``end(key, tile)`` the tile when it is done; both of the latter may yield batches."""
    key, tile, sites = None, None, []

    def built():
        joined = {c: np.concatenate([s[c] for s in sites]) for c in sites[0]} if sites else None
        return begin(key, joined) if joined else None

    for own, kind, rows in _tiles(batches, by, extra):
        if own != key:
            if key is not None:
                tile = tile or built()
                if tile is not None:
                    for i, row in tile.rest():
                        yield from see(key, tile, i, row)
                yield from end(key, tile)
            key, tile, sites = own, None, []
        if own is None:
            return
        if kind == FOUND:
            skip(key, rows)
        elif kind == SITE:
            sites.append(rows)
        else:
            tile = tile or built()
            if tile is not None:
                for i, row in tile.feed(rows["p"], rows["q"], rows["r"]):
                    yield from see(key, tile, i, row)


def _score_writer(by: Sequence[str], penalty: Penalty, longest: int, owns):
    """Rows (by, i, j, pos_i, pos_j, score) of the starts that a tile ``owns(key, positions)``."""
    extra = list(penalty.columns)

    def write(batches):
        held: list[tuple] = []
        own: list[np.ndarray] = [np.zeros(0, bool)]

        def flush():
            if held:
                n = [len(s) for *_, s in held]
                keys = [[k for k, size in zip(column, n, strict=True) for _ in range(size)] for column in zip(*(h[0][: len(by)] for h in held), strict=True)] if by else []
                numbers = [np.repeat([h[c] for h in held], n) for c in (1, 3)]
                ends = [np.concatenate([h[c] for h in held]) for c in (2, 4, 5)]
                columns = [numbers[0], ends[0], numbers[1], ends[1], ends[2]]
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), *(pa.array(c) for c in columns)], names=[*by, "i", "j", "pos_i", "pos_j", "score"])
                held.clear()

        def begin(key, sites):
            own[0] = owns(key, sites["p"])
            return Tile(sites["p"], sites["q"], {c: sites[c] for c in extra}, penalty, longest) if own[0].any() else None

        size = 0

        def see(key, tile, i, row):
            nonlocal size
            if own[0][i]:
                stop = tile.reach[i]
                held.append((key, int(tile.idx[i]), tile.idx[i:stop], int(tile.pos[i]), tile.pos[i:stop], row.copy()))
                size += len(row)
                if size >= ROWS:
                    size = 0
                    yield from flush()

        def end(key, tile):
            yield from ()

        yield from _passed(batches, by, extra, begin, see, end)
        yield from flush()

    return write


def _score_schema(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, *(T.StructField(n, T.DoubleType() if n == "score" else T.LongType()) for n in ("i", "j", "pos_i", "pos_j", "score"))])


def window_scores(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """(i, j, pos_i, pos_j, score) of all windows of sites within ``longest``: the weights of all edges inside less the penalties of all pairs, a site with itself among them.

    ``edges`` are canonical and without repeated pairs. ``width`` of a tile: the
    longest window, unless given.
    """
    width = max(width or longest, 1)
    fields = [chrom.schema[c] for c in by]
    rows = _dealt(chrom, edges, penalty, longest, width, 0, by).repartition(*by, "tile").sortWithinPartitions(*by, "tile", "kind", "s", "q")
    owns = lambda key, pos: (pos >= key[-1] * width) & (pos < (key[-1] + 1) * width)
    return rows.mapInArrow(_score_writer(by, penalty, longest, owns), _score_schema(fields))


def chunk_scores(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, within, by: Sequence[str] = ()) -> DataFrame:
    """window_scores with a tile for each chunk: from its sites and edges up to its buffer's end, for starts up to its own end.

    ``within(rows, low, high)`` joins rows to the chunks that hold both columns.
    """
    extra, fields = list(penalty.columns), [chrom.schema[c] for c in by]
    # a tile is named by its start, and its last row of the key is the end of its own starts
    key = [*by, F.col("start_bp").alias("_start"), F.col("end_bp").alias("tile")]
    a, b = F.col("loc_a"), F.col("loc_b")
    sites = within(chrom, "pos", "pos").select(*key, F.lit(SITE).alias("kind"), F.col("pos").alias("s"), F.col("pos").alias("p"), F.col("idx").cast("long").alias("q"), F.lit(0.0).alias("r"), *(F.col(c).cast("double").alias(c) for c in extra))
    lines = within(edges.where((b - a <= longest) & (a < b)), "loc_a", "loc_b")
    lines = lines.select(*key, F.lit(EDGE).alias("kind"), (-a).alias("s"), a.alias("p"), b.alias("q"), F.col("r").cast("double").alias("r"), *(F.lit(0.0).alias(c) for c in extra))
    keys = [*by, "_start"]
    rows = sites.unionByName(lines).repartition(*keys).sortWithinPartitions(*keys, "tile", "kind", "s", "q")
    owns = lambda key, pos: pos <= key[-1]
    return rows.mapInArrow(_score_writer(keys, penalty, longest, owns), _score_schema([*fields, T.StructField("_start", T.LongType())])).drop("_start")


#: Columns beside the penalty's: of rows FOUND where the block ends and how far it might, of sites the total given and that of the next site.
_MORE = ("u", "v", "g", "h")
_SOLVED = [("tile", T.LongType()), ("idx", T.LongType()), ("pos", T.LongType()), ("opt", T.DoubleType()), ("brk", T.LongType()), ("reach", T.LongType()), ("own", T.BooleanType()), ("again", T.BooleanType())]


def _landing(found: dict[str, np.ndarray]) -> np.ndarray:
    """Which of a tile's rows its own blocks may lead to, beyond the tile."""
    own = found["own"]
    return ~own & (found["idx"] <= found["reach"][own].max() + 1) if own.any() else np.zeros(len(own), bool)


def _solver(by: Sequence[str], penalty: Penalty, longest: int, width: int, ahead: int):
    """The best totals of each tile's sites, and of those it looks ahead to, as if nothing came after these.

    Where rows FOUND before come first (tiles from the last to the first), a tile that
    is out of step with the right totals of the tile after it is solved again with
    these, and the others are moved by a constant.
    """
    extra = list(penalty.columns)
    columns = [*extra, *_MORE]

    def solve(batches):
        #: The sites after a tile that blocks may lead to, and their right totals, by line.
        right: tuple[tuple | None, np.ndarray, np.ndarray] = (None, np.zeros(0, np.int64), np.zeros(0))
        old: list[dict[str, np.ndarray]] = []
        now: dict[str, np.ndarray] = {}
        again, known = False, None

        def collect(key, rows):
            old.append(rows)

        def from_old(key) -> dict[str, np.ndarray]:
            rows = {c: np.concatenate([o[c] for o in old]) for c in ("p", "q", "r", "u", "v")}
            low, high = key[-1] * width, (key[-1] + 1) * width
            return {"idx": rows["p"], "pos": rows["q"], "opt": rows["r"], "brk": rows["u"].astype(np.int64), "reach": rows["v"].astype(np.int64), "own": (rows["q"] >= low) & (rows["q"] < high)}

        def begin(key, sites):
            nonlocal again, known, now
            again, known = False, None
            pos, idx = sites["p"], sites["q"]
            given = ~np.isnan(sites["g"])
            own = (pos >= key[-1] * width) & (pos < (key[-1] + 1) * width) & ~given
            if not own.any():
                return None
            if old:
                known = from_old(key)
                if right[0] is None or right[0] != key[:-1]:
                    return None  # the first tile of a line that is given: right as it is
                at = _landing(known)
                totals = _lookup(right, known["idx"][at])
                differ = totals - known["opt"][at]
                if not np.isnan(differ).any() and (not len(differ) or np.ptp(differ) <= CLOSE * max(1.0, np.abs(totals).max())):
                    known["opt"] = known["opt"] + (differ[0] if len(differ) else 0.0)
                    return None  # in step
                again = True
            tile = Tile(pos, idx, {c: sites[c] for c in extra}, penalty, longest)
            limit = (key[-1] + 1) * width + (0 if again else ahead)
            n = int(((pos < limit) & ~given).sum())
            opt = np.zeros(len(pos) + 1)
            after = np.concatenate([idx[n:], [idx[-1] + 1]])
            if again:
                opt[n:] = _lookup(right, after)
            elif given[n:].all():
                opt[n:] = np.nan_to_num(np.concatenate([sites["g"][n:], sites["h"][-1:]]))
            now = {"n": n, "opt": opt, "brk": np.full(n, -1, np.int64), "own": own[:n], "after": after, "given": bool(given[n:].all())}
            return tile

        def see(key, tile, i, row):
            if i < now["n"]:
                stop = tile.reach[i]
                total = row + now["opt"][i + 1 : stop + 1]
                if again:
                    total = np.where(np.isnan(total), -np.inf, total)
                best = int(np.argmax(total))  # the first of equals
                now["opt"][i], now["brk"][i] = total[best], i + best
            yield from ()

        def end(key, tile):
            nonlocal right, known
            if tile is not None:
                n = now["n"]
                found = {"idx": tile.idx[:n], "pos": tile.pos[:n], "opt": now["opt"][:n], "brk": tile.idx[now["brk"]], "reach": tile.idx[tile.reach[:n] - 1], "own": now["own"]}
                if again:
                    later = right[1] > found["idx"][-1]
                    more = {"idx": right[1][later], "opt": right[2][later]}
                else:
                    # of sites that aren't given only one past the last: nothing after it is looked at
                    k = len(now["after"]) if now["given"] else 1
                    more = {"idx": now["after"][:k], "opt": now["opt"][n : n + k]}
                k = len(more["idx"])
                more |= {"pos": np.full(k, -1), "brk": np.full(k, -1), "reach": np.full(k, -1), "own": np.zeros(k, bool)}
                found = {c: np.concatenate([found[c], more[c]]) for c in found}
            elif known is not None:
                found = known
            else:
                old.clear()
                return
            last = found["reach"][found["own"]].max() + 1
            near = found["idx"] <= last
            right = (key[:-1], found["idx"][near], found["opt"][near])
            m = len(found["idx"])
            rows = [*(pa.array([k] * m) for k in key[:-1]), pa.array(np.full(m, key[-1])), *(pa.array(found[c]) for c in ("idx", "pos", "opt", "brk", "reach", "own")), pa.array(np.full(m, again and tile is not None))]
            old.clear()
            known = None
            yield pa.RecordBatch.from_arrays(rows, names=[*by, *(n for n, _ in _SOLVED)])

        yield from _passed(batches, by, columns, begin, see, end, collect)

    return solve


def _lookup(right: tuple, idx: np.ndarray) -> np.ndarray:
    """The totals of some sites, not a number where they aren't known."""
    _, known, opt = right
    if not len(known):
        return np.full(len(idx), np.nan)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known, idx, sorter=order), len(known) - 1)
    return np.where(known[order][at] == idx, opt[order][at], np.nan)


def optimum(chrom: DataFrame, edges: DataFrame, penalty: Penalty, longest: int, by: Sequence[str] = (), width: int | None = None, ahead: int | None = None, given: DataFrame | None = None) -> DataFrame:
    """(idx, pos, opt, brk, brk_idx, again): for each site the best total from it on and where its first block ends, of all partitions into windows within ``longest``.

    Tiles of ``width`` are solved apart, each with the sites ``ahead`` of it, as if
    nothing came after these. Where the totals of all sites that a tile's blocks may
    lead to differ from the next tile's by one constant, its choices are right and
    its totals follow from the sum of constants. That is so where blocks from
    different ends have fallen into step. Should a tile be out of step, then in a
    second round, of those lines only, one task a line goes from that tile to the
    first: a tile out of step is solved again with the right totals of the tile
    after it (``again``), the others are kept. There is no third round. Of equal
    totals the nearest end counts, unless rounding tells them apart.

    ``given(idx, opt)``: sites that are solved already, all of them to the right of
    the others; blocks may reach them, and what comes after a block is theirs.
    """
    width = max(width or 8 * longest, longest, 1)
    ahead = min(max(ahead or 4 * longest, longest), width)
    fields = [chrom.schema[c] for c in by]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in _SOLVED)])
    none = F.lit(float("nan"))
    if given is None:
        line = chrom.withColumns({"g": none, "h": none})
    else:
        totals = given.select(*by, "idx", F.col("opt").alias("g"))
        line = chrom.join(totals, [*by, "idx"], "left").join(totals.select(*by, (F.col("idx") - 1).alias("idx"), F.col("g").alias("h")), [*by, "idx"], "left")
        line = line.withColumns({c: F.coalesce(c, none) for c in "gh"})
    dealt = _dealt(line, edges, penalty, longest, width, ahead, by, ("g", "h")).withColumns({"u": F.lit(0.0), "v": F.lit(0.0)})
    solver = _solver(by, penalty, longest, width, ahead)
    rows = dealt.repartition(*by, "tile").sortWithinPartitions(*by, "tile", "kind", "s", "q")
    solved = written(rows.mapInArrow(solver, schema), "tiles-solved")

    own = solved.where("own").groupBy(*by, "tile").agg(F.max("reach").alias("last"), F.max("idx").alias("top"))
    line = Window.partitionBy(*by).orderBy("tile")  # one row a tile
    own = own.withColumn("after", F.lead("tile").over(line))
    met = solved.where("NOT own").join(own, [*by, "tile"]).where("after IS NOT NULL AND idx <= last + 1").select(*by, "tile", "after", "idx", "opt")
    other = solved.select(*by, F.col("tile").alias("after"), "idx", F.col("opt").alias("there"))
    met = met.join(other, [*by, "after", "idx"], "left").withColumn("differ", F.col("there") - F.col("opt"))
    steps = met.groupBy(*by, "tile").agg(F.min("differ").alias("differ"), (F.count_if(F.col("there").isNull()) + F.when(F.max("differ") - F.min("differ") > CLOSE * F.greatest(F.lit(1.0), F.max(F.abs("there"))), 1).otherwise(0)).alias("bad"))
    steps = own.join(steps, [*by, "tile"], "left")
    back = Window.partitionBy(*by).orderBy(F.desc("tile"))
    moved = steps.select(*by, "tile", F.sum(F.coalesce("differ", F.lit(0.0))).over(back).alias("moved"), F.max(F.when(F.coalesce("bad", F.lit(0)) > 0, F.col("tile"))).over(Window.partitionBy(*by)).alias("broken"), "after")
    kept = solved.where("own").join(moved, [*by, "tile"])
    good = kept.where("broken IS NULL OR tile > broken").select(*by, "idx", "pos", (F.col("opt") + F.col("moved")).alias("opt"), "brk", F.lit(False).alias("again"))
    if moved.where("broken IS NOT NULL").limit(1).count():
        bounds = moved.where("tile = broken").select(*by, "broken", F.col("after").alias("base"))
        base = moved.select(*by, F.col("tile").alias("base"), F.col("moved").alias("base_moved"))
        bounds = bounds.join(base, [*by, "base"])
        at = (lambda df: df.join(F.broadcast(bounds), list(by)) if by else df.crossJoin(F.broadcast(bounds)))  # one row a line
        # the tile after the broken one as it is, and all before it
        given = at(solved).where("tile <= base").select(*by, "tile", F.lit(FOUND).alias("kind"), F.col("idx").alias("s"), F.col("idx").alias("p"), F.col("pos").alias("q"), F.when(F.col("tile") == F.col("base"), F.col("opt") + F.col("base_moved")).otherwise(F.col("opt")).alias("r"), *(F.lit(0.0).alias(c) for c in penalty.columns), F.col("brk").cast("double").alias("u"), F.col("reach").cast("double").alias("v"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))
        fresh = at(dealt).where("tile <= broken OR (tile = base AND kind = 1)").select(given.columns)
        rows = given.unionByName(fresh)
        rows = (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, F.desc("tile"), "kind", "s", "q")
        anew = rows.mapInArrow(solver, schema).where("own")
        anew = at(anew).where("tile <= broken").select(*by, "idx", "pos", "opt", "brk", "again")
        good = good.unionByName(anew)
    ends = chrom.select(*by, F.col("idx").alias("brk"), F.col("pos").alias("end"))
    return good.join(ends, [*by, "brk"]).select(*by, "idx", "pos", "opt", F.col("end").alias("brk"), F.col("brk").alias("brk_idx"), "again")
