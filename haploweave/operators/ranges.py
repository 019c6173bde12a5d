"""Joins by distance on a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(left: DataFrame, right: DataFrame, left_pos: str, right_pos: str, distance: int, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """Pairs with ``least`` <= right_pos - left_pos <= ``distance``. Columns of both sides but ``by`` must differ.

    Both sides are cut into buckets of the distance, the right side twice, so that
    the join is by equality and a bucket's rows meet only those within reach.
    """
    width = max(int(distance), 1)
    a = left.withColumn("_bucket", F.floor(F.col(left_pos) / width))
    own = F.floor(F.col(right_pos) / width)
    b = right.withColumn("_bucket", F.explode(F.array(own, own - 1)))
    gap = F.col(right_pos) - F.col(left_pos)
    return a.join(b, [*by, "_bucket"]).where((gap >= least) & (gap <= distance)).drop("_bucket")


#: Positions of a stretch of a line that one task orders.
STRETCH = 1 << 20


def _stretch(position: str, width: int):
    return F.floor(F.col(position) / width).alias("_stretch")


def ranked(rows: DataFrame, position: str = "pos", by: Sequence[str] = (), width: int = STRETCH) -> DataFrame:
    """``rows``, of distinct positions, with ``idx``, their rank from 0: within stretches, after the counts of those before."""
    cut = rows.withColumn("_stretch", _stretch(position, width))
    counts = cut.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    # one row a stretch
    before = counts.select(*by, "_stretch", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(position))
    return cut.join(before, [*by, "_stretch"]).withColumn("idx", (own + F.col("_before") - 1).cast("long")).drop("_stretch", "_before")


def running_max(rows: DataFrame, position: str, value, name: str, order: Sequence, by: Sequence[str] = (), back: bool = False, width: int = STRETCH) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of all rows before, in ``order``, whose first column is the position, falling if ``back``; null without any.

    Stretches are ordered apart; what those before hold comes to each as one row.
    """
    cut = rows.withColumn("_stretch", _stretch(position, width)).withColumn("_value", value)
    tops = cut.groupBy(*by, "_stretch").agg(F.max("_value").alias("_top"))
    line = Window.partitionBy(*by).orderBy(F.desc("_stretch") if back else F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_stretch", F.max("_top").over(line).alias("_carried"))
    inner = Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_own", F.max("_value").over(inner)).join(carried, [*by, "_stretch"]).withColumn(name, F.greatest("_own", "_carried")).drop("_stretch", "_value", "_own", "_carried")


def neighbours(chrom: DataFrame, distance: int, by: Sequence[str] = (), width: int = STRETCH) -> DataFrame:
    """``chrom(pos, idx)`` with right_idx, right_pos (last site at most ``distance`` after) and left_idx, left_pos (first at most ``distance`` before).

    Each stretch also sees the sites within the distance on both sides of it.
    """
    width = max(width, distance + 1)
    own = F.floor(F.col("pos") / width)
    seen = F.array_distinct(F.array(own, F.floor((F.col("pos") - distance) / width), F.floor((F.col("pos") + distance) / width)))
    dealt = chrom.withColumn("_stretch", F.explode(seen))
    line = Window.partitionBy(*by, "_stretch").orderBy("pos")
    ahead, behind = line.rangeBetween(0, distance), line.rangeBetween(-distance, 0)
    found = dealt.select("*", F.max("idx").over(ahead).alias("right_idx"), F.max("pos").over(ahead).alias("right_pos"), F.min("idx").over(behind).alias("left_idx"), F.min("pos").over(behind).alias("left_pos"))
    return found.where(F.col("_stretch") == own).drop("_stretch")


def following(chrom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(pos, next_pos) of each site that another follows."""
    after = chrom.select(*by, "idx", "pos")
    return after.join(after.select(*by, (F.col("idx") - 1).alias("idx"), F.col("pos").alias("next_pos")), [*by, "idx"]).select(*by, "pos", "next_pos")


def nearest(points: DataFrame, chrom: DataFrame, point: str = "point", by: Sequence[str] = ()) -> DataFrame:
    """``points(point)`` with pos and idx of the nearest site; of two as near, the first.

    Each point looks at the last site before it and the first after it.
    """
    sites = chrom.select(*by, F.col("pos").alias("at"), F.lit(0).alias("kind"), "pos", "idx")
    both = sites.unionByName(points.select(*by, F.col(point).alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    is_site = F.col("pos").isNotNull()
    both = running_max(both, "at", F.when(is_site, F.struct("pos", "idx")), "b", ["at", "kind"], by)
    both = running_max(both, "at", F.when(is_site, F.struct((-F.col("pos")).alias("pos"), "idx")), "a", [F.desc("at"), "kind"], by, back=True)
    found = both.where("kind = 1")
    after = -F.col("a.pos")
    first = after.isNull() | (F.col("at") - F.col("b.pos") <= after - F.col("at"))
    from_left = F.col("b.pos").isNotNull() & first
    return found.select(*by, F.col("at").alias(point), F.when(from_left, F.col("b.pos")).otherwise(after).alias("pos"), F.when(from_left, F.col("b.idx")).otherwise(F.col("a.idx")).alias("idx"))


#: A level's bins are so many times as wide as those of the level below; the top level's hold any line of unsigned 32-bit positions.
FACTOR, SPAN = 8, 1 << 33


def level_widths(width: int) -> list[float]:
    widths = [float(max(width, 1))]
    while widths[-1] < SPAN:
        widths.append(widths[-1] * FACTOR)
    return widths


def binned_by_level(rows: DataFrame, start: str, stop: str, other: DataFrame, width: int, own_side: int, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` of half-open intervals with _side, _level and _bin, where they meet those of ``other``; both have _level (with_level).

    An interval lies in the one or two bins of its own level that it touches, on
    ``own_side``; on the other side it looks for longer ones at each level above that
    ``other`` holds. Of equal levels, side 0 is where they meet.
    """
    held = other.groupBy(*by).agg(F.collect_set("_level").alias("_held"))  # a few levels
    rows = rows.join(held, list(by)) if by else rows.crossJoin(F.broadcast(held))  # one row
    widths = F.array(*(F.lit(w) for w in level_widths(width)))

    def bins(side: int, levels: Column) -> Column:
        def of(k: Column) -> Column:
            first = F.floor(F.col(start) / F.get(widths, k))
            last = F.greatest(first, F.ceil(F.col(stop) / F.get(widths, k)) - 1)
            return F.transform(F.sequence(first, last), lambda x: F.struct(F.lit(side).alias("_side"), k.alias("_level"), x.alias("_bin")))

        return F.flatten(F.transform(levels, of))

    own = F.col("_level")
    above = F.filter("_held", lambda k: k > own if own_side == 0 else k >= own)
    found = F.concat(bins(own_side, F.array(own)), bins(1 - own_side, above))
    kept = [c for c in rows.columns if c not in ("_held", "_level")]
    return rows.select(*kept, F.explode(found).alias("_at")).select(*kept, "_at.*")


def with_level(rows: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """Intervals that aren't empty, with the lowest level whose bins are as wide as they are long; longer ones than all are of the top level, and lie in more than two of its bins."""
    widths = level_widths(width)
    length = F.col(stop) - F.col(start)
    fits = [F.when(length <= w, F.lit(k)) for k, w in enumerate(widths)]
    return rows.where(F.col(start) < F.col(stop)).withColumn("_level", F.coalesce(*fits, F.lit(len(widths) - 1)))


def overlaps(left: DataFrame, right: DataFrame, names: tuple[str, str, str, str], width: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of half-open intervals that overlap. ``names``: start and stop of both sides; ``width``: about the length of the shorter ones.

    A pair meets at the level of the longer of the two, in the first bin that both
    touch. Lengths may differ by any factor: a row is dealt at most two times a level.
    """
    s, e, u, v = names
    a, b = with_level(left, s, e, width), with_level(right, u, v, width)
    pairs = binned_by_level(a, s, e, b, width, 0, by).join(binned_by_level(b, u, v, a, width, 1, by), [*by, "_side", "_level", "_bin"])
    at = F.get(F.array(*(F.lit(w) for w in level_widths(width))), F.col("_level"))
    return pairs.where((F.col(s) < F.col(v)) & (F.col(u) < F.col(e)) & (F.col("_bin") == F.floor(F.greatest(s, u) / at))).drop("_side", "_level", "_bin")


def within(rows: DataFrame, low: str, high: str, spans: DataFrame, start: str, stop: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with every span that holds both their ends (start <= low, high <= stop).

    Spans are dealt to the buckets of ``width`` that they touch, and joined by the
    bucket of the low end; Spark broadcasts them where their size allows.
    """
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    joined = rows.withColumn("_bucket", F.floor(F.col(low) / width)).join(dealt, [*by, "_bucket"])
    return joined.where((F.col(low) >= F.col(start)) & (F.col(high) <= F.col(stop))).drop("_bucket")
