"""What a walk along successors visits, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haploweave.sources.shared import written

#: Indices of a stretch that one task walks.
STRETCH = 1 << 16


def _by_stretch(batches, by: Sequence[str], names: Sequence[str]):
    """Of rows in order of stretch: (key, columns) of each stretch, whole."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_pylist() for c in (*by, "_stretch")]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= np.fromiter((x != y for x, y in zip(k[1:], k[:-1], strict=True)), bool, len(k) - 1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(k[x] for k in keys)
            if own != key and held:
                yield key, {c: np.concatenate([h[c] for h in held]) for c in names}
                held = []
            key = own
            held.append({c: v[x:y] for c, v in columns.items()})
    if held:
        yield key, {c: np.concatenate([h[c] for h in held]) for c in names}


def _batch(by: Sequence[str], key: tuple, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([*(pa.array([k] * n) for k in key[: len(by)]), *(pa.array(v) for v in columns.values())], names=[*by, *columns])


def _exits(by: Sequence[str]):
    """Of each index, where the walk from it leaves its stretch."""

    def find(batches):
        for key, rows in _by_stretch(batches, by, ["idx", "next"]):
            idx, following = rows["idx"], rows["next"]
            at = np.searchsorted(idx, following)
            inside = (at < len(idx)) & (idx[np.minimum(at, len(idx) - 1)] == following)
            left = following.copy()
            for i in range(len(idx) - 1, -1, -1):
                if inside[i]:
                    left[i] = left[at[i]]
            yield _batch(by, key, {"idx": idx, "left": left})

    return find


def _walk(by: Sequence[str]):
    """The indices that walks from a stretch's entries visit."""

    def walk(batches):
        for key, rows in _by_stretch(batches, by, ["idx", "next", "enters"]):
            idx, following = rows["idx"], rows["next"]
            on = rows["enters"].astype(bool).copy()
            at = np.searchsorted(idx, following)
            inside = (at < len(idx)) & (idx[np.minimum(at, len(idx) - 1)] == following)
            for i in range(len(idx)):
                if on[i] and inside[i]:
                    on[at[i]] = True
            yield _batch(by, key, {"idx": idx[on]})

    return walk


def visited(steps: DataFrame, by: Sequence[str] = (), stretch: int = STRETCH) -> DataFrame:
    """(idx): what a walk from the smallest ``idx`` of ``steps(idx, next)`` visits; it ends where a step leads to no row. Each idx occurs once, and next > idx.

    Each stretch of a line finds where walks leave it. Only indices that some walk
    enters a stretch by are left; among them, the walk's entries are found by
    pointer doubling: in each round the pointers become twice as long, and what is
    reached twice as much. So there are as many rounds as the logarithm of the
    stretches. Then every stretch walks from its entries.
    """
    fields = [steps.schema[c] for c in by]
    long = lambda *names: T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in names)])
    rows = steps.select(*by, F.col("idx").cast("long").alias("idx"), F.col("next").cast("long").alias("next")).withColumn("_stretch", F.floor(F.col("idx") / stretch))
    rows = written(rows, "chain-steps")
    dealt = rows.repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", "idx")
    left = written(dealt.mapInArrow(_exits(by), long("idx", "left")), "chain-exits")
    first = rows.groupBy(*by).agg(F.min("idx").alias("idx")).where("idx IS NOT NULL")
    doors = first.select(*by, "idx").unionByName(left.select(*by, F.col("left").alias("idx"))).distinct()
    jumps = written(left.join(doors, [*by, "idx"]).select(*by, "idx", F.col("left").alias("to")), "chain-jumps")
    reached = first
    while jumps.limit(1).count():
        more = reached.join(jumps, [*by, "idx"]).select(*by, F.col("to").alias("idx"))
        reached = written(reached.unionByName(more).distinct(), "chain-reached")
        longer = jumps.withColumnRenamed("to", "mid").join(jumps.select(*by, F.col("idx").alias("mid"), "to"), [*by, "mid"])
        jumps = written(longer.select(*by, "idx", "to"), "chain-jumps")
    entered = rows.join(reached.withColumn("enters", F.lit(True)), [*by, "idx"], "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    dealt = entered.repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", "idx")
    return dealt.mapInArrow(_walk(by), long("idx"))
