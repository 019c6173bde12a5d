"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). A flow routes each pattern's words to the quotas of its sources; a
pattern's words cost more with each repetition, so the flow spreads repetition
evenly. Then documents are laid on a line in seeded order, pattern by pattern,
and each is taken as often as its pattern's flow passes over it.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploweave.llm._io import WORD, materialize, small_table, table

#: Hex digits of the seeded order that number its buckets: 16 to this power.
BUCKET_DIGITS = 3
#: A document more that fits what is left to a target is added so many times at most; then one that goes over, if that is nearer.
FILLS = 4
#: Membership patterns and sources at most: the flow over them is found on the driver.
PATTERNS = 50_000


def quotas(sizes: list[int], weights: list[int], limit: int = 3) -> list[float]:
    """Targets that share all words by weight, none over ``limit`` times its source's words."""
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    total, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for i in order:
        if limit * sizes[i] * weight <= weights[i] * total:
            out[i] = float(limit * sizes[i])
            total, weight = total - limit * sizes[i], weight - weights[i]
        else:
            out[i] = weights[i] * total / weight
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], targets: list[int], limit: int = 3) -> list[dict[int, int]]:
    """Words that each pattern (its sources, its words) sends to each source.

    As much as possible reaches the targets; the r-th copy of a word costs 2r - 1.
    The network has a node for each pattern and source, whatever the documents.
    """
    start, end, first = 0, 1, 2
    graph: list[list[list]] = [[] for _ in range(first + len(patterns) + len(targets))]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    sent: list[dict[int, list]] = []
    for p, (sources, words) in enumerate(patterns):
        for r in range(1, limit + 1):
            arc(start, first + p, words, 2 * r - 1)
        sent.append({s: arc(first + p, first + len(patterns) + s, limit * words, 0) for s in sources})
    for s, room in enumerate(targets):
        arc(first + len(patterns) + s, end, room, 0)
    while True:
        far, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if e[1] > 0 and far[a] + e[2] < far.get(e[0], 1 << 60):
                    far[e[0]], via[e[0]] = far[a] + e[2], e
                    if e[0] not in queued:
                        queue.append(e[0])
                        queued.add(e[0])
        if end not in via:
            return [{s: e[3][1] for s, e in own.items()} for own in sent]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = via[at][3][0]
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            e[3][1] += room


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: str = "mix") -> DataFrame:
    """``docs(doc_id, size, sources)`` with source_names, source_sizes, targets (of the document's sources), copies and by_copy (the source that each copy counts for).

    ``sources``: the document's sources, an array of strings. Sources by code
    point, null last, take ``weights`` in turn. Each source's words taken come
    as near its target as whole documents in seeded order, up to FILLS more that
    fit what is left, and perhaps one that goes over bring them. Empty documents have size 0 and are
    laid on the line too. Repeated rows are documents of their own; rows without
    sources are never taken. The order is that of md5(seed:doc_id), so that
    reruns agree; ties go by size. More than PATTERNS combinations of sources are an
    error. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pattern = F.to_json(F.sort_array(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))), {"ignoreNullFields": "false"})
    lined = docs.withColumn("pattern", pattern).withColumn("spot", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("bucket", F.substring("spot", 1, BUCKET_DIGITS))
    lined = materialize(lined, "mix-sizes")
    whole = lined.groupBy("pattern").agg(F.sum("size").cast("long").alias("words"), F.first("sources").alias("sources")).limit(PATTERNS + 1).collect()
    if len(whole) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} combinations of sources: name sources more coarsely")
    whole.sort(key=lambda r: r["pattern"])
    held = [tuple(dict.fromkeys(r["sources"] or ())) for r in whole]
    names = sorted({s for h in held for s in h}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for h, r in zip(held, whole, strict=True):
        for s in h:
            size[at[s]] += r["words"]
    aims = quotas(size, [weights[i % len(weights)] for i in range(len(names))], limit) if names else []
    flows = min_cost_flow([(tuple(sorted(at[s] for s in h)), r["words"]) for h, r in zip(held, whole, strict=True)], [int(x + 0.5) for x in aims], limit)

    plan = []
    for h, r, flow in zip(held, whole, flows, strict=True):
        total, reach, parts = sum(flow.values()), 0, []
        for s in sorted(flow):
            if flow[s]:
                parts.append({"lo": reach, "hi": reach + flow[s], "source": names[s]})
                reach += flow[s]
        full = total // r["words"] if r["words"] else 0
        plan.append((r["pattern"], r["words"], full, total - full * r["words"], parts, sorted(h, key=lambda s: at[s]), [size[at[s]] for s in sorted(h, key=lambda s: at[s])], [aims[at[s]] for s in sorted(h, key=lambda s: at[s])]))
    text, long = pa.string(), pa.int64()
    part = pa.struct([("lo", long), ("hi", long), ("source", text)])
    shape = pa.schema([("pattern", text), ("words", long), ("full", long), ("rest", long), ("parts", pa.list_(part)), ("source_names", pa.list_(text)), ("source_sizes", pa.list_(long)), ("targets", pa.list_(pa.float64()))])
    plan_rows = F.broadcast(small_table(spark, plan, shape))  # one row a pattern

    sums = lined.groupBy("pattern", "bucket").agg(F.sum("size").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("held")).drop("held")
    order = Window.partitionBy("pattern", "bucket").orderBy("spot", "size")
    placed = lined.withColumn("own", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(before, ["pattern", "bucket"])
    placed = placed.withColumn("stop", F.col("before") + F.col("own")).withColumn("start", F.col("stop") - F.col("size")).drop("own", "before", "spot", "bucket")
    placed = materialize(placed.join(plan_rows.select("pattern", "rest"), "pattern"), "mix-line")

    # what a pattern's whole documents leave of its rest is filled by the largest that fit
    inside = {r["pattern"]: r["s"] or 0 for r in placed.where("stop <= rest").groupBy("pattern").agg(F.sum("size").alias("s")).collect()}
    gaps = {p[0]: p[3] - inside.get(p[0], 0) for p in plan}
    added: list[tuple[str, int]] = []
    spots_of = pa.schema([("pattern", text), ("start", long)])
    for fill in range(FILLS + 1):
        open_gaps = [(p, g) for p, g in gaps.items() if g > 0]
        if not open_gaps:
            break
        left = placed.where("stop > rest AND size > 0").join(F.broadcast(small_table(spark, open_gaps, pa.schema([("pattern", text), ("gap", long)]))), "pattern")
        left = left.join(F.broadcast(small_table(spark, added, spots_of)), ["pattern", "start"], "left_anti")
        if fill < FILLS:
            left, sign = left.where("size <= gap"), -1
        else:
            left, sign = left.where("size > gap AND size < 2 * gap"), 1
        for r in left.groupBy("pattern").agg(F.min(F.struct((sign * F.col("size")).alias("z"), "start")).alias("m")).collect():
            gaps[r["pattern"]] -= sign * r["m"]["z"]
            added.append((r["pattern"], r["m"]["start"]))
    more = F.broadcast(small_table(spark, added, spots_of).withColumn("more", F.lit(1)))  # FILLS + 1 rows a pattern
    taken = placed.join(more, ["pattern", "start"], "left").drop("rest").join(plan_rows, "pattern")
    one = (F.col("stop") <= F.col("rest")) | (F.col("more").isNotNull() & (F.col("size") > 0))
    taken = taken.withColumn("copies", F.least(F.col("full") + F.when(one, 1).otherwise(0), F.lit(limit)))  # the limit binds empty documents
    # the k-th copy goes to the source whose part of the line it starts in, the last one if past all
    spots = F.expr("transform(sequence(0L, copies), k -> start + k * words)")
    place = F.transform(F.slice(spots, F.lit(1), F.col("copies").cast("int")), lambda x: F.coalesce(F.try_element_at(F.filter("parts", lambda p: (x >= p["lo"]) & (x < p["hi"])), F.lit(1))["source"], F.try_element_at("parts", F.lit(-1))["source"]))
    return taken.withColumn("by_copy", F.when((F.col("copies") > 0) & (F.size("parts") > 0), place).otherwise(F.array().cast("array<string>"))).drop("more", "full", "rest", "parts", "words", "start", "stop", "pattern")


def sized(docs: DataFrame, **more) -> DataFrame:
    """doc_id, size in words, sources, of a documents table, and ``more`` columns by name."""
    return docs.select(*(c.alias(n) for n, c in more.items()), F.col("doc_id").cast("long"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.array(F.col("source").cast("string")).alias("sources"))


def op7_mix_sources(spark, sf_dir):
    mixed = mix(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


_FILL = "".join(
    f""",
f{i} AS (SELECT *, c{i} OR coalesce(row_number() OVER (PARTITION BY source, NOT c{i} AND size > 0 AND size <= g{i} ORDER BY size DESC, start) = 1 AND NOT c{i} AND size > 0 AND size <= g{i}, false) AS c{i + 1} FROM g{i}),
g{i + 1} AS (SELECT *, rest - coalesce(sum(size) FILTER (c{i + 1}) OVER (PARTITION BY source), 0) AS g{i + 1} FROM f{i})"""
    for i in range(FILLS)
)
_FILL += f""",
f{FILLS} AS (SELECT *, c{FILLS} OR coalesce(row_number() OVER (PARTITION BY source, NOT c{FILLS} AND size > g{FILLS} ORDER BY size, start) = 1 AND NOT c{FILLS} AND size > g{FILLS} AND size < 2 * g{FILLS}, false) AS c FROM g{FILLS})"""
SQL = f"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\x0C\\r]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(w) OVER () - sum(w) OVER k + w AS wl, sum(source_size) OVER () - 3 * (sum(source_size) OVER k - source_size) AS tl
      FROM s WINDOW k AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, 3 * source_size * wl <= w * tl AS capped FROM o),
y AS (SELECT *, CASE WHEN capped THEN cast(3 * source_size AS DOUBLE) ELSE cast(w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) AS DOUBLE) / cast(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM x),
z AS (SELECT *, cast(floor(target + 0.5) AS BIGINT) AS flow FROM y),
p AS (SELECT d.doc_id, d.size, z.*, CASE WHEN source_size = 0 THEN 0 ELSE flow // source_size END AS full_copies, CASE WHEN source_size = 0 THEN 0 ELSE flow % source_size END AS rest,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(cast(d.doc_id AS VARCHAR), 'null')), d.size ROWS UNBOUNDED PRECEDING) AS stop
      FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
q AS (SELECT *, stop - size AS start, stop <= rest AS c0 FROM p),
g0 AS (SELECT *, rest - coalesce(sum(size) FILTER (c0) OVER (PARTITION BY source), 0) AS g0 FROM q){_FILL}
SELECT doc_id, size, source_size, target, cast(size * (full_copies + CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f{FILLS}
"""
