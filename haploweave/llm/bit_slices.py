"""Exact top-k inner products by a bit-sliced index.

A block of rows holds each component as slices: one bitmap over the block's rows for
each bit. A query's inner product is a sum of slices, shifted by the signed binary
digits of the query's components (a slice to be taken away is added as its complement,
with a constant), and carry-save adders over whole bitmaps make the slices of the sums.
From the most significant of these downward the k-th largest sum is found by counting
bits. Components keep their upper bits only, so a sum is known within a bound: all rows
whose sums come that near to the k-th are boundary rows, and are scored exactly.

Queries meet rows in cells, one for each pair of a block of queries and a block of
rows. Rows are dealt to blocks one by one, so that copies of one vector, or rows of one
identifier, spread over all blocks, in each of which a vector is added up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from haploweave.llm._io import materialize, table

#: Components are quantised to floor(SCALE * x).
SCALE = 256
#: Quantised components from here on (either sign) might make scores that don't fit a long.
LIMIT = 1 << 26
#: Bits of a component that a block's slices keep, the upper ones of its range there.
SLICES = 6
#: Rows of a block, and queries of a block at most.
BLOCK, QUERIES = 1 << 15, 1 << 12


def signed_digits(n: int) -> list[tuple[int, bool]]:
    """(weight, negative) of the digits 1 and -1 of a number, no two of them adjacent."""
    out, weight = [], 0
    while n:
        if n & 1:
            negative = n & 3 == 3
            out.append((weight, negative))
            n += 1 if negative else -1
        n >>= 1
        weight += 1
    return out


class BitSlices:
    """The slices of one block's distinct vectors (rows of a matrix of whole numbers)."""

    def __init__(self, matrix: np.ndarray, slices: int = SLICES):
        n, dim = matrix.shape
        self.rows, self.low = n, matrix.min(0)
        offset = matrix - self.low
        bits = [int(x).bit_length() for x in offset.max(0)]
        self.dropped = [max(0, b - slices) for b in bits]
        self.first, maps = [], []
        for d in range(dim):
            self.first.append(len(maps))
            kept = offset[:, d] >> self.dropped[d]
            maps += [(kept >> b & 1).astype(np.uint8) for b in range(bits[d] - self.dropped[d])]
        self.first.append(len(maps))
        self.words = -(-n // 64)
        packed = np.zeros((len(maps), self.words * 8), np.uint8)
        if maps:
            packed[:, : -(-n // 8)] = np.packbits(np.stack(maps), axis=1, bitorder="little")
        self.maps = packed.view(np.uint64)
        self.every = self._bitmap(np.ones(n, np.uint8))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        out[: -(-self.rows // 8)] = np.packbits(bits, bitorder="little")
        return out.view(np.uint64)

    def sums(self, query: list[int]) -> tuple[np.ndarray, int]:
        """Slices, the least significant first, of every row's sum, and how much sums may lie apart from products (less a constant)."""
        parts: dict[int, tuple[list[int], list[int]]] = {}
        spread = 0
        for d, q in enumerate(query):
            at, drop = range(self.first[d], self.first[d + 1]), self.dropped[d]
            spread += abs(q) * ((1 << drop) - 1)
            for weight, negative in signed_digits(q):
                for b, i in enumerate(at):
                    plus, minus = parts.setdefault(weight + drop + b, ([], []))
                    (minus if negative else plus).append(i)
        out, carried, weight = [], np.zeros((0, self.words), np.uint64), 0
        top = max(parts, default=-1)
        while weight <= top or len(carried):
            plus, minus = parts.get(weight, ([], []))
            now = np.concatenate([self.maps[plus], ~self.maps[minus], carried])
            up = []
            while len(now) > 2:  # a full adder makes two bitmaps of three
                m = len(now) // 3
                a, b, c = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                ab = a ^ b
                up.append((a & b) | (c & ab))
                now = np.concatenate([ab ^ c, now[3 * m :]])
            if len(now) == 2:
                up.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
            out.append(now[0] if len(now) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(up) if up else np.zeros((0, self.words), np.uint64)
            weight += 1
        return (np.stack(out) if out else np.zeros((0, self.words), np.uint64)), spread

    def top(self, query: list[int], k: int) -> np.ndarray:
        """Rows among which the ``k`` largest products are, with all that tie with the k-th."""
        if self.rows <= k:
            return np.arange(self.rows)
        slices, spread = self.sums(query)
        among, need, least = self.every, k, 0
        for s in slices[::-1]:
            with_it = among & s
            n = int(np.bitwise_count(with_it).sum())
            if n >= need:
                among, least = with_it, 2 * least + 1
            else:
                among, need, least = among & ~s, need - n, 2 * least
        least -= spread
        if least <= 0:
            return np.arange(self.rows)
        above, equal = np.zeros(self.words, np.uint64), self.every
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))


class Block:
    """The distinct vectors of a block with their smallest identifiers, and searches in it.

    Rows come in order of identifier and vector. Of equal vectors at most ``k`` rows of one
    identifier are held and 2 k in all: without those of any one identifier, k stay.
    """

    def __init__(self, k: int, slices: int):
        self.k, self.slices = k, slices
        self.at: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        #: Distinct vectors of each identifier with several; they leave its results together.
        self.shared: dict[int, int] = {}
        self.last: tuple[int | None, bytes] = (None, b"")
        self.matrix = self.index = None
        self.known: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: list[int], vectors: np.ndarray) -> None:
        for i, v in zip(ids, vectors, strict=True):
            key = v.tobytes()
            held_at = self.at.setdefault(key, len(self.ids))
            if held_at == len(self.ids):
                self.ids.append([])
                self.rows.append(v)
            held = self.ids[held_at]
            if len(held) < 2 * self.k and (len(held) < self.k or held[-self.k] != i):
                held.append(i)
            if self.last[0] == i and self.last[1] != key:
                self.shared[i] = self.shared.get(i, 1) + 1
            self.last = i, key

    def seal(self) -> None:
        self.matrix = np.stack(self.rows).astype(np.int64)
        self.index, self.at, self.rows = BitSlices(self.matrix, self.slices), {}, []

    def search(self, own: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, scores) of the k best rows of other identifiers, nearest first."""
        key = query.tobytes(), self.k + self.shared.get(own, 1)
        if key not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            rows = self.index.top(query.tolist(), key[1])
            self.known[key] = rows, self.matrix[rows] @ query
        rows, exact = self.known[key]
        ids = np.array([i for r in rows for i in self.ids[r]], np.int64)
        scores = np.repeat(exact, [len(self.ids[r]) for r in rows])
        on = ids != own
        ids, scores = ids[on], scores[on]
        order = np.lexsort((ids, -scores))[: self.k]
        return ids[order], scores[order]


def top_products(rows: DataFrame, query_modulus: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``query_modulus`` divides, the ``k`` rows of other ids with the largest inner products of vectors quantised to floor(256 x).

    The search is exact; ties go to the smaller id; fewer than ``k`` candidates give
    fewer results. Vectors that are null, empty or of another length than most, that
    hold null or non-finite components or quantised ones of 2^26 or more (their
    scores might not fit a long), take no part, nor do null ids. Repeated rows are
    candidates each; a repeated query is searched once, by the smallest of its
    vectors. No rows, no results. Other columns are not read.
    """
    spark = rows.sparkSession
    v, bound = F.col("v"), LIMIT / SCALE
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL")
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < bound) & (x >= -bound)))
    rows = materialize(rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("a"), F.monotonically_increasing_id().alias("row")), "slices-rows")
    sizes = rows.groupBy(F.size("a").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_modulus == 0).alias("asked")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]))
    dim, tasks = sizes["dim"], 2 * spark.sparkContext.defaultParallelism
    rows = rows.where(F.size("a") == dim)
    # blocks of rows are of one size; queries are cut finer where there would be fewer cells than tasks
    across = -(-sizes["n"] // block)
    down = max(-(-sizes["asked"] // queries), min(-(-tasks // across), max(sizes["asked"], 1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("id", "a", F.pmod(F.xxhash64("row"), F.lit(across)).cast("int").alias("x"), every(down).alias("y"), F.lit(0).alias("kind"))
    asked = rows.where(F.col("id") % query_modulus == 0).groupBy("id").agg(F.min("a").alias("a"))
    asked = asked.select("id", "a", every(across).alias("x"), F.pmod(F.hash("id"), F.lit(down)).alias("y"), F.lit(1).alias("kind"))
    met = held.unionByName(asked).withColumn("cell", F.col("x").cast("long") * down + F.col("y")).select("cell", "kind", "id", "a")
    met = met.repartition(max(across * down, 1), "cell").sortWithinPartitions("cell", "kind", "id", "a")

    def scan(batches):
        number, now = None, None
        for batch in batches:
            cells, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            vectors = batch.column(3).flatten().to_numpy().reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                if cells[start] != number:
                    number, now = cells[start], Block(k, slices)
                if kinds[start] == 0:
                    now.add(ids[start:stop].tolist(), vectors[start:stop])
                    continue
                if not now.ids:
                    continue  # no rows to search
                if now.index is None:
                    now.seal()
                found = [now.search(i, q) for i, q in zip(ids[start:stop].tolist(), vectors[start:stop].astype(np.int64), strict=True)]
                query = np.repeat(ids[start:stop], [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(scan, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_products(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"), 50)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.a, c.a) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
