"""Approximate nearest neighbours by score-aware anisotropic quantisation.

What unit vectors differ by from the nearest of some fine centres is cut into pairs
of components with 16 codewords each. Codes and codewords minimise a loss that
weighs the residual parallel to the vector more than the rest, as that part changes
large inner products. A scan sums, for every row of a block, its centre's inner
product and table entries picked by its four-bit codes (two codes a byte); the rows
at the top of the scan are scored again exactly.

Rows are dealt to cells around centres, and large cells to blocks. A query goes to
the cells nearest to it: so many that nearly all neighbours of a sample's vectors
lie in them (PROBED). Clustered vectors need few; where no cell is nearer than the
others, as among random vectors, a query goes to all, which is a scan of all rows
in blocks. Equal vectors meet in one block and are scanned once, for their
smallest identifiers only, so a crowd of copies costs one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from haploweave.llm._io import materialize, table

#: Inner products above this count most: it sets the weight of the parallel residual.
THRESHOLD = 0.2
#: Codebook and centres are fitted on so many rows at most, by hash of the identifier.
SAMPLE = 20_000
CODEWORDS, WIDTH = 16, 2
#: Fine centres at most, and vectors of the sample for each.
FINE, FINE_ROWS = 1 << 10, 16
#: Rows for each cell, and cells at most: their centres are sent to every task.
CELL, CELLS = 1 << 12, 1 << 10
#: The share of a sample's neighbours that lie in the cells a query goes to, and the sample's vectors that are looked at.
PROBED, LOOKED = 0.995, 500
#: Distinct vectors of a block, about.
BLOCK = 1 << 16
#: Of a block, distinct vectors at the top of the scan that are scored exactly: at least, and at most. Between them, as many as hold the share PROBED of neighbours.
RERANK, MOST_RERANK = 64, 1 << 12


def _weights(dim: int) -> float:
    """Extra weight of the parallel residual, against 1 for the rest; none where few components make the threshold no large product."""
    return max((dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2), 1.0) - 1


def _split(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, WIDTH); an odd component is padded with 0."""
    if x.shape[1] % WIDTH:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, WIDTH)


def encode(x: np.ndarray, r: np.ndarray, books: np.ndarray, rounds: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes of ``r``, what is left of unit vectors ``x`` (rows, subspaces, WIDTH) after their centres, each chosen in turn to lessen the loss given the others."""
    n, m, _ = x.shape
    extra = _weights(m * WIDTH)
    if codes is None:
        codes = np.stack([((r[:, s, None] - books[s][None]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    # the error's inner product with the vector
    left = (x * r).sum((1, 2)) - sum((x[:, s] * books[s][codes[:, s]]).sum(1) for s in range(m))
    for _ in range(rounds):
        for s in range(m):
            along = x[:, s] @ books[s].T
            own = along[np.arange(n), codes[:, s]]
            left += own
            cost = (books[s] ** 2).sum(1)[None] - 2 * r[:, s] @ books[s].T + extra * (along**2 - 2 * left[:, None] * along)
            codes[:, s] = cost.argmin(1)
            left -= along[np.arange(n), codes[:, s]]
    return codes


def fit(x: np.ndarray, r: np.ndarray, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces, CODEWORDS, WIDTH) for ``r`` of unit vectors ``x``, by turns of codes and codewords."""
    n, m, _ = x.shape
    rng = np.random.default_rng(seed)
    extra = _weights(m * WIDTH)
    books = np.stack([r[rng.choice(n, CODEWORDS, replace=n < CODEWORDS), s] for s in range(m)])
    for _ in range(rounds):  # plain k-means to start from
        for s in range(m):
            at = ((r[:, s, None] - books[s][None]) ** 2).sum(2).argmin(1)
            count = np.bincount(at, minlength=CODEWORDS)
            for d in range(WIDTH):
                books[s, :, d] = np.where(count, np.bincount(at, r[:, s, d], CODEWORDS) / np.maximum(count, 1), books[s, :, d])
    codes = None
    for _ in range(rounds):
        codes = encode(x, r, books, 1, codes)
        left = (x * r).sum((1, 2)) - sum((x[:, s] * books[s][codes[:, s]]).sum(1) for s in range(m))
        for s in range(m):
            own = (x[:, s] * books[s][codes[:, s]]).sum(1)
            left += own
            for k in range(CODEWORDS):
                on = codes[:, s] == k
                if on.any():
                    y = x[on, s]
                    a = on.sum() * np.eye(WIDTH) + extra * y.T @ y
                    books[s, k] = np.linalg.solve(a, r[on, s].sum(0) + extra * (y * left[on, None]).sum(0))
            left -= (x[:, s] * books[s][codes[:, s]]).sum(1)
    return books


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(v: np.ndarray) -> np.ndarray:
    """Directions in double precision, scaled first so that neither very small nor very large components are lost."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of ``cells`` cells of unit vectors, by spherical k-means."""
    found = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, found)
        total = np.zeros_like(found)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        found = np.where(size > 1e-9, total / np.maximum(size, 1e-9), found)
    return found


def _near(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Inner products, whose last bits don't depend on where a row stands: equal vectors get the same cell."""
    return np.stack([(x * c).sum(1) for c in to], 1) if len(to) else np.zeros((len(x), 0))


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The centre with the largest inner product, in pieces."""
    return np.concatenate([(x[i : i + 4096] @ to.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def probes(x: np.ndarray, to: np.ndarray, k: int) -> int:
    """How many cells, nearest first, hold the share PROBED of the sample's ``k`` nearest neighbours."""
    own = _near(x, to).argmax(1)
    ranks = []
    for i in range(0, len(x), -(-len(x) // LOOKED)):
        near = x @ x[i]
        near[i] = -np.inf
        order = np.argsort(-_near(x[i : i + 1], to)[0], kind="stable")
        place = np.empty(len(to), np.int64)
        place[order] = np.arange(len(to))
        ranks += place[own[np.argpartition(-near, min(k, len(x) - 1))[:k]]].tolist()
    return int(np.quantile(ranks, PROBED, method="higher")) + 1 if ranks else len(to)


def depth(x: np.ndarray, fine: np.ndarray, books: np.ndarray, k: int, count: int) -> int:
    """How many vectors at the top of a scan of ``count`` hold the share PROBED of the ``k`` nearest, as ranks in a scan of the sample tell."""
    at = _nearest(x, fine)
    codes, ranks = encode(_split(x), _split(x - fine[at]), books), []
    for i in range(0, len(x), -(-len(x) // (LOOKED // 4))):
        entries = np.einsum("skw,sw->sk", books, _split(x[i : i + 1])[0]).astype(np.float32)
        scan = (fine @ x[i]).astype(np.float32)[at]
        for s in range(len(entries)):
            scan += entries[s][codes[:, s]]
        near = x @ x[i]
        near[i], scan[i] = -np.inf, -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1))[:k]
        ranks += [int((scan > scan[j]).sum()) + 1 for j in best if j != i]
    found = np.quantile(ranks, PROBED, method="higher") * max(1.0, count / len(x)) if ranks else 0
    return int(min(max(found, RERANK), MOST_RERANK))


def _wanted(held: list[int], row: int, k: int, keep: int) -> bool:
    """Whether one identifier more, in order, can be in a result: of repeated rows k at most."""
    return len(held) < keep and (len(held) < k or held[-k] != row)


class Block:
    """The distinct vectors of one block with their smallest identifiers, and the scan of queries over them.

    Rows come in order of identifier; of equal vectors the first ``keep`` identifiers
    are held, as no query's result needs more.
    """

    def __init__(self, fine: np.ndarray, books: np.ndarray, k: int, keep: int, rerank: int):
        self.fine, self.books, self.k, self.keep, self.rerank = fine, books, k, keep, max(rerank, keep)
        self.at: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.vectors = self.codes = self.centre = None

    def add(self, ids: list[int], vectors: np.ndarray, codes: list[bytes]) -> None:
        new = []
        for i, (row, v) in enumerate(zip(ids, vectors, strict=True)):
            at = self.at.setdefault(v.tobytes(), len(self.ids))
            if at == len(self.ids):
                self.ids.append([row])
                new.append(i)
            elif _wanted(held := self.ids[at], row, self.k, self.keep):
                held.append(row)
        if new:
            self.rows.append((vectors[new], np.frombuffer(b"".join(codes[i] for i in new), np.uint8).reshape(len(new), -1)))

    def seal(self) -> None:
        self.vectors = np.concatenate([v for v, _ in self.rows])
        codes = np.concatenate([c for _, c in self.rows])
        self.centre = np.ascontiguousarray(codes[:, :2]).view("<u2").ravel()
        self.codes = np.ascontiguousarray(codes[:, 2:].T)
        self.at, self.rows = {}, []

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, scores) of the ``keep`` best of those at the top of the scan."""
        entries = np.einsum("skw,sw->sk", self.books, _split(query[None])[0]).astype(np.float32)
        if len(entries) % 2:
            entries = np.vstack([entries, np.zeros((1, CODEWORDS), np.float32)])
        near = (self.fine @ query).astype(np.float32)[self.centre]
        for j in range(len(self.codes)):
            near += (entries[2 * j][None, :] + entries[2 * j + 1][:, None]).ravel()[self.codes[j]]
        at = np.argpartition(-near, self.rerank)[: self.rerank] if len(near) > self.rerank else np.arange(len(near))
        exact = (_units(self.vectors[at]) * query).sum(1)  # row by row: equal vectors score equal
        ids = np.array([i for a in at for i in self.ids[a]], np.int64)
        scores = np.repeat(exact, [len(self.ids[a]) for a in at])
        order = np.lexsort((ids, -scores))[: self.keep]
        return ids[order], scores[order]


def _valid(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows whose vector takes part, the vectors' length (that of most rows, the smaller of equals), and how many."""
    v = F.col("v")
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, count = (most["dim"], most["count"]) if most else (0, 0)
    return rows.where(F.size("v") == dim), dim, count


def search(rows: DataFrame, query_modulus: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int | None = None, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found by cosine for each row whose id ``query_modulus`` divides.

    A row's candidates are all rows with another id; fewer than ``k`` give fewer
    results. Scores are cosines of the original vectors in double precision; equal
    vectors score equal, and ties go to the smaller id. Vectors that are null,
    empty, zero or of another length than most, or hold null or non-finite
    components, take no part, nor do null ids. Repeated rows are candidates each;
    a repeated query is searched once, by the smallest of its vectors. No rows, no
    results. Other columns are not read.
    """
    spark = rows.sparkSession
    held_as = rows.schema[vector_col].dataType
    kind = "array<float>" if isinstance(held_as, T.ArrayType) and isinstance(held_as.elementType, T.FloatType) else "array<double>"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id IS NOT NULL")
    rows, dim, count = _valid(rows)
    empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not dim:
        return spark.createDataFrame([], empty)
    asked = F.col("id") % query_modulus == 0
    # a query's own rows are left out of its results: of each of its vectors k at most, as no more repeated rows are held
    keep = k + k * (rows.where(asked).groupBy("id").agg(F.countDistinct(F.xxhash64("v")).alias("n")).agg(F.max("n")).first()[0] or 0)
    # hashes thin the rows before the order does, so that few rows meet in the order
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= (2 << 20) * SAMPLE // count)
    sample = _units(_matrix(some.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), dim))
    fine = centres(sample, min(FINE, -(-len(sample) // FINE_ROWS)), rounds=4)
    books, to = fit(_split(sample), _split(sample - fine[_nearest(sample, fine)])), centres(sample, min(CELLS, -(-count // cell)))
    reach, rerank = probes(sample, to, k), rerank or depth(sample, fine, books, k, count)

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            keys, taken = [v.tobytes() for v in vectors], {}
            # of a batch's equal vectors, the smallest identifiers are candidates
            is_candidate, is_query = np.zeros(len(ids), bool), ids % query_modulus == 0
            for i in np.argsort(ids, kind="stable").tolist():
                held = taken.setdefault(keys[i], [])
                if _wanted(held, ids[i], k, keep):
                    held.append(ids[i])
                    is_candidate[i] = True
            kept = np.flatnonzero(is_candidate | is_query)
            units = _units(vectors[kept])
            own = _nearest(units, fine)
            codes = encode(_split(units), _split(units - fine[own]), books).astype(np.uint8)
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            packed = np.hstack([own.astype("<u2")[:, None].view(np.uint8), codes[:, 0::2] | (codes[:, 1::2] << 4)])
            part = batch.take(pa.array(kept))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in kept), np.int64).reshape(-1, 2)
            columns = [pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(_near(units, to).argmax(1).astype(np.int32)), *(pa.array(digests[:, i].copy()) for i in (0, 1)), pa.array(is_candidate[kept]), pa.array(is_query[kept])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "v", "codes", "cell", "h0", "h1", "is_candidate", "is_query"])

    indexed = materialize(rows.mapInArrow(index, f"id long, v {kind}, codes binary, cell int, h0 long, h1 long, is_candidate boolean, is_query boolean"), "ann-index")
    candidates = indexed.where("is_candidate")
    sizes = {r["cell"]: r["count"] for r in candidates.groupBy("cell").count().collect()}  # at most CELLS rows
    parts = np.array([-(-sizes.get(c, 0) // block) for c in range(len(to))], np.int64)
    firsts = np.concatenate(([0], np.cumsum(parts)[:-1]))
    blocks = int(parts.sum())

    def visit(batches):
        """Queries, once for each block of the cells that they go to."""
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-_near(_units(_matrix(batch.column(0), dim)), to), axis=1, kind="stable")[:, :reach]
            for start in range(0, batch.num_rows, 512):
                cells = order[start : start + 512]
                many = parts[cells]
                row, flat = np.repeat(np.arange(start, start + len(cells)), many.sum(1)), many.ravel()
                nth = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.nulls(len(row), pa.binary()), part.column(2), pa.array(np.repeat(firsts[cells.ravel()], flat) + nth), pa.array(np.ones(len(row), np.int32))], names=["a", "v", "codes", "b", "block", "kind"])

    # equal vectors are searched once: h0 and h1 stand for a query
    queries = indexed.where("is_query").groupBy("h0", "h1").agg(F.first("v").alias("v")).select("v", "h0", "h1").mapInArrow(visit, f"a long, v {kind}, codes binary, b long, block long, kind int")
    dealt = spark.createDataFrame([(c, int(n), int(f)) for c, (n, f) in enumerate(zip(parts, firsts, strict=True))], "cell int, parts long, first long")
    # at most CELLS rows are broadcast; equal vectors are of one block
    held = candidates.join(F.broadcast(dealt), "cell").select(F.col("id").alias("a"), "v", "codes", F.lit(0).cast("long").alias("b"), (F.col("first") + F.pmod("h0", "parts")).alias("block"), F.lit(0).alias("kind"))
    met = held.unionByName(queries).repartition(max(blocks, spark.sparkContext.defaultParallelism), "block").sortWithinPartitions("block", "kind", "a")

    def scan(batches):
        number, now = None, None
        for batch in batches:
            at, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if at[start] != number:
                    number, now = at[start], Block(fine, books, k, keep, rerank)
                vectors = _matrix(part.column("v"), dim)
                if kinds[start] == 0:
                    now.add(part.column("a").to_pylist(), vectors, part.column("codes").to_pylist())
                    continue
                if now.vectors is None:
                    now.seal()
                found = [now.search(q) for q in _units(vectors)]
                row = np.repeat(np.arange(len(found)), [len(ids) for ids, _ in found])
                keys = [part.column(c).take(pa.array(row)) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["h0", "h1", "vec_id", "score"])

    found = met.mapInArrow(scan, "h0 long, h1 long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("h0", "h1").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("at", rank).where(F.col("at") <= keep).groupBy("h0", "h1").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))  # of ``keep`` rows
    members = indexed.where("is_query").groupBy("id").agg(F.min(F.struct("v", "h0", "h1")).alias("q")).select(F.col("id").alias("query_id"), "q.h0", "q.h1")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = members.join(best, ["h0", "h1"]).select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op9_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), 50)
