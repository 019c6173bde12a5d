"""Top products of the bit-sliced index against all products."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haploweave.llm import bit_slices


@given(st.integers(-(1 << 40), 1 << 40))
def test_signed_digits(n):
    digits = bit_slices.signed_digits(n)
    assert sum((-1 if negative else 1) << weight for weight, negative in digits) == n
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:], strict=False))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 9), st.sampled_from([1, 2, 40, 1 << 20]), st.integers(1, 12), st.integers(1, 8), st.integers(0, 1 << 30))
def test_sums_and_tops(rows, dim, scale, slices, k, seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(-scale, scale + 1, (rows, dim))
    index = bit_slices.BitSlices(matrix, slices)
    query = matrix[rng.integers(rows)]
    exact = matrix @ query
    sums, spread = index.sums(query.tolist())
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:rows] for s in sums]).astype(object) if len(sums) else np.zeros((0, rows), object)
    total = sum((b << i for i, b in enumerate(bits)), np.zeros(rows, object))
    gap = exact.astype(object) - total
    assert max(gap) - min(gap) <= spread
    top = index.top(query.tolist(), k)
    kth = np.sort(exact)[-min(k, rows)]
    assert set(np.flatnonzero(exact >= kth).tolist()) <= set(top.tolist())


def plain(rows, modulus, k):
    own = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) and abs(x) < 1 << 18 for x in v)]
    if not own:
        return []
    sizes = [len(v) for _, v in own]
    dim = max(sorted(set(sizes)), key=sizes.count)
    own = [(i, v) for i, v in own if len(v) == dim]
    out = []
    for q in sorted({i for i, _ in own if i % modulus == 0}):
        vector = min(v for i, v in own if i == q)
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), i) for i, v in own if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block,slices", [(64, 2), (1000, 6)])
def test_top_products_by_all_products(spark, block, slices):
    """Among them many copies of one vector, many rows of one identifier, and ties."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 500)] + [(7, [0.5] * 6)] * 100 + [(10, rng.normal(size=6).round(1).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [tuple(r) for r in df.collect()]
    found = bit_slices.top_products(df, 10, block=block, slices=slices, queries=9)
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == plain(rows, 10, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0, 1.0]), (10, [1e-30, -1e-30, 0.0]), (50, [-1e30, 0.0, 0.0]), (100, [-1.0, 0.3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS a", "4 AS row", "5 AS cell")
    found = [tuple(r) for r in bit_slices.top_products(df, 50).orderBy("query_id", "rank").collect()]
    assert found == plain(rows, 50, 5)
    assert {q for q, *_ in found} == {0, 100}
    assert bit_slices.top_products(df.where("false"), 50).count() == 0
    assert bit_slices.top_products(df.where("vec_id = 0"), 50).count() == 0
