import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import topk_search
from quarryline.llm.topk_search import Block


def brute(rows, asks, k):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(64 * x) for x in v]))
    queries = {}
    for i, v in ok:
        if asks(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "k", "scale"), [(150, 8, 20, 1.0), (30, 3, 40, 0.05), (200, 1, 5, 40.0)])
def test_against_brute_force(spark, n, dims, k, scale):
    draw = random.Random(n)
    rows = [(i, [draw.uniform(-scale, scale) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [scale / 2] * dims) for i in range(30)]  # one common vector: many ties
    rows += [(5, None), (None, [0.5] * dims), (7000, [None] * dims), (7001, [math.nan] * dims), (7002, [math.inf] * dims), (10, [0.1] * dims), (3, [0.3] * dims), (8000, [0.0] * dims)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = topk_search.search(df, F.col("id") % 10 == 0, k=k)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0, k)


def test_several_blocks_and_lengths(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(-i % 5), 1.0][: 1 + i % 3]) for i in range(60)]
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk_search, "GROUP_QUERIES", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.search(df, F.col("id") % 5 == 0, k=3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, lambda i: i % 5 == 0, 3)


def test_block_scores_are_exact():
    import numpy as np

    draw = np.random.default_rng(1)
    values = draw.integers(-64, 65, (100, 16))
    block = Block(np.arange(100), Block.pack(values, -64, 8), -64)
    for n in (1, 3, 10):
        queries = draw.integers(-64, 65, (n, 16)) * draw.integers(0, 2, (n, 1))  # some are zero
        for q, (ids, scores) in zip(queries, block.top([7] * n, queries, 100), strict=True):
            want = sorted(((-int(values[i] @ q), i) for i in range(100) if i != 7))
            assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.search(df, F.col("id") % 10 == 0).count() == 0


def test_components_of_any_size(spark):
    """Outliers take part exactly; a score beyond 64 bits is an error."""
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [2e6, 0.0, -1.0, 0.5]), (101, [-(2.0**24), 3.0, 0.0, 0.0]), (110, [0.0, 2.0**30, 1.0, 0.25]), (102, [2.0**-3, 0.0, 0.0, 2.0**40 + 0.25]), (120, [1.5, 0.0, 2.0**36 + 0.5, 0.0]), (103, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk_search.search(df, F.col("id") % 10 == 0, k=9)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0, 9)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|out of bounds|convert"):
        topk_search.search(huge, F.col("id") == 0).collect()


def test_signed_digits():
    import numpy as np

    for kind, most in ((np.int64, 1000), (object, 1 << 80)):
        draw = random.Random(5)
        w = np.array([draw.randint(-most, most) for _ in range(50)] + [0, 1, -1], dtype=kind)
        digits = topk_search.signed_digits(w)
        assert [sum(int(d[i]) << b for b, d in enumerate(digits)) for i in range(len(w))] == w.tolist()
        assert all(not (a & b).any() for a, b in zip(digits, digits[1:], strict=False))
