"""Top-k by sorted lists against all products."""

import numpy as np
import pytest

from textscore.llm import top_k


def brute(ids, items, query_ids, queries, k):
    out = []
    for q, vector in zip(query_ids, queries, strict=True):
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(vector, item))), int(i)) for i, item in zip(ids, items, strict=True) if i != q)
        out += [(int(q), rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "scale"), [(900, 6, 20), (900, 3, 2), (300, 8, 10**6), (200, 4, 10**9), (15, 5, 9), (1, 2, 3)])
def test_block_equals_all_products(n, width, scale):
    rng = np.random.default_rng(n + width)
    items = rng.integers(-scale, scale + 1, (n, width))
    ids = rng.permutation(n) * 2
    own = rng.choice(n, min(n, 25), replace=False)
    got = top_k.block_winners(ids, items, ids[own], items[own], 20)
    rows = sorted((int(ids[q]), rank, int(ids[p]), int(s)) for q, (places, scores) in zip(own, got, strict=True) for rank, (p, s) in enumerate(zip(places, scores, strict=True), 1))
    assert rows == brute(ids, items.tolist(), ids[own], items[own].tolist(), 20)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(8)
    items, queries = rng.integers(-20, 21, (80, 7)), rng.integers(-9, 10, (12, 7))
    lists, exact = top_k.Lists(np.arange(80), items), queries @ items.T
    last = None
    for depth in range(1, 81):
        low, high = (lists.bounds(queries, depth, np.float64, lower) for lower in (True, False))
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or ((low >= last[0]).all() and (high <= last[1]).all())
        last = low, high
    assert (last[0] == exact).all() and (last[1] == exact).all()


def test_reading_stops_before_the_end(spark):
    """With a border at hand, fewer entries are read than the lists hold, and the winners are the same."""
    rng = np.random.default_rng(9)
    items = np.concatenate([rng.integers(-20, 21, (2000, 8)), rng.integers(60, 90, (30, 8))])
    lists, queries, ids = top_k.Lists(np.arange(len(items)), items), rng.integers(1, 9, (40, 8)), np.arange(10**6, 10**6 + 40)
    best = top_k.Best(40, 20)
    for _ in range(2):  # the second block has the first one's border
        top_k.read_lists(lists, np.arange(40), ids, queries, best)
    assert best.read < 0.8 * 2 * items.size * 40
    assert (best.scores[:, 0] == (queries @ items.T).max(axis=1)).all()


def test_blocks_on_spark(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 30)
    monkeypatch.setattr(top_k, "ITEMS", 150)
    monkeypatch.setattr(top_k, "QUERIES", 20)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (700, 4))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "id long, vector array<long>, score string")
    got = sorted(map(tuple, top_k.top_k(items, items.where("id % 10 = 0"), 7).collect()))
    own = np.arange(0, 700, 10)
    assert got == brute(np.arange(700), vectors.tolist(), own, vectors[own].tolist(), 7)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [-0.01, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan]), (5, [inf]), (6, []), (7, [1.0]), (7, [1.0]), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(top_k.usable(top_k.F.col("embedding")))
    whole = frame.select(top_k.F.col("vec_id").alias("id"), top_k.floored(top_k.F.col("embedding"), 64).alias("vector"))
    assert whole.where("id = 1").first().vector == [-1, 32]
    got = sorted(map(tuple, top_k.top_k(whole, whole.where("id in (0, 7)"), 20).collect()))
    assert got == [(0, 1, 7, 2048), (0, 2, 7, 2048), (0, 3, 1, 992), (0, 4, 6, 0), (7, 1, 0, 2048), (7, 2, 6, 0), (7, 3, 1, -64)]
    assert top_k.top_k(whole.limit(0), whole, 3).collect() == []
    assert top_k.top_k(whole, whole.limit(0), 3).collect() == []
