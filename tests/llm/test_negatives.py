"""Hard negatives against all pairs; the pruned join against all products."""

import numpy as np
import pytest

from textscore.llm import negatives


def brute(rows, anchors, positives=5, count=10, low=30, high=90):
    """Sorted result rows from all pairs, in plain Python."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    first = {}
    for row in sorted(anchors, key=lambda r: (r[1], r[2])):
        first.setdefault(row[0], row)
    out = []
    for anchor, label, vector in first.values():
        scored = sorted((-dot(vector, v), i, l) for i, l, v in rows)
        chosen = [(i, -s) for s, i, l in scored if l == label and i != anchor][:positives]
        for positive, best in chosen:
            fits = [(i, -s) for s, i, l in scored if l != label and low * best <= -100 * s <= high * best]
            out += [(anchor, positive, rank, i, best, s) for rank, (i, s) in enumerate(fits[:count], 1)]
    return sorted(out)


def found(spark, rows, anchors, *given):
    frame = lambda part: spark.createDataFrame([(*r, "x") for r in part], "id long, label int, vector array<long>, score string")
    return sorted(map(tuple, negatives.mine(frame(rows), frame(anchors), *given).collect()))


@pytest.mark.parametrize(("width", "scale", "least"), [(16, 30, 4000), (30, 5, 40), (7, 9, 0), (3, 4, -20), (9, 10**8, 10**16)])
def test_join_equals_all_products(width, scale, least):
    rng = np.random.default_rng(width)
    rows = rng.integers(-scale, scale + 1, (300, width))
    rows[rng.random(300) < 0.3, width // 2 :] = 0
    anchors = rows[:40]
    scores = anchors.astype(object) @ rows.T.astype(object)
    bottom, top = np.full(40, least), np.full(40, least + max(50, abs(least)))
    one, two, got = negatives.reaching(negatives.Vectors(anchors), bottom, top, negatives.Vectors(rows))
    want = {(i, j, int(scores[i, j])) for i in range(40) for j in range(300) if bottom[i] <= scores[i, j] <= top[i]}
    assert set(zip(one.tolist(), two.tolist(), got.tolist(), strict=True)) == want
    assert len(one) == len(want)


def test_dimensions_are_left_out_of_the_index(monkeypatch):
    """Rows whose rest cannot reach the threshold are not multiplied in those dimensions."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-50, 51, (500, 8)), rng.integers(-1, 2, (500, 56))], axis=1)
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(other.shape)
            return np.asarray(self) @ np.asarray(other)

    anchors = negatives.Vectors(rows[:20])
    anchors.floats = anchors.floats.view(Counted)
    one, two, _ = negatives.reaching(anchors, np.full(20, 3000), np.full(20, 10**9), negatives.Vectors(rows))
    assert seen == [(8, seen[0][1])] and len(one) == int((rows[:20] @ rows.T >= 3000).sum())


@pytest.mark.parametrize(("labels", "spread"), [(3, 40), (1, 40), (40, 40), (2, 3)])
def test_windows_equal_all_pairs(spark, monkeypatch, labels, spread):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "TILE", 3)
    rng = np.random.default_rng(labels + spread)
    vectors = rng.integers(-spread, spread + 1, (400, 10)) + np.arange(10)
    rows = [(i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(vectors)]
    anchors = [r for r in rows if r[0] % 20 == 0]
    assert found(spark, rows, anchors) == brute(rows, anchors)


def test_edge_cases(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 1]), (2, 2, [2, 1]), (3, 2, []), (4, 2, [1]), (5, 1, [0, 0]), (6, 3, [-9, -9]), (7, 3, [1, 1, 9]), (8, 1, [3, 3]), (9, 4, [1, 1])]
    assert found(spark, rows, rows) == brute(rows, rows)
    assert found(spark, rows, rows, 2, 1, 0, 100) == brute(rows, rows, 2, 1, 0, 100)
    missing = [(None, 1, [1, 1]), (11, None, [1, 1]), (12, 1, None), (13, 1, [None, 9])]
    assert found(spark, rows + missing, rows + missing) == brute(rows, rows)
    twice = [(0, 1, [3, 4]), (0, 2, [9, 9])]
    assert found(spark, rows, twice) == brute(rows, twice)
    assert found(spark, rows[:0], rows) == found(spark, rows, rows[:0]) == []
    assert found(spark, rows[:1], rows[:1]) == []
