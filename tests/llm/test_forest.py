"""Projection trees: links and classes against all pairs, in one precision."""

import numpy as np
import pytest

from textscore.llm import forest
from textscore.llm.components import components


def brute(ids, vectors, least=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=len(ids))) for i in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(n), int(ids[c])) for i, n, c in zip(ids, linked.sum(axis=1), label, strict=True)}
        label = new


def found(spark, rows, schema="vec_id long, embedding array<float>"):
    return forest.near_vectors(spark.createDataFrame(rows, schema)).collect()


def test_dense_groups_loose_groups_and_borders(spark):
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((700, 24))]
    for spread in (0.001, 0.02, 0.05, 0.08, 0.12):  # angles from far below a ball's to beyond a link's
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        parts.append(centre + spread * rng.standard_normal((90, 24)))
    vectors = np.concatenate(parts).astype(np.float32)
    vectors = vectors[rng.permutation(len(vectors))]
    ids = np.arange(len(vectors)) * 3
    want = brute(ids, vectors.astype(np.float64))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found(spark, [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)])}
    links = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * links
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99


@pytest.mark.parametrize("cosine", [0.92, 0.95, 0.97])
def test_one_large_group_with_neighbours(spark, cosine):
    rng = np.random.default_rng(11)
    centre = np.eye(64)[0]
    near = centre + np.sqrt((1 / cosine - 1) / 64) * rng.standard_normal((3000, 64))
    vectors = np.concatenate([near, rng.standard_normal((300, 64)), near[:40] + 0.04 * rng.standard_normal((40, 64))])
    want = brute(np.arange(len(vectors)), vectors)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found(spark, list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")}
    assert got == want


def test_splitting_inside_a_task_finds_the_links():
    rng = np.random.default_rng(1)
    one = rng.standard_normal((1500, 16))
    vectors = np.concatenate([one, one + 0.15 * rng.standard_normal(one.shape)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    angle = np.arccos(0.9)
    pairs = set().union(*(forest.leaf_pairs(vectors, np.zeros(len(vectors)), angle, seed) for seed in range(forest.TREES)))
    i, j = np.nonzero(np.triu(vectors @ vectors.T >= 0.9, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    assert pairs <= {(a, b) for a, b in zip(*np.nonzero(np.triu(vectors @ vectors.T >= 0.9 - 1e-6, 1)))}
    assert len(pairs & want) >= 0.98 * len(want)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [], 0), (9, [3.0], 0), (9, [3.0], 0), (None, [1.0, 0.0], 0), (10, [1e-300, 0.0], 0), (11, [1e300, 0.0], 0)]
    got = found(spark, rows, "vec_id long, embedding array<double>, id int")
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == by[9] == by[10] == by[11] == (4, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8)) and by[None] == (0, None, True)
    assert found(spark, [], "vec_id long, embedding array<double>") == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (9, 8), (2, 9)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101)]])
def test_components(spark, edges):
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
