"""Components in one block and in rounds over many, against a plain search."""

import numpy as np
import pytest

from textscore.llm import components


def plain(edges):
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return least


def test_stars():
    rng = np.random.default_rng(1)
    for nodes, count in ((5, 3), (300, 200), (300, 900), (2000, 1900)):
        edges = rng.integers(-nodes, nodes, (count, 2))
        got = dict(zip(*(x.tolist() for x in components.stars(edges[:, 0], edges[:, 1])), strict=True))
        assert got == plain(edges.tolist())
    line = np.arange(5000)
    assert (components.stars(line[1:], line[:-1])[1] == 0).all()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_blocks_and_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(components, "EDGES", block)
    rng = np.random.default_rng(block)
    edges = [*rng.integers(0, 250, (150, 2)).tolist(), *([i, i + 1] for i in range(1000, 1060)), [7, 7], [1, 2], [2, 1], [5000, -3]]
    frame = spark.createDataFrame([tuple(e) for e in edges], "a long, b long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {n: c for n, c in plain([e for e in edges if e[0] != e[1]]).items()}
    assert components.components(frame.limit(0)).collect() == []
