"""Connected components: blocks of edges by themselves, then stars by a grouped minimum and a join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textscore.session import store

#: Edges that one task connects by itself.
EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node of the edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[one], least[two]), np.maximum(least[one], least[two])
        if (low == high).all():
            return nodes, nodes[least]
        np.minimum.at(least, high, low)
        while not (least == least[least]).all():
            least = least[least]


def _connected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches]
    if held:
        nodes, least = stars(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge touches; component is the smallest node reachable.

    ``edges`` has LONG columns a and b, in any direction; loops and repeated edges do no harm.
    Blocks of at most about ``EDGES`` edges are connected each in a task, which leaves stars; one block
    is done then. Of several, each round links every node's neighbours and the node itself to the smallest of
    them, which keeps what is connected connected and shortens the longest path by half or
    more, until only stars are left. A node's minimum is combined before the shuffle, and the
    join of a node with many neighbours is split by AQE. Every round's edges are written to
    the shared folder, so that a lost executor costs one round.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    given = store(edges.where(a != b).select("a", "b"), "edges")
    blocks = -(-given.count() // EDGES)
    if blocks <= 1:
        return given.coalesce(1).mapInArrow(_connected, "node long, component long")
    now = store(given.repartition(blocks).mapInArrow(_connected, "a long, b long").where(a != b).distinct(), "edges")
    while not now.isEmpty():
        both = now.union(now.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        seen = Observation()
        # in a star, a leaf's smallest neighbour is its only one, and the centre's is itself
        moves = both.join(least, a == F.col("n")).observe(seen, F.count_if(m != F.least(a, b)).alias("open"))
        linked = moves.select(b.alias("a"), m.alias("b")).union(least.select(F.col("n"), m)).where(a != b).distinct()
        after = store(linked, "edges")
        if not seen.get["open"]:
            break
        now = after
    return now.select(a.alias("node"), b.alias("component")).union(now.select(b, b)).distinct()
