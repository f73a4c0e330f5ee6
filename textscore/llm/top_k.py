"""Exact top-k by inner product: sorted lists read in step, score bounds, no random access.

Items are worked on a few thousand at a time. Each dimension is a list of them sorted by value, read from the
end that suits the sign of a query's component, all lists in step. Of an item the entries read so far
give a lower bound, with the far end of every list where it has not come up yet, and an upper one, with the
list's current value there. The border is the k-th best lower bound, or the k-th best score that the task has found
so far if that is higher. Reading stops for an item once its upper bound is below the border: it cannot qualify.
Once few items of a query are left, the lists are read to their end for those alone, which resolves their
scores. Bounds are looked at in steps of an eighth of the lists, from the step on at which they told something
the time before.

Queries go in blocks of bounded size, broadcast to the tasks; items stay where they are. A share of the items
gives each query a score that k items reach; the pass over all items begins with it as border, so a task
returns few rows however many tasks there are. The tasks' winners meet in one ranking by query.

All scores are exact integers. Vectors that are NULL or hold a NULL or non-finite component
take no part; of vectors of different lengths, missing components count as zero. A query's
own id is no candidate. Ties go to the smaller id. Of several query rows of one id the
smallest vector counts; repeated items are candidates as often as they occur. Fewer than k
candidates give fewer rows; an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm.common import broadcast, slices
from textscore.session import store

#: Items of one block, and queries compared with it at once.
ITEMS, QUERIES = 4096, 1024
#: Queries of one broadcast, and the bytes that their vectors may take.
BLOCK, BLOCK_BYTES = 65536, 32 << 20
#: Share of a block's scores that may be left open when the lists are read to their end.
OPEN_SHARE = 0.05
#: Steps in which the lists are read.
STEPS = 8
#: One of so many items gives the borders to begin with.
SHARE = 32
_MOST = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def floored(vector: Column, factor: int) -> Column:
    """The components times ``factor``, rounded down, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` components, cut or filled with zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows[places < width], places[places < width]] = flat[places < width]
    return out


class Lists:
    """A block of items as sorted lists, one per dimension."""

    def __init__(self, ids: np.ndarray, items: np.ndarray) -> None:
        self.ids, self.items, self.n = ids, items, len(items)
        self.sorted = np.sort(items, axis=0)
        self.largest = float(np.abs(items).max(initial=0))

    def bounds(self, queries: np.ndarray, depth: int, kind: type, lower: bool) -> np.ndarray:
        """An upper, or a lower, bound of each item's score for each query, ``depth`` entries of every list being read."""
        up, down = self.sorted[self.n - depth], self.sorted[depth - 1]  # what the two ends of each list have come to
        plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        if lower:  # where an item has not come up, it may be the last of the list
            high = np.where(self.items >= up, self.items, self.sorted[0])
            low = np.where(self.items <= down, self.items, self.sorted[-1])
        else:
            high, low = np.maximum(self.items, up), np.minimum(self.items, down)
        return plus @ high.T.astype(kind) + minus @ low.T.astype(kind)


class Best:
    """The k best items of each query so far, and the score that an item must reach to be one."""

    def __init__(self, queries: int, k: int, border: np.ndarray | None = None) -> None:
        self.k = k
        self.scores, self.ids = np.full((queries, k), -_MOST), np.full((queries, k), _MOST)
        self.border = np.full(queries, -_MOST) if border is None else border.copy()
        self.step = STEPS // 2
        self.read = 0

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put in candidates, given as one row per query and item."""
        order = np.flatnonzero(scores >= self.border[query])
        order = order[np.lexsort((ids[order], -scores[order], query[order]))]
        own = query[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        order, own, rank = order[rank < self.k], own[rank < self.k], rank[rank < self.k]
        touched, line = np.unique(own, return_inverse=True)
        new_scores, new_ids = np.full((len(touched), self.k), -_MOST), np.full((len(touched), self.k), _MOST)
        new_scores[line, rank], new_ids[line, rank] = scores[order], ids[order]
        both = np.concatenate([self.scores[touched], new_scores], axis=1), np.concatenate([self.ids[touched], new_ids], axis=1)
        best = np.lexsort((both[1], -both[0]), axis=-1)[:, : self.k]
        self.scores[touched], self.ids[touched] = (np.take_along_axis(x, best, axis=1) for x in both)
        self.border[touched] = np.maximum(self.border[touched], self.scores[touched, -1])


def read_lists(lists: Lists, chosen: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Read a block's lists for the chosen queries and put what they find into ``best``."""
    n, width, wanted = lists.n, lists.items.shape[1], queries[chosen]
    largest = max(1, width) * lists.largest * float(np.abs(wanted).max(initial=0))
    # sums of so large integers are exact in this type; beyond, the lists are read to their end at once
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else None
    able, step = np.ones((len(chosen), n), bool), best.step if kind is not None else STEPS
    while step < STEPS and n > best.k + 1:
        depth = max(1, n * step // STEPS)
        border = best.border[chosen]
        if (border == -_MOST).any():
            # the k-th best lower bound, the query's own item and repeats of it left out
            low = lists.bounds(wanted, depth, kind, True).astype(np.float64)
            low[lists.ids[None, :] == query_ids[chosen][:, None]] = -np.inf
            border = np.maximum(border, np.partition(low, n - best.k, axis=1)[:, n - best.k])
        able = lists.bounds(wanted, depth, kind, False) >= border[:, None]
        if able.mean() <= OPEN_SHARE:
            break
        step += 1
    best.step = max(1, min(step, STEPS - 1))
    # to the end of the lists, for the open items alone
    line, place = np.nonzero(able)
    best.read += n * width * min(step, STEPS) // STEPS * len(chosen) + len(line) * width * (STEPS - min(step, STEPS)) // STEPS
    other = lists.ids[place] != query_ids[chosen][line]
    line, place = line[other], place[other]
    for at in range(0, len(line), 1 << 16):
        some, spot = line[at : at + (1 << 16)], place[at : at + (1 << 16)]
        best.add(chosen[some], np.einsum("ij,ij->i", wanted[some], lists.items[spot]), lists.ids[spot])


def block_winners(ids: np.ndarray, items: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (places, scores) of its k best items, in order; ``ids`` must differ."""
    best, lists = Best(len(queries), k), Lists(ids, items)
    read_lists(lists, np.arange(len(queries)), query_ids, queries, best)
    order = np.argsort(ids)
    out = []
    for scores, found in zip(best.scores, best.ids, strict=True):
        good = scores > -_MOST
        out.append((order[np.searchsorted(ids[order], found[good])], scores[good]))
    return out


def _winners(items: DataFrame, read, k: int) -> DataFrame:
    """(query, rank, id, score): the k best items of each query of a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, border = read()
        best = Best(len(queries), k, border)
        for batch in slices(batches, ITEMS):
            lists = Lists(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), queries.shape[1]))
            for at in range(0, len(queries) if lists.n else 0, QUERIES):
                read_lists(lists, np.arange(at, min(at + QUERIES, len(queries))), query_ids, queries, best)
        query, place = np.nonzero(best.scores > -_MOST)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(best.ids[query, place]), pa.array(best.scores[query, place])], names=["query_id", "id", "score"])

    found = items.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(items: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): the k items with the largest inner product, for each query.

    Both tables hold an id and an array of integers.
    """
    spark = items.sparkSession
    given = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).where("id is not null and v is not null")
    items, queries = given(items), given(queries)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    blocks = max(1, -(-size.n // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, size.width))))))
    share = items.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)
    found = []
    for block in range(blocks):
        # the driver sees one bounded block of queries at a time
        own = queries.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        ids, vectors = own.column("id").to_numpy(), _matrix(own.column("v").combine_chunks(), size.width)
        border = np.full(len(ids), -_MOST)
        reached = _winners(share, broadcast(spark, (ids, vectors, border)), k).where(F.col("rank") == k).toArrow()
        order = np.argsort(ids)
        border[order[np.searchsorted(ids[order], reached.column("query_id").to_numpy())]] = reached.column("score").to_numpy()
        winners = _winners(items, broadcast(spark, (ids, vectors, border)), k)
        found.append(winners if blocks == 1 else store(winners, "winners"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, id long, score long")
