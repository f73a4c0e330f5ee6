"""Hard-negative mining by threshold joins with a pruned inverted index.

An anchor's positives are the rows of its label with the highest inner products. For each
positive, the hard negatives are the first rows of other labels whose score lies between two
shares of the positive's score. Both are windows over scores that must fill: the ``k`` first
rows of a window, highest score first, smaller id first among equals.

The join finds every (anchor, row) pair that reaches the anchor's threshold, a few rows at a
time. Dimensions stand in a fixed order. A row is indexed up to the first border where the
norm of what follows, times that of any anchor's rest, stays below the threshold: the dimensions
behind it are omitted, since without the indexed ones a pair cannot qualify. Along the lists of the
indexed dimensions partial scores are summed, and a pair is dropped once the norms of both
rests cannot lift it to the threshold, or lower it to the window's top. What is left is
scored exactly.

Thresholds: over a share of the rows they start near a window's top and are lowered step by step
until the window holds k rows or its end is reached. The k-th score found is one that k rows reach,
so the join of all rows at this threshold fills the window; a task raises it further by what
it finds. So few pairs leave a task, however many tasks there are.

Anchors go in blocks of bounded size, broadcast to the tasks; the rows stay where they are. All
scores are exact integers and must fit a long. Rows with a NULL id, label or vector, or a
NULL or non-finite component, take no part; vectors of other lengths count as zero where they
have no component. An anchor's own id is no positive of it. Of several anchor rows of one id the
smallest counts; repeated rows are positives and negatives as often as they occur. Windows with fewer rows give
fewer; anchors without positives, and empty tables, give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm.common import broadcast, slices
from textscore.session import store

#: Anchors of one block, and the bytes their vectors may take.
ANCHORS, ANCHOR_BYTES = 16384, 32 << 20
#: Rows and anchors that meet at once, and dimensions whose lists are summed between two checks.
ROWS, TILE, STEP = 2048, 1024, 8
#: One of so many rows fills the windows at first.
SHARE = 32
#: How far below a window's top the threshold is put, in shares of the window, until it fills.
STEPS = (0.0625, 0.125, 0.25, 0.5, 1.0)
_MOST = np.iinfo(np.int64).max


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` components, cut or filled with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = places < width
    out[rows[good], places[good]] = flat[good]
    return out


class Vectors:
    """Vectors with the norms of what follows each border of the dimensions."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.floats = values.astype(np.float64)
        borders = [*range(0, values.shape[1], STEP), values.shape[1]]
        squares = np.cumsum((self.floats**2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(values), 1))], axis=1)[:, borders]
        # rounding must not make a bound too small
        self.rest = np.sqrt(rest) * (1 + 1e-9)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def some(self, rows: np.ndarray) -> Vectors:
        part = object.__new__(Vectors)
        part.values, part.floats, part.rest, part.largest = self.values[rows], self.floats[rows], self.rest[rows], self.largest
        return part


def reaching(anchors: Vectors, least: np.ndarray, top: np.ndarray, rows: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with a score from the anchor's ``least`` to its ``top``."""
    width = anchors.values.shape[1]
    exact = width * anchors.largest * rows.largest < 2**52
    borders = [*range(0, width, STEP), width]
    # a row's dimensions from the first border on where no anchor's rest can lift it to the threshold are not indexed
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(least[:, None] > 0, least[:, None] / anchors.rest, -np.inf).min(axis=0)
    covered = rows.rest < reach
    covered[:, -1] = True
    depth = covered.argmax(axis=1)
    active = np.argsort(-depth, kind="stable")
    active = active[depth[active] > 0]
    sums = np.zeros((len(least), len(active)))
    found = []
    low, high = least[:, None] * (1 - 1e-12 * np.sign(least[:, None])), top[:, None] * (1 + 1e-12 * np.sign(top[:, None]))
    for place, (start, end) in enumerate(zip(borders, borders[1:], strict=False), 1):
        if not len(active):
            break
        sums += anchors.floats[:, start:end] @ rows.floats[active, start:end].T
        rest = anchors.rest[:, place, None] * rows.rest[None, active, place]
        live = (sums + rest >= low) & (sums - rest <= high)
        done = depth[active] == place
        if done.any():
            one, two = np.nonzero(live[:, done])
            found.append((one, active[done][two]))
        keep = ~done & live.any(axis=0)
        if not keep.all():
            active, sums = active[keep], sums[:, keep]
    one = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
    two = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
    if exact:
        scores = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", anchors.values[one[at : at + 65536]], rows.values[two[at : at + 65536]]) for at in range(0, len(one), 65536))])
    else:
        scores = np.array([sum(int(x) * int(y) for x, y in zip(anchors.values[i], rows.values[j], strict=True)) for i, j in zip(one.tolist(), two.tolist(), strict=True)], np.int64)
    good = (scores >= least[one]) & (scores <= top[one])
    return one[good], two[good], scores[good]


class Windows:
    """Windows over the scores of a block of anchors: ``each`` a piece, of which each keeps its first ``k`` rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.ids, self.labels, self.same, self.k = ids, labels, same, k
        # dimensions in which the anchors are large come first
        self.dimensions = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.vectors = Vectors(values[:, self.dimensions])
        #: Lowest and highest score of each anchor's windows, (anchors, each); an empty window has low above high.
        self.low, self.high = low.astype(np.int64), high.astype(np.int64)
        self.start()

    def start(self) -> None:
        """No rows held."""
        self.scores = np.full((*self.low.shape, self.k), -_MOST)
        self.rows = np.full((*self.low.shape, self.k), _MOST)
        self.count = np.zeros(self.low.shape, np.int64)

    def wanted(self) -> np.ndarray:
        """What a row's score must reach to enter each window."""
        return np.where(self.count >= self.k, np.maximum(self.low, self.scores[..., -1]), self.low)

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put rows into the windows that they belong to."""
        wanted = self.wanted()
        for j in range(self.low.shape[1]):
            fits = (scores >= wanted[anchors, j]) & (scores <= self.high[anchors, j])
            order = np.flatnonzero(fits)
            order = order[np.lexsort((ids[order], -scores[order], anchors[order]))]
            own = anchors[order]
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            order, own, rank = order[rank < self.k], own[rank < self.k], rank[rank < self.k]
            if not len(own):
                continue
            touched, line = np.unique(own, return_inverse=True)
            new = np.full((2, len(touched), self.k), _MOST)
            new[0] = -_MOST
            new[0, line, rank], new[1, line, rank] = scores[order], ids[order]
            both = np.concatenate([self.scores[touched, j], new[0]], axis=1), np.concatenate([self.rows[touched, j], new[1]], axis=1)
            best = np.lexsort((both[1], -both[0]), axis=-1)[:, : self.k]
            self.scores[touched, j], self.rows[touched, j] = (np.take_along_axis(b, best, axis=1) for b in both)
            self.count[touched, j] = np.minimum(self.k, self.count[touched, j] + np.bincount(line, minlength=len(touched)))

    def _meet(self, chosen: np.ndarray, least: np.ndarray, top: np.ndarray, rows: Vectors, ids: np.ndarray, labels: np.ndarray) -> None:
        """Put the rows into the windows of the chosen anchors, as far as scores lie from an anchor's ``least`` to its ``top``."""
        if self.same:  # label by label
            groups = [(chosen[self.labels[chosen] == x], np.flatnonzero(labels == x)) for x in np.intersect1d(self.labels[chosen], labels).tolist()]
        else:
            groups = [(chosen, np.arange(len(ids)))]
        for own, places in groups:
            part = rows.some(places)
            # anchors of like thresholds together, so that more is left out of the index
            own = own[np.argsort(least[own] / np.maximum(self.vectors.rest[own, 0], 1))]
            for at in range(0, len(own), TILE):
                tile = own[at : at + TILE]
                one, two, scores = reaching(self.vectors.some(tile), least[tile], top[tile], part)
                anchors, two = tile[one], places[two]
                good = (labels[two] == self.labels[anchors]) == self.same
                if self.same:
                    good &= ids[two] != self.ids[anchors]
                self.add(anchors[good], scores[good], ids[two][good])

    def fill(self, rows: Vectors, ids: np.ndarray, labels: np.ndarray, steps: tuple[float, ...]) -> None:
        """Meet some rows with all anchors, lowering the thresholds by ``steps`` until each window holds k rows or ends."""
        some = self.low <= self.high
        # what a score can be at all bounds a window that is open at its ends
        most = np.ceil(self.vectors.rest[:, 0] * rows.rest[:, 0].max(initial=0)).astype(np.int64)
        top = np.minimum(np.where(some, self.high, -_MOST).max(axis=1), most)
        bottom = np.maximum(np.where(some, self.low, _MOST).min(axis=1), -most)
        ceiling = top
        for step in steps:
            least = np.where(some, self.wanted(), _MOST).min(axis=1)
            least = np.maximum(np.maximum(least, bottom), top - ((top - bottom) * step).astype(np.int64))
            chosen = np.flatnonzero(some.any(axis=1) & (least <= ceiling))
            if len(chosen):
                self._meet(chosen, least, ceiling, rows, ids, labels)
            # the next step looks at what is below
            ceiling = np.minimum(ceiling, least - 1)


def _fill(rows: DataFrame, windows: Windows, steps: tuple[float, ...]) -> DataFrame:
    """(anchor, piece, rank, score, row): the first k rows of each window."""
    read = broadcast(rows.sparkSession, windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = read()
        own.start()
        for batch in slices(batches, ROWS):
            values = Vectors(matrix(batch.column(2), len(own.dimensions))[:, own.dimensions])
            own.fill(values, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), steps)
        held = np.nonzero(own.scores > -_MOST)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0], held[1], own.scores[held], own.rows[held])], names=["anchor", "piece", "score", "row"])

    found = rows.select("id", "label", "v").mapInArrow(run, "anchor long, piece long, score long, row long")
    order = Window.partitionBy("anchor", "piece").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    held = df.select(*columns).toArrow()
    return [held.column(c).to_numpy() for c in columns]


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold an id, a label and an array of integers. A negative's score lies
    between ``low`` and ``high`` percent of the positive's, both included.
    """
    spark = rows.sparkSession
    given = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v")).where("id is not null and label is not null and v is not null and forall(v, x -> x is not null)")
    rows, asked = given(rows), given(anchors)
    asked = asked.groupBy("id").agg(F.min(F.struct("label", "v")).alias("it")).select("id", "it.label", "it.v")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    blocks = max(1, -(-size.n // max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(1, size.width))))))
    share = rows.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)

    def full(windows: Windows) -> DataFrame:
        """The first k rows of each window, after a share of the rows has told where to begin."""
        anchor, piece, score = _arrays(_fill(share, windows, STEPS).where(F.col("rank") == windows.k), "anchor", "piece", "score")
        windows.low[anchor, piece] = np.maximum(windows.low[anchor, piece], score)
        return _fill(rows, windows, (1.0,))

    found = []
    for block in range(blocks):
        # the driver sees one bounded block of anchors at a time
        own = asked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        ids, labels = (own.column(c).to_numpy() for c in ("id", "label"))
        values = matrix(own.column("v").combine_chunks(), size.width)
        ends = np.full((len(ids), 1), _MOST)
        anchor, rank, score, row = _arrays(full(Windows(ids, labels, values, True, -ends, ends, positives)), "anchor", "rank", "score", "row")
        shape = (len(ids), positives)
        lowest, highest, score_of, id_of = np.ones(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        place = anchor, rank - 1
        score_of[place], id_of[place] = score, row
        lowest[place], highest[place] = -(-low * score // 100), high * score // 100
        result = full(Windows(ids, labels, values, False, lowest, highest, negatives))
        line, column = np.nonzero(np.isin(np.arange(shape[0] * shape[1]), anchor * positives + rank - 1).reshape(shape))
        names = pa.table({"anchor": line, "piece": column, "anchor_id": ids[line], "positive_id": id_of[line, column], "positive_score": score_of[line, column]})
        # as many rows as the block has windows, so small enough to broadcast
        named = result.join(F.broadcast(spark.createDataFrame(names)), ["anchor", "piece"])
        named = named.select("anchor_id", "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.append(named if blocks == 1 else store(named, "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, found)
