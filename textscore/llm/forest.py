"""Near-duplicate vectors by a forest of random-projection trees.

Vectors whose cosine is ``least`` or more are linked; a class is what links connect.

1. Vectors that nearly coincide fold into balls about their mean, in rounds: within chunks of
   the same tree leaf, then the balls found among each other. A ball's angle stays under half
   that of a link, so all its members are linked to each other and need not be compared or
   listed pair by pair.
2. Crowds, more than ``LEAF`` balls within a link's angle of one centre, are not split: all
   that can be linked to a crowd's balls meets them in blocks dealt over tasks, which return
   counts and a spanning set of links, not pairs. Nothing is missed there; the cost is the
   square of a crowd.
3. Trees split the other centres by random directions at the median; what lies near a split
   goes to both sides (spill), at least about half a link's length to each side. A set that
   such a split hardly makes smaller stays whole. The upper splits are fitted on a sample and
   deal the rows out; below them each task goes on splitting its own rows. Within a leaf all
   centres are compared, by matrix products.
4. The angle between two centres and the balls' angles tell whether all members are linked,
   none, or some. Only in the last case members are compared, in blocks.

Every row is indexed and every link found is checked in double precision, so no link below
``least`` is ever made; a link can only be missed outside crowds, if every tree parts its two
vectors.

Vectors that are NULL, zero, or hold a NULL or non-finite component, and rows with a NULL
id, are linked with nothing. Vectors of different lengths are compared as if the shorter
had zeros behind. Rows with one id are one vector, the smallest. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.components import components
from textscore.llm.top_k import usable
from textscore.llm.common import broadcast
from textscore.session import store

TREES = 6
#: Vectors that the upper splits are fitted on, about, and rows of a task that they aim at.
SAMPLE, TASK = 16_384, 4096
#: Centres of a leaf, and half the width of the strip that goes to both sides, in standard deviations.
LEAF, SPILL = 256, 0.25
#: Least half width of that strip, as a share of a link's length, and the share of a set that a side may keep.
STRIP, SIDE = 0.56, 0.7
#: Balls of a crowd wider than this share of a link's angle are taken apart; the fewest of a sample that show a crowd.
WIDE, SHOWN = 0.1, 8
#: Largest angle of a ball, as a share of the angle of a link; under a half, so that all members are linked.
BALL = 0.49
#: Vectors of a chunk when balls are formed, and members compared at once.
CHUNK = 2048
_SEED = 20_240_229


def strip_of(at: np.ndarray, angle: float) -> float:
    """Half the width of the strip that goes to both sides of a split of ``at``, for links of ``angle``."""
    return max(SPILL * at.std(), STRIP * 2 * np.sin(min(angle, np.pi) / 2))


def pays(at: np.ndarray, middle: float, strip: float) -> bool:
    """Whether comparing both sides of a split costs less than comparing all."""
    return max((at <= middle + strip).sum(), (at > middle - strip).sum()) <= SIDE * len(at)


class Tree:
    """The upper splits of one tree, as a complete binary tree in an array."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, angle: float = 0.0) -> None:
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.standard_normal(((1 << depth) - 1, sample.shape[1]))
        self.middle, self.strip = np.zeros((1 << depth) - 1), np.zeros((1 << depth) - 1)
        inside = {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            rows = inside.pop(node)
            at = sample[rows] @ self.directions[node]
            if len(rows):
                self.middle[node], self.strip[node] = np.median(at), strip_of(at, angle)
                if angle and not pays(at, self.middle[node], self.strip[node]):
                    self.middle[node] = np.inf  # all go left
            inside[2 * node + 1], inside[2 * node + 2] = rows[at <= self.middle[node]], rows[at > self.middle[node]]

    def leaves(self, vectors: np.ndarray, spill: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every vector; with ``spill``, several leaves for those near a split."""
        rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            at = np.einsum("nd,nd->n", vectors[rows], self.directions[nodes]) - self.middle[nodes]
            strip = self.strip[nodes] if spill else 0.0
            left, right = at <= strip, at > -strip if spill else at > 0
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes


def leaf_pairs(vectors: np.ndarray, reach: np.ndarray, angle: float, seed: int) -> set[tuple[int, int]]:
    """Pairs (i < j) of rows that share a leaf and may be linked, after splitting down to small leaves.

    ``reach`` is each row's ball angle: centres up to ``angle`` and both reaches apart count.
    """
    rng, found = np.random.default_rng(seed), set()
    open_ = [np.arange(len(vectors))]
    while open_:
        rows = open_.pop()
        if len(rows) > LEAF:
            at = vectors[rows] @ rng.standard_normal(vectors.shape[1])
            middle, strip = np.median(at), strip_of(at, angle + 2 * reach[rows].mean())
            if pays(at, middle, strip):
                open_ += [rows[at <= middle + strip], rows[at > middle - strip]]
                continue
        # rows that no split parts are compared in blocks, however many they are
        for a in range(0, len(rows), CHUNK):
            for b in range(a, len(rows), CHUNK):
                one, two = rows[a : a + CHUNK], rows[b : b + CHUNK]
                border = np.cos(np.minimum(angle + reach[one][:, None] + reach[two][None, :], np.pi))
                i, j = np.nonzero(vectors[one] @ vectors[two].T >= border - 1e-9)
                found.update((x, y) for x, y in zip(one[i].tolist(), two[j].tolist(), strict=True) if x < y)
    return found


def _units(binary: Iterable[bytes]) -> np.ndarray:
    rows = [np.frombuffer(x, np.float64) for x in binary]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = row
    return out


def _wide(units: np.ndarray, width: int) -> np.ndarray:
    """``units`` cut or filled with zeros to ``width``."""
    return units[:, :width] if units.shape[1] >= width else np.pad(units, ((0, 0), (0, width - units.shape[1])))


def _normalised(vectors: DataFrame) -> DataFrame:
    """(id, unit binary): vectors at length one in double precision, zero ones left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, units = [], []
            for i, vector in enumerate(batch.column(1).to_pylist()):
                one = np.array(vector, np.float64)
                top = np.abs(one).max(initial=0)
                if top > 0:
                    one = one / top  # squares neither overflow nor vanish
                    kept.append(i)
                    units.append((one / np.sqrt(one @ one)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(units, pa.binary())], names=["id", "unit"])

    return vectors.mapInArrow(run, "id long, unit binary")


def _sample(balls: DataFrame, total: int) -> np.ndarray:
    """The centres of about ``SAMPLE`` balls."""
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return _units(r.unit for r in balls.where(share * total < SAMPLE).select("unit").collect())


def _trees(balls: DataFrame, total: int, task: int, seeds: range, angle: float = 0.0) -> list[Tree]:
    sample = _sample(balls, total)
    depth = max(0, min(int(np.ceil(np.log2(max(1, total) / task))), int(np.log2(max(1, len(sample)) / 32))))
    return [Tree(sample, depth, _SEED + s, angle) for s in seeds]


def _dealt(balls: DataFrame, trees: list[Tree], spill: bool) -> DataFrame:
    """The rows of ``balls`` with tree and leaf."""
    read = broadcast(balls.sparkSession, trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = read()
        for batch in batches:
            units = _units(batch.column("unit").to_pylist())
            for number, tree in enumerate(own):
                rows, leaves = tree.leaves(_wide(units, tree.directions.shape[1]), spill)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(rows), number, np.int32)), pa.array(leaves)], names=[*taken.schema.names, "tree", "leaf"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in balls.schema)
    return balls.mapInArrow(run, f"{fields}, tree int, leaf long")


def _folding(limit: float):
    """For a chunk of balls: (id, into, turn, unit), each ball and the ball that takes it in.

    Balls are tried in the order of their ids; what lies within ``limit`` of one moves its
    centre to their mean, and joins if its own members still lie within ``limit`` of that. A
    ball keeps the smallest id of its members; ``unit`` is the new centre, in that row only.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, reach, size, units = group["id"].to_numpy(), group["reach"].to_numpy(), group["size"].to_numpy(), _units(group["unit"])
        into, turn, free = ids.copy(), np.zeros(len(ids)), np.ones(len(ids), bool)
        centres: list[bytes | None] = [u.tobytes() for u in units]
        near = units @ units.T >= np.cos(limit)
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            if not free[i]:
                continue
            others = np.flatnonzero(near[i] & free)
            mean = (units[others] * size[others, None]).sum(axis=0)
            for centre in (mean / np.sqrt(mean @ mean), units[i]):
                angles = np.arccos(np.clip(units[others] @ centre, -1, 1))
                fits = angles + reach[others] <= limit
                if fits[others == i].all() and fits.sum() > 1:
                    members = others[fits]
                    into[members], turn[members], free[members] = ids[members[0]], angles[fits], False
                    for j in members.tolist():
                        centres[j] = None
                    centres[members[0]] = centre.tobytes()
                    break
        return pd.DataFrame({"id": ids, "into": into, "turn": turn, "unit": centres})

    return fold


def _balls(units: DataFrame, total: int, limit: float) -> tuple[DataFrame, DataFrame, int]:
    """(balls (id, unit, reach, size), members (id, ball), number of balls)."""
    balls = store(units.select("id", "unit", F.lit(0.0).alias("reach"), F.lit(1).cast("long").alias("size")), "balls")
    members = store(units.select("id", F.col("id").alias("ball")), "members")
    step = 0
    while True:
        step += 1
        dealt = _dealt(balls, _trees(balls, total, CHUNK, range(100 * step, 100 * step + 1)), False)
        sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        chunks = dealt.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.lit(step)), F.col("parts")))
        moved = store(chunks.groupBy("leaf", "part").applyInPandas(_folding(limit), "id long, into long, turn double, unit binary"), "moved")
        merged = balls.select("id", "reach", "size").join(moved.drop("unit"), "id").groupBy("into").agg(F.max(F.col("turn") + F.col("reach")).alias("reach"), F.sum("size").alias("size"))
        balls = store(moved.where("id = into").select("id", "unit").join(merged, F.col("id") == F.col("into")).select("id", "unit", "reach", "size"), "balls")
        members = store(members.join(moved.select(F.col("id").alias("ball"), "into"), "ball").select("id", F.col("into").alias("ball")), "members")
        before, total = total, balls.count()
        if total > 0.9 * before or not total:
            return balls, members, total


def _candidates(balls: DataFrame, total: int, angle: float) -> DataFrame:
    """(a, b) with a < b of balls that share a leaf of some tree and whose members may be linked."""
    dealt = _dealt(balls.select("id", "unit", "reach"), _trees(balls, total, TASK, range(TREES), angle), True)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids = group["id"].to_numpy()
        seed = _SEED + 7919 * int(group["tree"].iloc[0]) + int(group["leaf"].iloc[0])
        found = leaf_pairs(_units(group["unit"]), group["reach"].to_numpy(), angle, seed)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return dealt.groupBy("tree", "leaf").applyInPandas(compare, "a long, b long").distinct()


def dense_centres(sample: np.ndarray, angle: float, fewest: int) -> np.ndarray:
    """Means of sets of ``fewest`` or more vectors within ``angle`` of one of them; a vector counts for one set."""
    limit, free = np.cos(angle), np.ones(len(sample), bool)

    def near(rows: np.ndarray) -> np.ndarray:
        """How many of ``rows`` lie near each vector."""
        return sum(((sample @ sample[rows[at : at + LEAF]].T >= limit).sum(axis=1) for at in range(0, len(rows), LEAF)), np.zeros(len(sample), np.int64))

    degree, out = near(np.arange(len(sample))), []
    while free.any():
        i = int(np.argmax(np.where(free, degree, -1)))
        if degree[i] < fewest:
            break
        members = np.flatnonzero(free & ((sample @ sample[i] >= limit) | (np.arange(len(sample)) == i)))
        mean = sample[members].sum(axis=0)
        out.append(mean / np.sqrt(mean @ mean) if mean @ mean > 0 else sample[i])
        free[members] = False
        degree = degree - near(members)
    return np.array(out) if out else np.zeros((0, sample.shape[1]))


def _turns(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The angle of every vector to every centre."""
    return np.arccos(np.clip(_wide(units, centres.shape[1]) @ centres.T, -1, 1))


def _crowds(balls: DataFrame, members: DataFrame, units: DataFrame, total: int, angle: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(balls with their crowd or -1, members, centres of the crowds); wide balls of crowds are taken apart."""
    centres = dense_centres(_sample(balls, total), angle, max(SHOWN, int(LEAF * min(1.0, SAMPLE / max(1, total)))))
    if not len(centres):
        return balls.withColumn("crowd", F.lit(-1)), members, centres
    shared = balls.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = _turns(_units(batch.column("unit").to_pylist()), shared.value)
            nearest = np.where(turns.min(axis=1) <= angle, turns.argmin(axis=1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], names=[*batch.schema.names, "crowd"])

    placed = store(balls.mapInArrow(place, "id long, unit binary, reach double, size long, crowd int"), "placed")
    kept = sorted(r.crowd for r in placed.groupBy("crowd").count().where("crowd >= 0").where(F.col("count") > LEAF).collect())
    if not kept:
        return balls.withColumn("crowd", F.lit(-1)), members, centres[:0]
    # bounded: one entry per centre
    number = F.create_map(*(F.lit(x) for i, c in enumerate(kept) for x in (c, i)))
    placed = placed.withColumn("crowd", F.coalesce(F.try_element_at(number, "crowd"), F.lit(-1)))
    apart = (F.col("crowd") >= 0) & (F.col("reach") > WIDE * angle)
    wide = placed.where(apart).select(F.col("id").alias("ball"), "crowd")
    inner = members.join(wide, "ball").join(units, "id").select("id", "unit", F.lit(0.0).alias("reach"), F.lit(1).cast("long").alias("size"), "crowd")
    singles = members.join(wide, "ball", "left").select("id", F.when(F.col("crowd").isNull(), F.col("ball")).otherwise(F.col("id")).alias("ball"))
    return store(placed.where(~apart).unionByName(inner), "crowds"), store(singles, "members"), centres[kept]


def judge(cosine: np.ndarray, reach: np.ndarray, angle: float, least: float) -> np.ndarray:
    """2: all members of the two balls are linked, 1: some may be, 0: none is; ``reach`` is the sum of both."""
    apart = np.arccos(np.clip(cosine, -1, 1))
    some = np.where(apart + reach <= angle - 1e-9, 2, np.where(apart - reach <= angle + 1e-9, 1, 0))
    return np.where(reach == 0, np.where(cosine >= least, 2, 0), some)


def _spanning(linked: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the first row that links reach; ``linked`` tells which of ``x`` and ``y`` are."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, np.where(linked, label[y][None, :], n).min(axis=1, initial=n))
        np.minimum.at(new, y, np.where(linked, label[x][:, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _crowded(balls: DataFrame, centres: np.ndarray, angle: float, least: float) -> DataFrame:
    """(a, b, n, kind) of all pairs with a ball of a crowd: 0, a has n links; 1, a and b are in one class; 2, some members of a and b may be linked."""
    shared = balls.sparkSession.sparkContext.broadcast(centres)

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("crowd").to_numpy()
            turns = _turns(_units(batch.column("unit").to_pylist()), shared.value)[np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays([batch.column("crowd"), pa.array(turns + batch.column("reach").to_numpy())], names=["crowd", "turn"])

    radius = np.zeros(len(centres))
    for r in balls.where("crowd >= 0").mapInArrow(turn, "crowd int, turn double").groupBy("crowd").agg(F.max("turn").alias("turn")).collect():
        radius[r.crowd] = r.turn

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reach = batch.column("crowd").to_numpy()[:, None], batch.column("reach").to_numpy()[:, None]
            numbers = np.arange(len(radius))[None, :]
            close = _turns(_units(batch.column("unit").to_pylist()), shared.value) <= radius + angle + reach + 1e-9
            # of two crowds the earlier one is host, so that each pair meets once
            rows, hosts = np.nonzero((numbers == own) | close & ((own < 0) | (numbers < own)))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hosts.astype(np.int32))], names=[*taken.schema.names, "host"])

    visits = store(balls.mapInArrow(visit, "id long, unit binary, reach double, size long, crowd int, host int"), "visits")
    sizes = visits.groupBy("host").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = visits.join(F.broadcast(sizes), "host").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, units, reach, size = group["id"].to_numpy(), _units(group["unit"]), group["reach"].to_numpy(), group["size"].to_numpy()
        own, part, low, high = (group["crowd"] == group["host"]).to_numpy(), group["part"].to_numpy(), group["low"].iloc[0], group["high"].iloc[0]
        x, y = np.flatnonzero(part == low), np.flatnonzero(part == high)
        kind = judge(units[x] @ units[y].T, reach[x][:, None] + reach[y][None, :], angle, least)
        kind[~(own[x][:, None] | own[y][None, :])] = 0
        if low == high:
            kind[x[:, None] >= y[None, :]] = 0
        linked = kind == 2
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, x, linked @ size[y])
        np.add.at(n, y, size[x] @ linked)
        label = _spanning(linked, x, y, len(ids))
        counted, joined, (i, j) = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids))), np.nonzero(kind == 1)
        return pd.DataFrame({
            "a": np.concatenate([ids[counted], ids[joined], np.minimum(ids[x[i]], ids[y[j]])]),
            "b": np.concatenate([ids[counted], ids[label[joined]], np.maximum(ids[x[i]], ids[y[j]])]),
            "n": np.concatenate([n[counted], np.zeros(len(joined) + len(i), np.int64)]),
            "kind": np.repeat([0, 1, 2], [len(counted), len(joined), len(i)]),
        })

    return store(spread.drop("parts", "other").groupBy("host", "low", "high").applyInPandas(meet, "a long, b long, n long, kind int"), "crowded")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``."""
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    units = store(_normalised(given.groupBy("id").agg(F.min("v").alias("v"))), "units")
    angle = float(np.arccos(least))
    balls, members, total = _balls(units, units.count(), BALL * angle)
    balls, members, centres = _crowds(balls, members, units, total, angle)
    rest = balls.where("crowd < 0")
    pairs = _candidates(rest, rest.count() if len(centres) else total, angle)
    side = lambda n: balls.select(F.col("id").alias(n), F.col("unit").alias(f"unit_{n}"), F.col("reach").alias(f"reach_{n}"), F.col("size").alias(f"size_{n}"))

    @F.arrow_udf("int")
    def judged(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two, reach_a, reach_b in columns:
            a, b = _units(one.to_pylist()), _units(two.to_pylist())
            width = max(a.shape[1], b.shape[1])
            cosine = np.einsum("nd,nd->n", _wide(a, width), _wide(b, width))
            reach = reach_a.to_numpy(zero_copy_only=False) + reach_b.to_numpy(zero_copy_only=False)
            yield pa.array(judge(cosine, reach, angle, least).astype(np.int32))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    seen = store(both.select("a", "b", "size_a", "size_b", judged("unit_a", "unit_b", "reach_a", "reach_b").alias("all")).where(F.col("all") > 0), "pairs")

    # some members linked: compare them in blocks
    parts = lambda n: F.ceil(F.col(f"size_{n}") / CHUNK).cast("int")
    partly, whole = seen.where("all = 1").select("a", "b", "size_a", "size_b"), seen.where("all = 2")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).union(whole.select("b", "size_a"))
    edges = whole.select("a", "b")
    if len(centres):
        crowded = _crowded(balls, centres, angle, least)
        size = lambda n: balls.select(F.col("id").alias(n), F.col("size").alias(f"size_{n}"))
        partly = partly.union(crowded.where("kind = 2").select("a", "b").join(size("a"), "a").join(size("b"), "b").select("a", "b", "size_a", "size_b"))
        by_ball = by_ball.union(crowded.where("kind = 0").select("a", "n"))
        edges = edges.union(crowded.where("kind = 1").select("a", "b"))
    some = partly.select("a", "b", parts("a").alias("parts_a"), parts("b").alias("parts_b"))
    placed = members.join(units, "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(f"parts_{n}")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"parts_{n}") - 1))
    left = some.join(placed, F.col("a") == F.col("ball")).withColumn("i", own("a")).withColumn("j", all_of("b"))
    right = some.join(placed, F.col("b") == F.col("ball")).withColumn("j", own("b")).withColumn("i", all_of("a"))
    keys = ["a", "b", "i", "j"]

    def count(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "id": [], "n": []}, dtype="int64")
        x, y = _units(one["unit"]), _units(two["unit_right"])
        width = max(x.shape[1], y.shape[1])
        linked = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ np.pad(y, ((0, 0), (0, width - y.shape[1]))).T >= least
        out = pd.DataFrame({"id": [*one["id"], *two["id_right"]], "n": [*linked.sum(axis=1), *linked.sum(axis=0)]})
        out.insert(0, "b", one["b"].iloc[0])
        out.insert(0, "a", one["a"].iloc[0])
        return out[out["n"] > 0]

    columns = [*keys, "id", "unit"]
    # other names on the right: both sides come from the same tables
    right = right.select(*columns).toDF(*(f"{c}_right" for c in columns))
    single = store(left.select(*columns).groupBy(*keys).cogroup(right.groupBy(*(f"{k}_right" for k in keys))).applyInPandas(count, "a long, b long, id long, n long"), "single")

    by_ball = by_ball.groupBy("ball").agg(F.sum("n").alias("to_balls"))
    by_id = single.groupBy("id").agg(F.sum("n").alias("to_members"))
    classes = components(edges.union(single.select("a", "b").distinct()))
    found = (
        members.join(balls.select(F.col("id").alias("ball"), "size"), "ball")
        .join(by_ball, "ball", "left")
        .join(by_id, "id", "left")
        .join(classes.withColumnRenamed("node", "ball"), "ball", "left")
        .select(
            F.col("id").alias("_id"),
            (F.col("size") - 1 + F.coalesce("to_balls", F.lit(0)) + F.coalesce("to_members", F.lit(0))).alias("_links"),
            F.coalesce("component", "ball").alias("_component"),
        )
    )
    named = vectors.select(F.col(key)).join(found, F.col(key).cast("long") == F.col("_id"), "left")
    component = F.coalesce(F.col("_component"), F.col(key).cast("long"))
    return named.select(key, F.coalesce(F.col("_links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(key).cast("long"), F.lit(True)).alias("kept"))
