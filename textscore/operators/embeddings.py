"""Principal components of vectors, and 2-Wasserstein distances between groups of them.

All figures come from sums that add up: of every group the count, the sum and the Gramian of
its vectors less a common origin, made by matrix products per Arrow batch and added up row by row of
the matrix, so no task holds more than one row of each partial sum. Vectors that are NULL or
hold a NULL or non-finite component take no part; vectors of different widths raise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, store
from .quantiles import RANGE, ranked

#: Vectors multiplied at once, and the most bytes that all groups' matrices may take.
ROWS, MATRIX_BYTES = 4096, 256 * 1024 * 1024
#: Values of both groups that one task couples, about.
CELL = 200_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _usable(df: DataFrame, vector: str, *columns: Column) -> tuple[DataFrame, int]:
    """(the columns and v array<double>, width) of the rows whose vector takes part."""
    held = df.where(finite(F.col(vector))).select(*columns, F.col(vector).cast("array<double>").alias("v"))
    low, high = held.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors are from {low} to {high} wide")
    return held, high or 0


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Moments:
    """Count, mean and covariance (divisor n - 1) of each group's vectors."""

    groups: list
    count: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray


def moments(df: DataFrame, vector: str, group: str | None = None) -> Moments:
    """The moments of each group, or of the whole table; rows with a NULL group take no part."""
    own = F.col(group) if group else F.lit(0)
    held, width = _usable(df, vector, own.alias("g"))
    held = held.where("g is not null")
    kind = held.schema["g"].dataType.simpleString()
    first = held.first()
    if first is None:
        return Moments([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0, 0)))
    # any vector of the table will do; the sums stay small where it is near the others
    origin = np.array(first.v)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            values = _matrix(batch.column(1), width) - origin
            whole = np.concatenate([np.ones((len(values), 1)), values], axis=1)
            for code, name in enumerate(names):
                part = whole[codes == code]
                total = sums.setdefault(name, np.zeros((width + 1, width + 1)))
                for at in range(0, len(part), ROWS):
                    total += part[at : at + ROWS].T @ part[at : at + ROWS]
        for name, total in sums.items():
            keys = pa.array([name] * (width + 1), kind_)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(width + 1)), pa.array([r.tobytes() for r in total], pa.binary())], names=["g", "i", "line"])

    def add(group_: pa.Table) -> pa.Table:
        lines = np.frombuffer(b"".join(group_.column("line").to_pylist())).reshape(-1, width + 1)
        return pa.table({"g": group_.column("g").slice(0, 1), "i": group_.column("i").slice(0, 1), "line": pa.array([lines.sum(axis=0).tobytes()], pa.binary())})

    kind_ = held.select("g").limit(0).toArrow().schema.field("g").type
    schema = f"g {kind}, i long, line binary"
    added = store(held.mapInArrow(run, schema).groupBy("g", "i").applyInArrow(add, schema), "moments")
    groups = [r.g for r in added.where("i = 0").select("g").orderBy("g").collect()]
    if len(groups) * (width + 1) ** 2 * 8 > MATRIX_BYTES:
        raise ValueError(f"the matrices of {len(groups)} groups take more than {MATRIX_BYTES} bytes")
    place = {g: i for i, g in enumerate(groups)}
    total = np.zeros((len(groups), width + 1, width + 1))
    for r in added.collect():
        total[place[r.g], r.i] = np.frombuffer(r.line)
    n = total[:, 0, 0]
    shift = total[:, 0, 1:] / n[:, None]
    spread = total[:, 1:, 1:] - n[:, None, None] * shift[:, :, None] * shift[:, None, :]
    return Moments(groups, n.astype(np.int64), shift + origin, spread / np.maximum(n - 1, 1)[:, None, None])


@dataclass
class PrincipalComponents:
    """What :func:`fit_components` learned; a row of ``directions`` per component, most variance first."""

    mean: np.ndarray
    directions: np.ndarray
    variance: np.ndarray
    total_variance: float

    def report(self, spark) -> DataFrame:
        """(component, variance, share, cumulative), one row per component."""
        whole = self.total_variance or 1.0
        rows = [(i + 1, float(v), float(v / whole), float(c / whole)) for i, (v, c) in enumerate(zip(self.variance, np.cumsum(self.variance), strict=True))]
        return spark.createDataFrame(rows, "component int, variance double, share double, cumulative double")

    def transform(self, df: DataFrame, vector: str, out: str = "components") -> DataFrame:
        """``df`` with the coordinates of each vector along the components; NULL where a vector takes no part or is of another width."""
        mean, directions = self.mean, self.directions
        fits = finite(F.col(vector)) & (F.size(vector) == len(mean))

        @F.arrow_udf("array<double>")
        def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                values = (_matrix(vectors, len(mean)) - mean) @ directions.T
                ends = np.arange(len(values) + 1, dtype=np.int32) * directions.shape[0]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

        blank = F.array(*[F.lit(0.0)] * len(mean)).cast("array<double>")
        given = F.when(fits, F.col(vector).cast("array<double>")).otherwise(blank)
        return df.withColumn(out, F.when(fits, project(given)))


def fit_components(df: DataFrame, vector: str, k: int | None = None, share: float | None = None) -> PrincipalComponents:
    """The first ``k`` principal components, or as many as explain ``share`` of the variance, or all.

    Of each direction the largest component is positive, so refits agree. One pass over the vectors;
    the matrix solved on the driver is width by width.
    """
    found = moments(df, vector)
    if not found.groups:
        return PrincipalComponents(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    variance, vectors = np.linalg.eigh(found.covariance[0])
    variance, directions = np.maximum(variance[::-1], 0.0), vectors.T[::-1]
    largest = np.take_along_axis(directions, np.abs(directions).argmax(axis=1)[:, None], axis=1)
    directions = directions * np.where(largest < 0, -1.0, 1.0)
    total = float(variance.sum())
    if share is not None:
        k = int(np.searchsorted(np.cumsum(variance), share * total * (1 - 1e-12))) + 1
    k = len(variance) if k is None else min(k, len(variance))
    return PrincipalComponents(found.mean[0], directions[:k], variance[:k], total)


def _root(matrix: np.ndarray) -> np.ndarray:
    """The square root of a symmetric positive semidefinite matrix."""
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T


def gaussian_wasserstein(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """The squared 2-Wasserstein distance of two Gaussians with these moments."""
    half = _root(cov_b)
    cross = np.linalg.eigvalsh(half @ cov_a @ half)
    spread = np.trace(cov_a) + np.trace(cov_b) - 2 * np.sqrt(np.maximum(cross, 0.0)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + max(spread, 0.0))


def _pairs(groups: list, against: object | None) -> list[tuple]:
    if against is not None:
        return [(g, against) for g in groups if g != against] if against in groups else []
    return [(g, h) for i, g in enumerate(groups) for h in groups[i + 1 :]]


def gaussian_distances(df: DataFrame, group: str, vector: str, against: object | None = None) -> DataFrame:
    """(a, b, distance): the 2-Wasserstein distance of every pair of groups, taken as Gaussians.

    With ``against`` only the pairs with that group. Groups of one vector have no spread.
    The pairs are worked out in tasks; all groups' moments are broadcast, their size checked.
    """
    spark, found = df.sparkSession, moments(df, vector, group)
    kind = df.schema[group].dataType.simpleString()
    rows = _pairs(found.groups, against)
    if not rows:
        return spark.createDataFrame([], f"a {kind}, b {kind}, distance double")
    place = {g: i for i, g in enumerate(found.groups)}
    read = ship(spark, (found.mean, found.covariance))

    @F.arrow_udf("double")
    def distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        mean, covariance = read()
        for ones, twos in batches:
            found_ = [gaussian_wasserstein(mean[i], covariance[i], mean[j], covariance[j]) for i, j in zip(ones.to_pylist(), twos.to_pylist(), strict=True)]
            yield pa.array(np.sqrt(np.array(found_, np.float64)))

    pairs = spark.createDataFrame([(g, h, place[g], place[h]) for g, h in rows], f"a {kind}, b {kind}, i int, j int")
    return pairs.select("a", "b", distance("i", "j").alias("distance"))


def axes(width: int) -> np.ndarray:
    """One direction along each dimension: every marginal counts alike."""
    return np.eye(width)


def random_directions(width: int, count: int, seed: int = 42) -> np.ndarray:
    """``count`` directions spread evenly over the sphere, the same for the same seed."""
    drawn = np.random.default_rng(seed).normal(size=(count, width))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def coupled(x: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, y: np.ndarray, y_low: np.ndarray, y_high: np.ndarray) -> float:
    """The integral of the squared difference of two step functions over what both cover; intervals in order."""
    edges = np.unique(np.concatenate([x_low, x_high, y_low, y_high]))
    edges = edges[(edges >= max(x_low[0], y_low[0])) & (edges <= min(x_high[-1], y_high[-1]))]
    middle = (edges[1:] + edges[:-1]) / 2
    difference = x[np.searchsorted(x_high, middle)] - y[np.searchsorted(y_high, middle)]
    return float((np.diff(edges) * difference**2).sum())


def sliced_distances(df: DataFrame, group: str, vector: str, directions: np.ndarray | None = None, against: object | None = None, cell: int = CELL) -> DataFrame:
    """(a, b, distance): the sliced 2-Wasserstein distance of every pair of groups.

    The root of the mean, over the directions (the axes by default), of the squared distance of the
    projected groups. That is exact for groups of any, also unequal, sizes: each value covers its
    share of [0, 1) in the order of values, and the two groups' values that lie over each
    other are compared. Ranks come from range partitions with counted offsets; [0, 1) is cut into
    cells of about ``cell`` values, each coupled by its own task, so no group is gathered.
    """
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    held, width = _usable(df, vector, F.col(group).alias("g"))
    held = held.where("g is not null")
    lines = axes(width) if directions is None else np.asarray(directions, np.float64)
    kind_ = held.select("g").limit(0).toArrow().schema.field("g").type

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = _matrix(part.column(1), width) @ lines.T
                numbers = np.repeat(np.arange(len(lines)), len(values))
                groups_ = part.column(0).take(pa.array(np.tile(np.arange(len(values)), len(lines)))).cast(kind_)
                # no -0.0 beside 0.0
                yield pa.RecordBatch.from_arrays([groups_, pa.array(numbers), pa.array(values.T.ravel() + 0.0)], names=["g", "line", "x"])

    projected = held.mapInArrow(project, f"g {kind}, line long, x double")
    counts = store(projected.groupBy("g", "line", "x").agg(F.count(F.lit(1)).alias("n")), "projected")
    sizes = {r.g: r.n for r in counts.where("line = 0").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    rows = _pairs(sorted(sizes), against)
    if not rows:
        return spark.createDataFrame([], f"a {kind}, b {kind}, distance double")
    cells = max(1, -(-2 * max(sizes.values()) // cell))
    at = ranked(counts, ["g", "line"], -(-counts.count() // RANGE))
    at = at.select("g", "line", "x", ((F.col("reach") - F.col("n")) / F.col("total")).alias("low"), (F.col("reach") / F.col("total")).alias("high"))
    at = at.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.greatest(F.floor(F.col("low") * cells), F.ceil(F.col("high") * cells) - 1))))
    at = at.withColumn("low", F.greatest("low", F.col("cell") / F.lit(float(cells)))).withColumn("high", F.least("high", (F.col("cell") + 1) / F.lit(float(cells))))
    # as many rows as pairs of groups
    sides = spark.createDataFrame([(i, s, p) for i, pair in enumerate(rows) for s, p in enumerate(pair)], f"pair int, side int, g {kind}")
    placed = at.join(F.broadcast(sides), "g").select("pair", "side", "line", "cell", "x", "low", "high")

    def couple(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, x, low, high = (table.column(c).to_numpy() for c in ("side", "x", "low", "high"))
        order = np.lexsort((low, side))
        side, x, low, high = side[order], x[order], low[order], high[order]
        half = int(np.searchsorted(side, 1))
        value = coupled(x[:half], low[:half], high[:half], x[half:], low[half:], high[half:]) if 0 < half < len(side) else 0.0
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "value": pa.array([value], pa.float64())})

    sums = placed.groupBy("pair", "line", "cell").applyInArrow(couple, "pair int, value double").groupBy("pair").agg(F.sum("value").alias("value"))
    names = spark.createDataFrame([(i, *pair) for i, pair in enumerate(rows)], f"pair int, a {kind}, b {kind}")
    return sums.join(F.broadcast(names), "pair").select("a", "b", F.sqrt(F.col("value") / len(lines)).alias("distance"))
