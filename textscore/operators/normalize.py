"""Skew analysis and the fit/transform normaliser with a composite index."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import ALL_METRICS, DEFAULT_LOWER_IS_BETTER, DEFAULT_SKEWED
from ..session import store
from .joins import existing

SKEW_SCHEMA = T.StructType(
    [
        T.StructField("Metric", T.StringType()),
        T.StructField("Original Skew", T.DoubleType()),
        T.StructField("Log1p Skew", T.DoubleType()),
        T.StructField("Skew Reduction", T.DoubleType()),
        T.StructField("Min Val", T.DoubleType()),
        T.StructField("Max Val", T.DoubleType()),
        T.StructField("Log Transform?", T.StringType()),
    ]
)
_STATS_SCHEMA = "feature string, source string, kind string, mean double, scale double, place int"


def _number(name: str) -> Column:
    """A metric as DOUBLE with NaN read as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


#: A state: moments of each metric's values and of their log1p, by part of the table. m2 and m3 are
#: sums of squares and cubes about the mean, which can be moved to any other origin.
STATE_SCHEMA = "part string, metric string, kind string, n long, mean double, m2 double, m3 double, low double, high double"
_KINDS = ("raw", "log")


class _Moments:
    """Moments that grow batch by batch."""

    def __init__(self) -> None:
        self.n, self.mean, self.m2, self.m3, self.low, self.high = 0, 0.0, 0.0, 0.0, math.inf, -math.inf

    def add(self, y: np.ndarray) -> None:
        if not len(y):
            return
        n, mean = len(y), float(y.mean())
        d = y - mean
        m2, m3, delta, whole = float((d * d).sum()), float((d * d * d).sum()), mean - self.mean, self.n + n
        self.m3 += m3 + delta**3 * self.n * n * (self.n - n) / whole**2 + 3 * delta * (self.n * m2 - n * self.m2) / whole
        self.m2 += m2 + delta * delta * self.n * n / whole
        self.mean += delta * n / whole
        self.n, self.low, self.high = whole, min(self.low, float(y.min())), max(self.high, float(y.max()))

    def row(self) -> tuple:
        none = not self.n
        return (self.n, *(None if none else x for x in (self.mean, self.m2, self.m3, self.low, self.high)))


def _gather(metrics: Sequence[str]):
    """A state's rows of one task: the moments of each part and metric.

    As aggregate functions, a dozen moments of 35 metrics outgrow what the JVM compiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Moments] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, parts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            for i, m in enumerate(metrics):
                values = batch.column(i + 1).to_numpy(zero_copy_only=False)
                there = ~np.isnan(values)
                for code, part in enumerate(parts):
                    x = values[there & (codes == code)]
                    for kind, y in zip(_KINDS, (x, np.log1p(x[x > -1.0])), strict=True):
                        held.setdefault((part, m, kind), _Moments()).add(y)
        rows = [(*key, *value.row()) for key, value in held.items()]
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.float64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    return run


def merge_states(state: DataFrame, by_part: bool = False) -> DataFrame:
    """One row per metric and kind, of each part or of all: every row's sums are moved to the common mean and added up."""
    keys = ["part", "metric", "kind"] if by_part else ["metric", "kind"]
    whole = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), F.sum("n").over(whole))
    moved = state.withColumn("centre", mean).withColumn("d", F.col("mean") - F.col("centre"))
    d, n, m2, m3 = (F.col(c) for c in ("d", "n", "m2", "m3"))
    merged = moved.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return merged.select(*([] if by_part else [F.lit("").alias("part")]), *merged.columns).select(*[f.split()[0] for f in STATE_SCHEMA.split(", ")])


def metric_state(df: DataFrame, metrics: Sequence[str] | None = None, part: str | None = None) -> DataFrame:
    """The state of a table: what a fit and a skew report need, a few rows per part.

    ``part`` names a column, such as a day, whose values are kept apart. States are tables: store
    one per day or append them to each other, and :meth:`MetricNormalizer.fit_state` and
    :func:`state_report` work on all of them without the metrics being read again. One pass; one row per
    metric, part and task is shuffled. NULL and NaN are left out, and so is the log1p of a value of -1 or less.
    """
    metrics = existing(df, metrics or ALL_METRICS)
    own = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    table = df.select(own.alias("part"), *[_number(m).alias(f"c{i}") for i, m in enumerate(metrics)])
    return merge_states(table.mapInArrow(_gather(metrics), STATE_SCHEMA), by_part=True)


def _moments(state: DataFrame) -> dict[str, dict[str, float | None]]:
    """Count, range, mean, deviation and biased skew of each metric, and the same of its log1p, of all parts.

    Two rows per metric reach the driver. ``log.skew`` exists only where no value is -1 or less.
    """
    out: dict[str, dict[str, float | None]] = {}
    for r in merge_states(state).collect():
        own = out.setdefault(r.metric, {})
        if r.kind == "raw":
            own["n"] = r.n
        if not r.n:
            own |= {f"{r.kind}.{k}": None for k in ("mean", "std", "flat", "skew", "min", "max")}
            continue
        variance = max(0.0, r.m2 / r.n)
        # a constant is told by its range: the deviation of equal floats can be noise
        flat = r.low == r.high
        skew = None if flat or not variance else r.m3 / r.n / variance**1.5
        own |= {f"{r.kind}.mean": r.mean, f"{r.kind}.std": math.sqrt(variance), f"{r.kind}.flat": flat, f"{r.kind}.skew": skew, f"{r.kind}.min": r.low, f"{r.kind}.max": r.high}
    for own in out.values():
        if own["raw.min"] is None or own["raw.min"] <= -1.0:
            own["log.skew"] = None
    return out


def _nothing() -> dict[str, float | None]:
    """The moments of a metric without a value."""
    return {"n": 0} | {f"{kind}.{k}": None for kind in _KINDS for k in ("mean", "std", "flat", "skew", "min", "max")}


def _advice(moments: dict, metrics: Sequence[str], skew_threshold: float, improvement_threshold: float) -> list[tuple]:
    """The report's rows, unrounded. No log is advised where a value has none."""
    rows = []
    for m in metrics:
        found = moments.get(m)
        if not found or not found["n"]:
            continue
        raw, log = found["raw.skew"], found["log.skew"]
        gain = abs(raw) - abs(log) if raw is not None and log is not None else None
        advise = gain is not None and abs(raw) > skew_threshold and gain > improvement_threshold
        rows.append((m, raw, log, gain, found["raw.min"], found["raw.max"], "YES" if advise else "NO"))
    return rows


def _report(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    digits = dict(zip(SKEW_SCHEMA.names[1:6], (3, 3, 3, 5, 5)))
    table = spark.createDataFrame(rows, SKEW_SCHEMA)
    return table.select(*[F.bround(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in SKEW_SCHEMA.names])


def skew_report(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    skew_threshold: float = 1.0,
    improvement_threshold: float = 0.1,
) -> DataFrame:
    """One row per metric: biased skew before and after log1p, range, and the advice.

    Absent and all-NULL metrics are left out; a skew that does not exist (constant or
    single value; a value of -1 or less, for the log) is NULL and advises NO.
    """
    metrics = existing(df, metrics or ALL_METRICS)
    moments = _moments(metric_state(df, metrics)) if metrics else {}
    return _report(df.sparkSession, _advice(moments, metrics, skew_threshold, improvement_threshold))


def state_report(state: DataFrame, metrics: Sequence[str] = ALL_METRICS, skew_threshold: float = 1.0, improvement_threshold: float = 0.1) -> DataFrame:
    """The :func:`skew_report` of the tables whose states (:func:`metric_state`) these are."""
    return _report(state.sparkSession, _advice(_moments(state), metrics, skew_threshold, improvement_threshold))


class _NormalizerParams(Params):
    metrics = Param(Params._dummy(), "metrics", "metric vocabulary, in scaling order", TypeConverters.toListString)
    skewed_metrics = Param(
        Params._dummy(), "skewed_metrics", "metrics to log-transform; empty = chosen by the skew report", TypeConverters.toListString
    )
    lower_is_better = Param(Params._dummy(), "lower_is_better", "metrics whose sign is flipped", TypeConverters.toListString)
    skew_threshold = Param(Params._dummy(), "skew_threshold", "absolute skew that counts as heavy", TypeConverters.toFloat)
    improvement_threshold = Param(
        Params._dummy(), "improvement_threshold", "least reduction of skew worth a log", TypeConverters.toFloat
    )
    id_col = Param(Params._dummy(), "id_col", "row key, kept as the last column", TypeConverters.toString)
    index_columns = Param(
        Params._dummy(), "index_columns", "metrics averaged into the index; empty = every scaled metric", TypeConverters.toListString
    )

    def _defaults(self) -> None:
        self._setDefault(
            metrics=list(ALL_METRICS),
            skewed_metrics=[],
            lower_is_better=[],
            skew_threshold=1.0,
            improvement_threshold=0.1,
            id_col="id",
            index_columns=[],
        )


class MetricNormalizer(Estimator, _NormalizerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Log-transform skewed metrics, flip those where lower is better, z-score, average.

    ``fit`` reads the table once and brings two rows per metric to the driver; ``fit_state`` reads states alone. A listed metric that the table lacks is skipped. A metric that is both
    skewed and lower-is-better is logged, then negated, and appears once.
    """

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    @classmethod
    def standard(cls, **params) -> MetricNormalizer:
        """The usual run: five metrics known as skewed, one where lower is better."""
        return cls(skewed_metrics=list(DEFAULT_SKEWED), lower_is_better=list(DEFAULT_LOWER_IS_BETTER), **params)

    def _fit(self, df: DataFrame) -> MetricNormalizerModel:
        listed = [*self.getOrDefault("metrics"), *self.getOrDefault("skewed_metrics"), *self.getOrDefault("lower_is_better")]
        known = existing(df, list(dict.fromkeys(listed)))
        if not known:
            raise ValueError("the table has none of the metrics to normalise")
        found = _moments(metric_state(df, known))
        # a table without rows has no state
        return self._fitted({m: found.get(m) or _nothing() for m in known})

    def fit_state(self, state: DataFrame) -> MetricNormalizerModel:
        """The model of the tables whose states (:func:`metric_state`) these are, all parts together."""
        found = _moments(state)
        listed = [*self.getOrDefault("metrics"), *self.getOrDefault("skewed_metrics"), *self.getOrDefault("lower_is_better")]
        if not any(m in found for m in listed):
            raise ValueError("the state has none of the metrics to normalise")
        return self._fitted(found)

    def _fitted(self, found: dict) -> MetricNormalizerModel:
        vocabulary = self.getOrDefault("metrics")
        skewed = [m for m in self.getOrDefault("skewed_metrics") if m in found]
        lower = [m for m in self.getOrDefault("lower_is_better") if m in found]
        auto = not self.getOrDefault("skewed_metrics")
        known = [m for m in dict.fromkeys([*vocabulary, *skewed, *lower]) if m in found]
        report = None
        if auto:
            wanted = [m for m in known if m in vocabulary]
            report = _advice(found, wanted, self.getOrDefault("skew_threshold"), self.getOrDefault("improvement_threshold"))
            skewed = [r[0] for r in report if r[-1] == "YES"]
        ordered = skewed + [m for m in lower if m not in skewed]
        ordered += [m for m in vocabulary if m in known and m not in ordered]

        stats = []
        for place, m in enumerate(ordered):
            kind = "log" if m in skewed else "raw"
            flip = m in lower
            mean, std = found[m][f"{kind}.mean"], found[m][f"{kind}.std"]
            scale = None if std is None else (1.0 if found[m][f"{kind}.flat"] else std)
            mean = -mean if flip and mean is not None else mean
            stats.append(Row(f"norm_{m}", m, kind + ("-" if flip else ""), mean, scale, place))
        model = MetricNormalizerModel(stats, report)
        return self._copyValues(model)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit, then transform. The metrics are stored once in the shared folder in between, so
        measures computed from texts are not computed twice."""
        listed = [*self.getOrDefault("metrics"), *self.getOrDefault("skewed_metrics"), *self.getOrDefault("lower_is_better")]
        table = store(df.select(self.getOrDefault("id_col"), *existing(df, list(dict.fromkeys(listed)))), "metrics")
        return self.fit(table).transform(table)


class MetricNormalizerModel(Model, _NormalizerParams):
    """Frozen means and scales; ``transform`` is a projection and works on streams."""

    def __init__(self, stats: Sequence[Row] = (), report: list[tuple] | None = None):
        super().__init__()
        self._defaults()
        self._stats = sorted((tuple(s) for s in stats), key=lambda s: s[5])
        self._report = report

    def get_feature_names(self) -> list[str]:
        return [s[0] for s in self._stats]

    def get_analysis_summary(self, spark: SparkSession) -> DataFrame:
        """The skew report of an automatic fit."""
        if self._report is None:
            raise ValueError("no skew analysis was made: the skewed metrics were given")
        return _report(spark, self._report)

    def stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._stats, _STATS_SCHEMA)

    def save_stats(self, spark: SparkSession, path: str) -> None:
        """Write the fitted state (a handful of rows) as JSON lines."""
        named = {"id_col": self.getOrDefault("id_col"), "index_columns": self.getOrDefault("index_columns")}
        params = json.dumps({"set": named, "report": self._report})
        self.stats(spark).withColumn("params", F.lit(params)).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load_stats(cls, spark: SparkSession, path: str) -> MetricNormalizerModel:
        rows = spark.read.schema(_STATS_SCHEMA + ", params string").json(path).collect()
        if not rows:
            return cls()
        kept = json.loads(rows[0]["params"])
        report = kept["report"] and [tuple(r) for r in kept["report"]]
        return cls([Row(*r[:6]) for r in rows], report)._set(**kept["set"])

    def _z(self, source: str, kind: str, mean: float | None, scale: float | None) -> Column:
        if mean is None or scale is None:
            return F.lit(None).cast("double")
        x = _number(source)
        if kind.startswith("log"):
            x = F.log1p(x)
        if kind.endswith("-"):
            x = -x
        return (x - F.lit(mean)) / F.lit(scale)

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {s[0]: self._z(*s[1:5]) for s in self._stats}
        chosen = self.getOrDefault("index_columns")
        index = row_mean([scaled[s[0]] for s in self._stats if not chosen or s[1] in chosen])
        # The one-element explode keeps a later filter on the index above this step. Pushed
        # below, it would meet the metrics' own definitions, and Catalyst's constraint
        # inference would try every subset of up to 35 of them.
        return df.select(
            *[z.alias(name) for name, z in scaled.items()],
            F.explode(F.array(index)).alias("overall_quality_index"),
            self.getOrDefault("id_col"),
        )


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns of a row, NULLs left out; NULL where all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present)
