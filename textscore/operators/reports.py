"""Reports over normalised metrics: each one aggregate, combined map-side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_label
from .joins import existing

INDEX = "overall_quality_index"
# ---- fixed values: answer-side features compared with the human side -----------
GAP_FEATURES = (
    "quantification_density",
    "causal_density",
    "hedge_density",
    "booster_density",
    "modal_should_freq",
    "modal_must_freq",
    "modal_could_freq",
    "modal_will_freq",
)
CORRELATED = (
    "overall_quality_index",
    "norm_answer_hedge_to_booster_ratio",
    "norm_recommendations_precision_50",
    "norm_answer_quantification_density",
    "norm_factuality_precision_50",
    "norm_flesch_kincaid_grade",
    "norm_flesch_reading_ease",
    "norm_clarity_score_avg",
    "norm_f1_bert",
    "norm_relevance_score_avg",
    "norm_reasoning_percentage",
    "norm_factuality_score_avg",
    "norm_actionability_score_avg",
    "norm_reasoning_score_avg",
    "norm_answer_causal_density",
)


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("department", "category", "strategy", INDEX)) -> DataFrame:
    return df.dropna(subset=list(columns))


def ranking(df: DataFrame, by: str = "strategy", value: str = INDEX) -> DataFrame:
    """Mean of ``value`` per group with its rank, best first; NULL groups are left out."""
    means = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.avg(value).alias("mean_value"))
    # one row per group reaches this window
    place = F.rank().over(W.orderBy(F.desc_nulls_last("mean_value")))
    return means.withColumn("place", place.cast("long")).orderBy("place", by)


def hierarchy(df: DataFrame, levels: Sequence[str] = ("department", "category", "strategy"), value: str = INDEX) -> DataFrame:
    """Count and mean at every level of a hierarchy, one pass over grouping sets."""
    levels = list(levels)
    sets = [levels[: i + 1] for i in range(len(levels))]
    grouped = drop_incomplete(df, [*levels, value]).groupingSets([[F.col(c) for c in s] for s in sets], *levels)
    return grouped.agg(
        F.grouping_id(*levels).cast("long").alias("level_id"),
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
    )


def rollup_report(df: DataFrame, levels: Sequence[str], value: str = INDEX, cube: bool = False) -> DataFrame:
    """As :func:`hierarchy`, with the grand total (rollup) or every combination (cube)."""
    base = drop_incomplete(df, [*levels, value])
    grouped = base.cube(*levels) if cube else base.rollup(*levels)
    return grouped.agg(
        F.grouping_id(*levels).cast("long").alias("level_id"),
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
    )


def stratified(df: DataFrame, by: Sequence[str] = ("department", "category"), metrics: Sequence[str] = (INDEX,)) -> DataFrame:
    """Row count and mean, deviation of each metric per stratum."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for m in existing(df, metrics):
        aggregates += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return df.groupBy(*by).agg(*aggregates)


def _comoments(columns: Sequence[str], shift: Sequence[float]):
    """Arrow mapper: one row per pair of columns and task, its sums over rows where both are present."""
    origin = np.array(shift)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        n, first, second, cross = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            there = ~np.isnan(x)
            x = np.where(there, x - origin, 0.0)
            n += there.T.astype(float) @ there
            first += x.T @ there
            second += (x * x).T @ there
            cross += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict(
            {
                "i": i.astype(np.int32),
                "j": j.astype(np.int32),
                "n": n[i, j],
                "si": first[i, j],
                "sj": first[j, i],
                "qi": second[i, j],
                "qj": second[j, i],
                "p": cross[i, j],
            }
        )

    return sums


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, both orders and the diagonal.

    Each pair uses the rows where both are present. A pair with a constant side is
    NULL; unknown columns are left out. Two passes: the column means, then sums about
    them, taken as matrix products per Arrow batch. A task sends one row per pair.
    (As aggregate functions, over 200 moments outgrow what the JVM compiles, and ran
    seven times slower on a million rows.)
    """
    columns = existing(df, columns)
    table = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    means = table.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    parts = table.mapInArrow(
        _comoments(columns, list(means)), "i int, j int, n double, si double, sj double, qi double, qj double, p double"
    )
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])
    sii = F.col("qi") - F.try_divide(F.col("si") * F.col("si"), F.col("n"))
    sjj = F.col("qj") - F.try_divide(F.col("sj") * F.col("sj"), F.col("n"))
    sij = F.col("p") - F.try_divide(F.col("si") * F.col("sj"), F.col("n"))
    # what is left of equal values after subtraction is rounding noise
    varied = (sii > F.col("qi") * 1e-13) & (sjj > F.col("qj") * 1e-13)
    r = F.when(varied, F.try_divide(sij, F.sqrt(sii) * F.sqrt(sjj)))
    names = F.array(*[F.lit(c) for c in columns])
    one = total.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))
    both = F.array(
        F.struct(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), F.col("r").alias("corr")),
        F.struct(F.col("b").alias("metric_a"), F.col("a").alias("metric_b"), F.col("r").alias("corr")),
    )
    return one.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))


def trend_lines(df: DataFrame, x: str, y: str, by: str = "strategy") -> DataFrame:
    """Ordinary least squares of ``y`` on ``x`` per group; NULL where x is constant."""
    a, b = F.col(y), F.col(x)
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.regr_count(a, b).alias("n"),
    )


def gap_pairs(df: DataFrame, features: Sequence[str] = GAP_FEATURES) -> list[tuple[str, str]]:
    """(answer, human) columns present on both sides."""
    named = [(f"norm_answer_{f}", f"norm_human_answer_{f}") for f in features]
    return [p for p in named if p[0] in df.columns and p[1] in df.columns]


def _long(df: DataFrame, values: Sequence[tuple[Column, Column]], source: Column) -> DataFrame:
    cells = [F.struct(label.alias("Feature"), value.alias("Value"), source.alias("Source")) for label, value in values]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def human_gap(df: DataFrame, features: Sequence[str] = GAP_FEATURES, by: str = "strategy") -> DataFrame:
    """Long table (Feature, Value, Source): the human baseline and each strategy's mean.

    The table is read once: the baseline adds up the sums of the strategies.
    Without the column ``by`` there is a single source "Model Average".
    """
    pairs = gap_pairs(df, features)
    if not pairs:
        raise ValueError("no pair of human and answer metric columns")
    labels = [clean_label(F.lit(m)) for m, _ in pairs]
    aggregates = []
    for i, (m, h) in enumerate(pairs):
        aggregates += [F.avg(m).alias(f"m{i}"), F.sum(h).alias(f"s{i}"), F.count(h).alias(f"n{i}")]
    grouped = df.groupBy(by).agg(*aggregates) if by in df.columns else df.agg(*aggregates)
    models = grouped
    source = F.lit("Model Average")
    if by in df.columns:
        models = grouped.filter(F.col(by).isNotNull())
        source = F.concat(F.lit("Model: "), F.col(by))
    totals = grouped.agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(f"h{i}") for i in range(len(pairs))])
    human = _long(totals, [(label, F.col(f"h{i}")) for i, label in enumerate(labels)], F.lit("Human Reference"))
    return human.unionByName(_long(models, [(label, F.col(f"m{i}")) for i, label in enumerate(labels)], source))


def radar_matrix(gap: DataFrame, features: Sequence[str], sources: Sequence[str] | None = None) -> DataFrame:
    """Feature x source matrix in feature order, closed by repeating the first feature there is.

    Features that ``gap`` lacks are left out. ``sources`` spares the pass that lists the
    distinct sources; the features' own names are few and are listed by the driver.
    """
    named = {f: clean_label(F.lit(f"norm_answer_{f}")) for f in features}
    wanted = gap.sparkSession.range(1).select(*[label.alias(f) for f, label in named.items()]).first().asDict()
    there = {r[0] for r in gap.filter(F.col("Feature").isin(*wanted.values())).select("Feature").distinct().collect()}
    kept = [wanted[f] for f in features if wanted[f] in there]
    pivoted = gap.groupBy("Feature").pivot("Source", list(sources) if sources else None).agg(F.first("Value"))
    order = gap.sparkSession.createDataFrame(list(enumerate([*kept, *kept[:1]])), "point long, Feature string")
    return order.join(pivoted, "Feature").select("point", "Feature", *[c for c in pivoted.columns if c != "Feature"])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def profile(df: DataFrame) -> DataFrame:
    """One row per column: its type, non-null count and the row count, in one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"c{i}").alias("non_null"),
            F.col("__rows").alias("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.explode(F.array(*cells)).alias("p")).select("p.*")
