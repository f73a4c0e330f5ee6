"""Exact quantiles per group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store
from .joins import all_of, fits


#: Distinct (group, value) pairs that one task sorts, about.
RANGE = 250_000


def _per_group(table: DataFrame, row_bytes: int) -> DataFrame:
    """A table with few rows per group, broadcast if its counted size allows: the large side then stays put."""
    return F.broadcast(table) if fits(table, row_bytes) else table


def _value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(group, x, n) without NULLs, stored: the input is read once, equal values are combined map-side."""
    clean = df.filter(all_of([F.col(c).isNotNull() for c in [*by, value]]))
    return store(clean.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    ranges: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group, as columns ``q0``, ``q1``, ...

    Rows with a NULL key or value are left out. Equal values are counted together
    before the first shuffle. Where all counted values are few, each group is sorted by
    one task. Else they are dealt by ranges of (group, value), each of about ``RANGE`` values, and stored:
    totals of the ranges, added up in their order, tell which range holds a rank, and those ranges alone
    are read again and sorted. ``ranges`` overrides their number. ``approximate`` returns a sketch's answer instead.
    """
    by = list(by)
    if approximate:
        clean = df.filter(all_of([F.col(c).isNotNull() for c in [*by, value]]))
        cuts = F.percentile_approx(value, [float(p) for p in probabilities], 10_000)
        return clean.groupBy(*by).agg(cuts.alias("q")).select(
            *by, *[F.col("q")[i].cast("double").alias(f"q{i}") for i in range(len(probabilities))]
        )
    return _counted_quantiles(_value_counts(df, by, value), by, probabilities, ranges)


def ranked(counts: DataFrame, by: list[str], ranges: int, ranks: list | None = None) -> DataFrame:
    """The counted values (by, x, n) with the rows up to each (``reach``) and the group's ``total``.

    All of them, or those alone that may hold one of the ``ranks``, which are Columns of ``total``.
    """
    upto = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    if ranges <= 1:
        return counts.select(*by, "x", "n", F.sum("n").over(upto(by, "x")).alias("reach"), F.sum("n").over(whole).alias("total"))
    # a range's number is its partition's; stored, so that a lost executor cannot move a border
    dealt = store(counts.repartitionByRange(ranges, *by, "x").withColumn("range", F.spark_partition_id()), "ranges")
    filled = dealt.groupBy(*by, "range").agg(F.sum("n").alias("range_n"))
    filled = filled.select(*by, "range", (F.sum("range_n").over(upto(by, "range")) - F.col("range_n")).alias("before"), "range_n", F.sum("range_n").over(whole).alias("total"))
    if ranks is not None:  # a few ranges per group
        filled = filled.where(F.array_max(F.array(*[(r >= F.col("before")) & (r < F.col("before") + F.col("range_n")) for r in ranks])))
    inside = dealt.join(_per_group(store(filled.drop("range_n"), "located"), 128), [*by, "range"])
    return inside.select(*by, "x", "n", (F.col("before") + F.sum("n").over(upto([*by, "range"], "x"))).alias("reach"), "total")


def _counted_quantiles(counts: DataFrame, by: list[str], probabilities: Sequence[float], ranges: int | None = None) -> DataFrame:
    ranges = ranges or -(-counts.count() // RANGE)
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    ranks = [edge(pos).cast("long") for pos in at for edge in (F.floor, F.ceil)]
    placed = ranked(counts, by, ranges, ranks)
    held = [(F.col("reach") > r) & (F.col("reach") - F.col("n") <= r) for r in ranks]
    values = [F.max(F.when(h, F.col("x"))).alias(f"v{i}") for i, h in enumerate(held)]
    wide = placed.groupBy(*by).agg(F.max("total").alias("total"), *values)
    columns = []
    for i, pos in enumerate(at):
        lo, hi = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        columns.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q{i}"))
    return wide.select(*by, *columns)


def box_statistics(df: DataFrame, by: Sequence[str], value: str, approximate: bool = False) -> DataFrame:
    """Quartiles, extremes, 1.5 IQR whiskers and outlier count per group.

    The input is read once: all figures come from the counted values.
    """
    by = list(by)
    counts = _value_counts(df, by, value)
    probabilities = (0.25, 0.5, 0.75)
    q = grouped_quantiles(df, by, value, probabilities, approximate=True) if approximate else _counted_quantiles(counts, by, probabilities)
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    fences = store(
        q.select(
            *by,
            F.col("q0").alias("q1"),
            F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            (F.col("q0") - reach).alias("low_fence"),
            (F.col("q2") + reach).alias("high_fence"),
        ),
        "fences",
    )
    x = F.col("x")
    within = x.between(F.col("low_fence"), F.col("high_fence"))
    return (
        counts.join(_per_group(fences, 128), by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.sum("n").alias("n"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.min(F.when(within, x)).alias("low_whisker"),
            F.max(F.when(within, x)).alias("high_whisker"),
            F.sum(F.when(within, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def outliers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The rows beyond the 1.5 IQR fences of their group."""
    by = list(by)
    q = grouped_quantiles(df, by, value, (0.25, 0.75))
    reach = 1.5 * (F.col("q1") - F.col("q0"))
    fences = store(q.select(*by, (F.col("q0") - reach).alias("__lo"), (F.col("q1") + reach).alias("__hi")), "fences")
    kept = df.join(_per_group(fences, 64), by).filter((F.col(value) < F.col("__lo")) | (F.col(value) > F.col("__hi")))
    return kept.select(*df.columns)
