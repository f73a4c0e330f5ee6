"""Approximate distinct counts from sketches that are stored by stratum and day, and merged.

A sketch takes a bounded number of bytes whatever it has seen, and the union of sketches is the sketch of the
union. So a day's rows are read once: a report over any days and strata merges stored
sketches. The relative standard error is about 1.04 / sqrt(2 ** lg_k); few values are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a sketch's registers: 4,096, a standard error of 1.6 percent.
LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    """The relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def _value(column: Column) -> Column:
    """A value as text that tells values of one column apart; NULL is left out."""
    return column.cast("string")


def distinct_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(by, column, n, sketch): a sketch of each column's values in each stratum, and how many are not NULL.

    A column of arrays is a bag of values, such as a text's tokens. Rows with a NULL in ``by``
    are a stratum of their own. Sketches are combined before the shuffle, so a hot stratum is none.
    """
    rows = []
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        values = F.transform(name, _value) if kind == "array" else F.array(_value(F.col(name)))
        rows.append(F.struct(F.lit(name).alias("column"), F.filter(values, lambda v: v.isNotNull()).alias("values")))
    flat = df.select(*by, F.explode(F.array(*rows)).alias("c")).select(*by, "c.column", F.explode_outer("c.values").alias("value"))
    return flat.groupBy(*by, "column").agg(F.count("value").alias("n"), F.hll_sketch_agg("value", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser strata: those of all stored ones that agree in ``by``."""
    return sketches.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, column, n, n_distinct): values and about how many different ones, in each stratum of ``by``.

    Every estimate is made from a union, so it does not depend on how the rows were parted.
    """
    merged = merge_sketches(sketches, by)
    return merged.select(*by, "column", "n", F.hll_sketch_estimate("sketch").alias("n_distinct"))
