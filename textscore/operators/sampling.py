"""Scoping an evaluation to departments, categories and a number of scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PARTS = 64


def scope(df: DataFrame, **allowed: Sequence[str]) -> DataFrame:
    """Rows whose column values are listed, e.g. ``scope(df, department=["sales"])``."""
    for column, values in allowed.items():
        df = df.filter(F.col(column).isin(*values))
    return df


def sample_per_stratum(df: DataFrame, strata: Sequence[str], n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows of every stratum, the same rows for the same seed on any cluster.

    Rows are ordered by a hash of the seed and the id. Each stratum is first cut to
    ``n`` rows inside many parts, so a stratum that holds most of the table is never
    sorted by a single task.
    """
    strata = list(strata)
    keyed = df.withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    keyed = keyed.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(_PARTS)))
    order = ["__key", id_col]
    parts = keyed.withColumn("__rank", F.row_number().over(W.partitionBy(*strata, "__part").orderBy(*order)))
    short = parts.filter(F.col("__rank") <= n)
    ranked = short.withColumn("__rank", F.row_number().over(W.partitionBy(*strata).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= n).select(*df.columns)


def sample_fraction(df: DataFrame, stratum: str, fractions: dict, seed: int = 42) -> DataFrame:
    """A share of every stratum, without a shuffle."""
    return df.sampleBy(stratum, fractions, seed)
