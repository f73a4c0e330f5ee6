"""Joins: tables on a key, pandas-style merges, and lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

# A side is broadcast only when its rows were counted and fit this budget.
BROADCAST_BYTES = 64 * 1024 * 1024


def join_on_id(tables: Sequence[DataFrame], id_col: str = "id", how: str = "inner") -> DataFrame:
    """Equi-join chain on ``id_col``; AQE picks broadcast, sort-merge or a skew split."""
    return reduce(lambda left, right: left.join(right, id_col, how), tables)


def merge_on(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_keys_match: bool = False,
) -> DataFrame:
    """Join with suffixes on shared non-key names; NULL keys match each other on request."""
    keys = [on] if isinstance(on, str) else list(on)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if not null_keys_match:
        return left.join(right, keys, how)
    renamed = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    matched = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in renamed.items()])
    joined = left.join(right, matched, how)
    if how in ("right", "outer", "full", "fullouter", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(r)) for k, r in renamed.items()})
    return joined.drop(*renamed.values())


def fits(df: DataFrame, row_bytes: int, budget: int = BROADCAST_BYTES) -> bool:
    """Count rows, stopping past the budget, to prove that ``df`` may be broadcast."""
    most = budget // row_bytes
    return most > 0 and df.limit(most + 1).count() <= most


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what one task's share is measured by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(frequency: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """The keys that hold more than one partition's share of all rows, so fewer than there are partitions.

    ``frequency`` has a row per key with its count ``n``, and should be stored: it is read twice.
    """
    total = frequency.agg(F.sum(n)).first()[0] or 0
    return frequency.filter(F.col(n) * partitions(frequency.sparkSession) > total).select(*keys)


def split_hot_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, spread_by: Sequence[str]
) -> DataFrame:
    """Left join to a table with unique ``keys`` when a few keys hold much of ``left``.

    ``hot`` lists the keys that hold more than a partition's share (:func:`hot_keys`). Their matches are broadcast; the rows they served, and rows with a NULL key, then
    travel under a salt of their own, so the shuffled join that serves all other keys
    sees no hot key. Nothing is dropped.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    hot = hot.select(*keys)
    spread = partitions(left.sparkSession)
    matched = right.join(F.broadcast(hot), keys, "left_semi")
    # a hot key that the table lacks is settled too: its struct holds NULLs
    top = hot.join(F.broadcast(matched), keys, "left").select(*keys, F.struct(*values).alias("__hot"))
    served = left.join(F.broadcast(top), keys, "left")
    # A key's own salt is a function of the key: a literal would be folded out of the hash.
    own = F.pmod(F.xxhash64(*keys), F.lit(spread))
    settled = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("__hot").isNotNull())
    salt = F.when(settled, spread + F.pmod(F.xxhash64(*spread_by), F.lit(spread))).otherwise(own)
    cold = right.select(*keys, F.struct(*values).alias("__cold"), own.alias("__salt"))
    joined = served.withColumn("__salt", salt).join(cold, [*keys, "__salt"], "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(c) for c in left.columns], *[found[v].alias(v) for v in values])


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    row_bytes: int = 128,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join to a small or large table with unique keys.

    The table is broadcast when its counted size fits ``budget``; beyond that the
    hot keys of ``left`` are split off and the rest is joined by a shuffle.
    """
    if fits(right, row_bytes, budget):
        joined = left.join(F.broadcast(right), list(keys), "left")
        return joined.select(*left.columns, *[c for c in right.columns if c not in keys])
    left = store(left, "lookup")  # read twice: counted, then joined
    frequency = store(left.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "key-counts")
    return split_hot_lookup(left, right, keys, hot_keys(frequency, keys, "__n"), spread_by)


def keep_labels(df: DataFrame, label_col: str, labels: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose label is listed, by literal list or by a label table."""
    if isinstance(labels, DataFrame):
        wanted = labels.select(F.col(labels.columns[0]).alias(label_col)).distinct()
        return df.join(wanted, label_col, "left_semi")
    return df.filter(F.col(label_col).isin(*labels))


def first_available(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate that is a column of ``df``, chosen when the plan is built."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} is a column")


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
