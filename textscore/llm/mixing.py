"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A token is a word here: a maximal run of other than white space of ASCII. Sources share a
budget, a multiple of all tokens, by weight; no target exceeds ``most`` times its source's
tokens, and what that frees is shared again by weight.

Schedule: slot i holds one block. Its point, the fraction of i times the golden ratio, is
mapped through the cumulative weights and names the slot's source; points of an interval come
evenly, so every stretch of the mix has the sources in proportion. A slot's rank among its
source's slots is counted by lattice sums, so each chunk of slots is worked out alone, without
a shuffle. The few blocks that the points leave over come after the last slot.

Blocks: every epoch puts a source's documents in an order fixed by a digest and lays them end to end,
epoch after epoch; the line is cut into blocks of ``block`` tokens and ends at the target. Positions are
running totals over ranges of the digest, in three steps, so no source is gathered in a task.
The slot of rank r takes the source's block r; its pieces are ranges of documents.

NULL and empty texts have no token and are never taken. Rows with a NULL source make up one source, the last.
Rows alike in id, source and text count as copies, each taken by itself. Weights of 0 or
less and missing ones give a target of 0. Empty tables give no rows. The same rows give the
same mix, however they are partitioned. One row per source must fit a task and a broadcast;
that size is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textscore.llm.common import broadcast
from textscore.operators.joins import BROADCAST_BYTES, fits
from textscore.session import store

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]++"
BLOCK = 1024
#: Slots worked out at once.
SLOTS = 1 << 16
#: Rows that share a range of the digest, on average, and ranges that are totalled in one task.
RANGE_ROWS, RANGES = 2048, 1024
_TURN = 1 << 64
#: The golden ratio's fraction in units of 2**-64, rounded to an odd number.
_GOLDEN = 0x9E3779B97F4A7C15


def size_of(text: Column) -> Column:
    """The text's words; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): weights dealt to the distinct sources in order of code points, NULL last, repeating."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    dealt = F.array(*(F.lit(float(w)) for w in weights))
    return sources.select("source").distinct().select("source", F.get(dealt, place % len(weights)).alias("weight"))


def targets(sources: DataFrame, budget: float, most: float = 2.0) -> DataFrame:
    """``sources`` (source, size, weight) with ``target``: the budget by weight, none above ``most`` times its size.

    ``sources`` should be stored: every round totals the sources at their most and the weights
    of the others, until the level, the words per unit of weight, stays.
    """
    limit, weighed = F.col("size") * F.lit(float(most)), sources.where("weight > 0")
    level, last = 0.0, None
    while level != last:
        full = limit < F.col("weight") * level
        held, weight = weighed.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            return sources.withColumn("target", F.when(F.col("weight") > 0, limit).otherwise(0.0))
        level, last = (budget - held) / weight, level
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(limit, F.col("weight") * level)).otherwise(0.0))


def _floor_sum(n: int, a: int, b: int) -> int:
    """The sum of floor((a i + b) / 2**64) for i below n, by exchanging slope and modulus."""
    total, m = 0, _TURN
    while n:
        total += (a // m) * (n * (n - 1) // 2) + (b // m) * n
        a, b = a % m, b % m
        n, b = divmod(a * n + b, m)
        m, a = a, m
    return total


def slots_before(n: int, border: int) -> int:
    """How many of the first n slots have a point below ``border`` / 2**64."""
    # floor(x) - floor(x - border) is 1 exactly where the fraction of x is below the border
    return _floor_sum(n, _GOLDEN, 0) - (_floor_sum(n, _GOLDEN, _TURN - border) - n)


def borders_of(shares: list[int]) -> list[int]:
    """Where each source's interval ends, in units of 2**-64, for their blocks."""
    whole, done, out = max(1, sum(shares)), 0, []
    for share in shares:
        done += share
        out.append(done * _TURN // whole)
    return out


def ranks_after(n: int, borders: list[int]) -> list[int]:
    """How many of the first n slots each source has."""
    below = [slots_before(n, b) for b in borders]
    return [high - low for low, high in zip([0, *below], below, strict=False)]


def schedule(spark: SparkSession, needed: list[int]) -> DataFrame:
    """(slot, place, rank) of every block of the sources, ``needed`` blocks each; place numbers the sources.

    Slots whose source has all its blocks stay empty; blocks beyond the last slot follow it.
    """
    count = sum(needed)
    read = broadcast(spark, (needed, borders_of(needed)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, borders = read()
        inner, most = np.array([b for b in borders if b < _TURN], np.uint64), np.array(shares, np.int64)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                first, last = chunk * SLOTS, min(count, (chunk + 1) * SLOTS)
                slot = np.arange(first, last)
                place = np.searchsorted(inner, slot.astype(np.uint64) * np.uint64(_GOLDEN), "right")
                order = np.argsort(place, kind="stable")
                own = place[order]
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - np.searchsorted(own, own) + np.array(ranks_after(first, borders))[own]
                good = rank < most[place]
                yield pa.RecordBatch.from_arrays([pa.array(slot[good]), pa.array(place[good].astype(np.int64)), pa.array(rank[good])], names=["slot", "place", "rank"])

    chunks = -(-count // SLOTS)
    dealt = spark.range(chunks).mapInArrow(run, "slot long, place long, rank long")
    done = ranks_after(count, borders_of(needed))
    late, slot = [], count
    for place, (got, want) in enumerate(zip(done, needed, strict=True)):
        if got < want:
            late.append((place, got, want, slot))
            slot += want - got
    if not late:
        return dealt
    tail = spark.createDataFrame(late, "place long, low long, high long, start long").select("place", "start", "low", F.explode(F.sequence("low", F.col("high") - 1)).alias("rank"))
    return dealt.union(tail.select((F.col("start") + F.col("rank") - F.col("low")).alias("slot"), "place", "rank"))


def running_total(df: DataFrame, group: list[str], order: str, value: str, result: str, rows: int) -> DataFrame:
    """``df`` with the total of ``value`` over the rows before each one in its group, by the digest ``order``.

    The digest is hexadecimal text, even over its range. Rows meet by ranges of it, of which
    only totals go on; those are added up by ranges of ranges, and these within the group.
    """
    ranges = max(1, -(-rows // RANGE_ROWS))
    point = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    placed = df.withColumn("_range", F.floor(point * ranges / F.lit(float(1 << 32))).cast("long"))
    placed = placed.withColumn("_wide", F.floor(F.col("_range") / RANGES).cast("long"))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda keys, by, of: F.coalesce(F.sum(of).over(before(keys, by)), F.lit(0))
    sums = placed.groupBy(*group, "_wide", "_range").agg(F.sum(value).alias("_sum"))
    inner = sums.withColumn("_low", total([*group, "_wide"], "_range", "_sum"))
    wide = sums.groupBy(*group, "_wide").agg(F.sum("_sum").alias("_sum")).withColumn("_base", total(group, "_wide", "_sum")).drop("_sum")
    on = lambda left, right, keys: left.join(right, [left[k].eqNullSafe(right[k]) for k in keys]).drop(*(right[k] for k in keys))
    start = on(inner, wide, [*group, "_wide"]).select(*group, "_range", (F.col("_low") + F.col("_base")).alias("_start"))
    own = placed.withColumn(result, total([*group, "_range"], order, value)).drop("_wide")
    return on(own, start, [*group, "_range"]).withColumn(result, F.col(result) + F.col("_start")).drop("_start", "_range")


class Mix(NamedTuple):
    """The given rows with their sources' totals and targets, the sources, and the pieces of the mix."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words that the mix takes from each, repeats counted."""
        sums = self.pieces.groupBy(F.col("unit").alias("_unit")).agg(F.sum("length").alias("taken"))
        whole = self.documents.join(sums, F.col("unit") == F.col("_unit"), "left").drop("_unit")
        return whole.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, most: int = 2, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """The mix of all of ``docs`` whose size is ``share`` times their words.

    ``weights`` is a table (source, weight), or weights dealt to the sources in order. Pieces
    are (slot, offset, unit, doc_id, source, epoch, start, length): words ``start`` to
    ``start + length`` of the document stand at ``offset`` of the slot's block.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    alike = raw.select("doc_id", "source", size_of(F.col("text")).alias("size"), digest.alias("alike")).groupBy("doc_id", "source", "size", "alike").agg(F.count("*").alias("n"))
    copies = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    sized = store(copies.select("doc_id", "source", "size", F.concat_ws("|", "alike", "copy").alias("unit")), "sized")

    totals = store(sized.groupBy("source").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("n")), "sources")
    weighed = repeating_weights(totals, weights) if isinstance(weights, tuple) else weights.select(F.col("source").alias("source"), F.col("weight").cast("double").alias("weight"))
    named = totals.join(weighed.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    named = store(named.withColumn("weight", F.coalesce("weight", F.lit(0.0))), "weighed")
    words, rows = named.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    aimed = targets(named, share * words, most)
    aimed = aimed.withColumn("quota", F.round("target").cast("long"))
    aimed = store(aimed.withColumn("place", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long")), "targets")
    if not fits(aimed, 256):
        raise ValueError(f"the sources do not fit a broadcast of {BROADCAST_BYTES} bytes")
    needed = [-(-row.quota // block) for row in aimed.orderBy("place").select("quota").collect()]

    sides = F.broadcast(aimed.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "quota", "place"))
    documents = sized.join(sides, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # one line of documents for each epoch that the quota reaches
    lines = documents.where((F.col("size") > 0) & (F.col("quota") > 0))
    lines = lines.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("source_size")) - 1)))
    lines = lines.withColumn("turn", F.md5(F.concat_ws("|", "unit", "epoch")))
    laid = running_total(lines.select("unit", "doc_id", "source", "place", "size", "source_size", "quota", "epoch", "turn"), ["place", "epoch"], "turn", "size", "at", rows)
    at = F.col("at") + F.col("epoch") * F.col("source_size")
    laid = laid.withColumn("at", at).withColumn("end", F.least(F.col("at") + F.col("size"), "quota")).where("at < end")
    cut = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = cut.select("place", "rank", "unit", "doc_id", "source", "epoch", (low - F.col("rank") * block).alias("offset"), (low - F.col("at")).alias("start"), (high - low).alias("length"))
    slots = schedule(spark, needed) if sum(needed) else spark.createDataFrame([], "slot long, place long, rank long")
    mixed = slots.join(pieces, ["place", "rank"]).select("slot", "offset", "unit", "doc_id", "source", "epoch", "start", "length")
    return Mix(documents.drop("quota", "place"), aimed.drop("place"), mixed)
