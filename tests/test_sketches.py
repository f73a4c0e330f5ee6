"""Sketches of distinct values: merging, the error bound, small counts."""

import pytest
from pyspark.sql import functions as F

from textscore.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("stratum"), (F.col("id") % 20_011).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("few"))


def counted(table, by):
    return {tuple(r[: len(by) + 1]): (r.n, r.n_distinct) for r in table.collect()}


def test_merged_sketches_equal_those_of_the_union(rows, spark, tmp_path):
    by_day = sketches.distinct_sketches(rows, ["day", "stratum"], ["v", "few"])
    for half in (by_day.where("day < 4"), by_day.where("day >= 4")):
        half.write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for by in (["stratum"], ["day"], []):
        whole = sketches.distinct_sketches(rows, by, ["v", "few"])
        assert counted(sketches.distinct_counts(stored, by), by) == counted(sketches.distinct_counts(whole, by), by)


@pytest.mark.parametrize("lg_k", [8, 12, 16])
def test_estimates_keep_their_bound(rows, lg_k):
    found = sketches.distinct_counts(sketches.distinct_sketches(rows, ["day", "stratum"], ["v", "few"], lg_k), ["stratum"])
    exact = {r.stratum: r for r in rows.groupBy("stratum").agg(F.count_distinct("v").alias("v"), F.count_distinct("few").alias("few"), F.count("v").alias("n"), F.count("few").alias("m")).collect()}
    for r in found.collect():
        want, n = (exact[r.stratum].v, exact[r.stratum].n) if r.column == "v" else (exact[r.stratum].few, exact[r.stratum].m)
        assert r.n == n and abs(r.n_distinct - want) <= 4 * sketches.standard_error(lg_k) * want


def test_lists_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", ["x", "y", None]), ("a", None), ("b", []), (None, ["x"])], "g string, words array<string>")
    got = counted(sketches.distinct_counts(sketches.distinct_sketches(df, ["g"], ["words"]), ["g"]), ["g"])
    assert got == {("a", "words"): (2, 2), ("b", "words"): (0, 0), (None, "words"): (1, 1)}
    assert sketches.distinct_sketches(df.limit(0), ["g"], ["words"]).collect() == []
