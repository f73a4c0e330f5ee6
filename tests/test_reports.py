import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textscore.functions.lexicons import ALL_METRICS
from textscore.operators import normalize, quantiles, reports, sampling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "strategy": rng.choice(["cot", "nocot", "symcot", None], n, p=[0.7, 0.15, 0.1, 0.05]),
            "department": rng.choice(["sales", "marketing"], n),
            "category": rng.choice(["a", "b"], n),
            "flesch_reading_ease": rng.normal(50, 20, n) - 40,
            "flesch_kincaid_grade": rng.normal(9, 2, n),
            "f1_bert": 0.1 + 0.2,
            "clarity_score_avg": np.nan,
            "factuality_precision_50": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
            "answer_hedge_to_booster_ratio": rng.exponential(1, n) ** 3,
            "answer_causal_density": rng.integers(0, 4, n) / 4,
            "human_answer_causal_density": rng.random(n),
            "answer_hedge_density": rng.random(n),
        }
    )
    return spark.createDataFrame(pdf), pdf


def py_skew(x):
    d = x - x.mean()
    return (d**3).mean() / (d**2).mean() ** 1.5


def test_skew_report(table):
    df, pdf = table
    report = {r["Metric"]: r for r in normalize.skew_report(df).collect()}
    assert list(report) == [m for m in ALL_METRICS if m in pdf and m != "clarity_score_avg"]
    x = pdf["answer_hedge_to_booster_ratio"].to_numpy()
    row = report["answer_hedge_to_booster_ratio"]
    assert row["Original Skew"] == pytest.approx(py_skew(x), abs=6e-4)
    assert row["Log1p Skew"] == pytest.approx(py_skew(np.log1p(x)), abs=6e-4)
    assert row["Log Transform?"] == "YES"
    assert report["f1_bert"]["Original Skew"] is None and report["f1_bert"]["Log Transform?"] == "NO"


def test_no_log_where_a_value_has_none(spark):
    rows = [(i, float(i * i) if i % 10 else -2.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, f1_bert double")
    row = normalize.skew_report(df).first()
    assert row["Log1p Skew"] is None and row["Log Transform?"] == "NO" and row["Min Val"] == -2.0
    out = normalize.MetricNormalizer().fit(df).transform(df)
    assert out.filter("overall_quality_index IS NULL").count() == 0
    assert normalize.skew_report(df.limit(0)).collect() == []


def expected_norm(pdf, logged, lower):
    names = logged + [m for m in lower if m not in logged]
    names += [m for m in ALL_METRICS if m in pdf and m not in names]
    out = pd.DataFrame()
    for m in names:
        x = pdf[m].astype(float)
        x = np.log1p(x) if m in logged else x
        x = -x if m in lower else x
        std = x.std(ddof=0)
        out[f"norm_{m}"] = (x - x.mean()) / (1.0 if x.nunique() <= 1 else std)
    out["overall_quality_index"] = out.mean(axis=1)
    return out


@pytest.mark.parametrize("lower", [["flesch_kincaid_grade"], ["flesch_kincaid_grade", "answer_hedge_to_booster_ratio", "reasoning_percentage"]])
@pytest.mark.parametrize("skewed", [[], ["answer_hedge_to_booster_ratio", "no_such_metric", "factuality_precision_50"]])
def test_normalizer(table, skewed, lower):
    df, pdf = table
    given = list(skewed)
    est = normalize.MetricNormalizer(skewed_metrics=skewed, lower_is_better=lower)
    model = est.fit(df)
    assert skewed == given
    logged = [m for m in skewed if m in pdf] or ["answer_hedge_to_booster_ratio"]
    expected = expected_norm(pdf, logged, [m for m in lower if m in pdf])
    got = model.transform(df).toPandas().sort_values("id")
    assert list(got.columns) == [*expected.columns, "id"]
    assert model.get_feature_names() == [c for c in expected.columns if c.startswith("norm_")]
    for c in expected:
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), expected[c].to_numpy(dtype=float), atol=1e-9)


def test_index_columns_persistence_and_summary(spark, table, tmp_path):
    df, pdf = table
    model = normalize.MetricNormalizer(index_columns=["answer_causal_density"]).fit(df)
    assert model.get_analysis_summary(spark).count() == len(normalize.skew_report(df).collect())
    row = model.transform(df).first()
    assert row["overall_quality_index"] == row["norm_answer_causal_density"]
    model.save_stats(spark, str(tmp_path / "m"))
    again = normalize.MetricNormalizerModel.load_stats(spark, str(tmp_path / "m"))
    assert again.transform(df).first() == row
    assert again.get_analysis_summary(spark).collect() == model.get_analysis_summary(spark).collect()
    with pytest.raises(ValueError):
        normalize.MetricNormalizer.standard().fit(df).get_analysis_summary(spark)
    with pytest.raises(ValueError):
        normalize.MetricNormalizer().fit(spark.range(3))


def test_filter_on_the_index_of_a_derived_table_plans_quickly(spark):
    import time

    wide = spark.range(10).select("id", *[(F.col("id") * i + 0.5).alias(m) for i, m in enumerate(ALL_METRICS)])
    out = normalize.MetricNormalizer.standard().fit(wide).transform(wide)
    start = time.time()
    assert out.filter("overall_quality_index IS NOT NULL").count() == 10
    assert time.time() - start < 30


def test_states_merge_to_the_fit_of_the_whole(spark, table, tmp_path):
    """Halves, days and single rows, stored and merged, against the whole table; values far from zero included."""
    df, _ = table
    df = df.select("id", *[(F.col(m) + (1e3 if i % 5 == 4 else 0)).alias(m) for i, m in enumerate(c for c in df.columns if c in ALL_METRICS)], (F.abs(F.hash("id")) % 3).alias("day"))
    known = [c for c in df.columns if c in ALL_METRICS]
    whole = normalize._moments(normalize.metric_state(df))
    days = normalize.metric_state(df, part="day")
    assert {r.part for r in days.collect()} == {"0", "1", "2"}
    halves = [normalize.metric_state(df.where(c)) for c in ("day = 0", "day <> 0")]
    for h in halves:
        h.write.mode("append").parquet(str(tmp_path / "state"))
    stored = spark.read.parquet(str(tmp_path / "state"))
    for state in (days, stored, normalize.metric_state(df.repartition(40), part="id")):
        merged = normalize._moments(state)
        assert set(merged) == set(whole) == set(known)
        for m in known:
            assert merged[m].keys() == whole[m].keys()
            for k, v in whole[m].items():
                assert merged[m][k] == (v if v is None or isinstance(v, bool) else pytest.approx(v, rel=1e-9, abs=1e-9)), (m, k)
    assert normalize.state_report(stored).collect() == normalize.skew_report(df).collect()
    for est in (normalize.MetricNormalizer.standard(), normalize.MetricNormalizer()):
        one, two = est.fit(df), est.fit_state(stored)
        assert one.get_feature_names() == two.get_feature_names()
        got, want = ({r["id"]: r.overall_quality_index for r in model.transform(df).collect()} for model in (two, one))
        assert got == {i: v if v is None else pytest.approx(v, abs=1e-9) for i, v in want.items()}
    with pytest.raises(ValueError, match="none of the metrics"):
        normalize.MetricNormalizer().fit_state(stored.limit(0))


@pytest.mark.parametrize("ranges", [None, 8, 40])
@pytest.mark.parametrize("by", [["strategy"], ["department", "strategy"]])
def test_exact_quantiles(table, by, ranges):
    df, pdf = table
    for value in ("answer_hedge_to_booster_ratio", "answer_causal_density", "f1_bert"):
        got = quantiles.grouped_quantiles(df, by, value, (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), ranges=ranges).toPandas().set_index(by)
        groups = pdf.dropna(subset=by).groupby(by)[value]
        assert len(got) == groups.ngroups
        for i, p in enumerate((0.0, 0.1, 0.25, 0.5, 0.9, 1.0)):
            np.testing.assert_allclose(got[f"q{i}"].sort_index(), groups.quantile(p).sort_index(), atol=1e-12)


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_quantiles_of_hot_groups_and_values(spark, ranges):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.zeros(3000), [1e300, -1e300, 5.0]])
    g = np.concatenate([rng.choice(["a", "b", "c"], 6000, p=[0.9, 0.07, 0.03]), ["d", "d", "e"]])
    frame = pd.DataFrame({"g": g, "x": x})
    df = spark.createDataFrame(frame).union(spark.createDataFrame([(None, 1.0), ("a", None)], "g string, x double"))
    at = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.999, 1.0)
    got = quantiles.grouped_quantiles(df, ["g"], "x", at, ranges=ranges).toPandas().set_index("g").sort_index()
    assert list(got.index) == list("abcde")
    for i, p in enumerate(at):
        np.testing.assert_allclose(got[f"q{i}"], frame.groupby("g").x.quantile(p).sort_index(), rtol=1e-12, atol=1e-12)


def test_boxes_take_few_jobs(spark, table):
    df, _ = table
    df = df.cache()
    df.count()
    for ranges, most in ((250_000, 15), (20, 15)):
        quantiles.RANGE, before = ranges, quantiles.RANGE
        spark.sparkContext.setJobGroup(f"boxes-{ranges}", "boxes")
        try:
            boxes = quantiles.box_statistics(df, ["strategy"], "f1_bert")
            assert "filter(" not in boxes._jdf.queryExecution().optimizedPlan().toString()
            boxes.collect()
        finally:
            quantiles.RANGE = before
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boxes-{ranges}"))
        assert jobs <= most


def test_the_large_side_of_boxes_is_not_shuffled_by_group(spark, table):
    df, _ = table
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500")
    try:
        boxes = quantiles.box_statistics(df, ["strategy"], "answer_hedge_to_booster_ratio")
        plan = boxes._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BuildLeft" not in plan
        rows = quantiles.outliers(df, ["strategy"], "answer_hedge_to_booster_ratio")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BuildLeft" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_box_statistics_and_outliers(table):
    df, pdf = table
    value = "answer_hedge_to_booster_ratio"
    rows = {r["strategy"]: r for r in quantiles.box_statistics(df, ["strategy"], value).collect()}
    x = pdf[pdf.strategy == "cot"][value]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert rows["cot"]["n_outliers"] == len(x) - len(inside) > 0
    assert rows["cot"]["high_whisker"] == pytest.approx(inside.max())
    assert quantiles.outliers(df, ["strategy"], value).filter("strategy = 'cot'").count() == len(x) - len(inside)


def test_correlations(table):
    df, pdf = table
    names = ["flesch_reading_ease", "factuality_precision_50", "f1_bert", "clarity_score_avg", "answer_causal_density", "unknown"]
    got = {(r["metric_a"], r["metric_b"]): r["corr"] for r in reports.correlation_matrix(df, names).collect()}
    expected = pdf[names[:-1]].corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        if a in ("f1_bert", "clarity_score_avg") or b in ("f1_bert", "clarity_score_avg"):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_ranking_gap_and_radar(spark, table):
    df, pdf = table
    out = normalize.MetricNormalizer().fit(df).transform(df).join(df.select("id", "strategy"), "id")
    ranked = reports.ranking(out).collect()
    assert [r["place"] for r in ranked] == [1, 2, 3]
    assert ranked[0]["mean_value"] >= ranked[1]["mean_value"] >= ranked[2]["mean_value"]
    gap = reports.human_gap(out)
    rows = {(r["Feature"], r["Source"]): r["Value"] for r in gap.collect()}
    assert {f for f, _ in rows} == {"Causal"}
    pdf_out = out.toPandas()
    assert rows[("Causal", "Human Reference")] == pytest.approx(pdf_out["norm_human_answer_causal_density"].mean(), abs=1e-12)
    assert rows[("Causal", "Model: cot")] == pytest.approx(pdf_out[pdf_out.strategy == "cot"]["norm_answer_causal_density"].mean())
    radar = reports.radar_matrix(gap, ["causal_density"]).orderBy("point").collect()
    assert [r["point"] for r in radar] == [0, 1] and radar[0]["Model: cot"] == radar[1]["Model: cot"]
    closed = reports.radar_matrix(gap, ["hedge_density", "causal_density"]).orderBy("point").collect()
    assert [(r["point"], r["Feature"]) for r in closed] == [(0, "Causal"), (1, "Causal")]
    whole = reports.human_gap(out.drop("strategy"))
    assert {r["Source"] for r in whole.collect()} == {"Human Reference", "Model Average"}
    with pytest.raises(ValueError):
        reports.human_gap(out.select("id", "strategy"))


def test_constant_x_trend_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "strategy string, x double, y double")
    got = {r["strategy"]: r for r in reports.trend_lines(df, "x", "y").collect()}
    assert got["a"]["slope"] is None and got["b"]["slope"] == 2.0


def test_hierarchy_counts(table):
    df, pdf = table
    rows = reports.hierarchy(df, value="answer_causal_density").collect()
    clean = pdf.dropna(subset=["strategy"])
    assert sum(r["n"] for r in rows if r["level_id"] == 3) == len(clean)
    assert sum(r["n"] for r in rows if r["level_id"] == 0) == len(clean)


@pytest.mark.parametrize("n", [5, 2000])
def test_sampling_is_whole_and_repeatable(table, n):
    df, pdf = table
    first = sampling.sample_per_stratum(df, ["department"], n)
    again = sampling.sample_per_stratum(df.repartition(7), ["department"], n)
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in again.collect())
    sizes = pdf.groupby("department").size()
    got = first.groupBy("department").count().toPandas().set_index("department")["count"]
    assert (got == sizes.clip(upper=n)).all()
    other = sampling.sample_per_stratum(df, ["department"], n, seed=1)
    if n < 100:
        assert {r["id"] for r in other.collect()} != {r["id"] for r in first.collect()}
