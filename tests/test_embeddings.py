"""Principal components and distances between groups, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscore.operators import embeddings


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    x = rng.normal(size=(700, 6)) @ mix + 1000
    g = rng.choice(["a", "b", "c"], 700, p=[0.9, 0.08, 0.02])
    x[g == "b"] += 3
    rows = [(i, str(l), v.tolist()) for i, (l, v) in enumerate(zip(g, x, strict=True))]
    bad = [(900, "a", None), (901, "a", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, "b", [float("nan")] * 6), (903, "b", [float("inf")] * 6), (904, None, [1000.0] * 6)]
    return spark.createDataFrame(rows + bad, "id long, g string, v array<double>").repartition(5), x, g


def test_components_equal_numpy(vectors):
    df, x, _ = vectors
    df = df.where("id <> 904")
    model = embeddings.fit_components(df, "v")
    values, directions = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(model.variance, values[::-1], rtol=1e-8)
    np.testing.assert_allclose(np.abs(model.directions @ directions[:, ::-1]), np.eye(6), atol=1e-6)
    assert (np.take_along_axis(model.directions, np.abs(model.directions).argmax(axis=1)[:, None], 1) > 0).all()
    placed = {r.id: r.components for r in model.transform(df, "v").collect()}
    np.testing.assert_allclose([placed[i] for i in range(700)], (x - x.mean(axis=0)) @ model.directions.T, atol=1e-6)
    assert placed[901] is placed[902] is placed[903] is None
    assert embeddings.fit_components(df, "v", k=2).directions.shape == (2, 6)
    kept = embeddings.fit_components(df, "v", share=0.9)
    assert kept.variance.sum() >= 0.9 * kept.total_variance > kept.variance[:-1].sum()
    report = model.report(df.sparkSession).collect()
    assert [r.component for r in report] == [1, 2, 3, 4, 5, 6] and report[-1].cumulative == pytest.approx(1)
    np.testing.assert_array_equal(embeddings.fit_components(df.repartition(3), "v").variance.round(6), model.variance.round(6))


def test_moments_by_group(vectors):
    df, x, g = vectors
    found = embeddings.moments(df, "v", "g")
    assert found.groups == ["a", "b", "c"]
    for i, name in enumerate(found.groups):
        assert found.count[i] == (g == name).sum()
        np.testing.assert_allclose(found.mean[i], x[g == name].mean(axis=0))
        np.testing.assert_allclose(found.covariance[i], np.cov(x[g == name].T), rtol=1e-7, atol=1e-7)


def test_gaussian_distances(vectors):
    df, x, g = vectors
    got = {(r.a, r.b): r.distance for r in embeddings.gaussian_distances(df, "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (p, q), value in got.items():
        one, two = x[g == p], x[g == q]
        a, b = np.cov(one.T), np.cov(two.T)
        product = np.linalg.eigvals(a @ b)  # tr((b^.5 a b^.5)^.5) is the sum of the roots of these
        want = ((one.mean(axis=0) - two.mean(axis=0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.maximum(product.real, 0)).sum()
        assert value == pytest.approx(want**0.5, rel=1e-6)
    only = embeddings.gaussian_distances(df, "g", "v", against="b").collect()
    assert {(r.a, r.b) for r in only} == {("a", "b"), ("c", "b")}
    # in one dimension, the difference of means and of deviations
    line = df.where("id < 900").select("g", F.array(F.element_at("v", 1)).alias("v"))
    flat = {(r.a, r.b): r.distance for r in embeddings.gaussian_distances(line, "g", "v").collect()}
    one, two = x[g == "a", 0], x[g == "b", 0]
    assert flat["a", "b"] == pytest.approx(np.hypot(one.mean() - two.mean(), one.std(ddof=1) - two.std(ddof=1)), rel=1e-6)


def quantile_coupling(x, y):
    """Squared distance in one dimension: both repeated to a common length, sorted and matched."""
    n = np.lcm(len(x), len(y))
    return ((np.repeat(np.sort(x), n // len(x)) - np.repeat(np.sort(y), n // len(y))) ** 2).mean()


@pytest.mark.parametrize(("cell", "rows"), [(200_000, 250_000), (30, 100)])
def test_sliced_distances(vectors, monkeypatch, cell, rows):
    df, x, g = vectors
    monkeypatch.setattr(embeddings, "RANGE", rows)
    lines = embeddings.random_directions(6, 3)
    for directions in (None, lines):
        used = np.eye(6) if directions is None else directions
        got = {(r.a, r.b): r.distance for r in embeddings.sliced_distances(df, "g", "v", directions, cell=cell).collect()}
        for (p, q), value in got.items():
            want = np.mean([quantile_coupling(x[g == p] @ d, x[g == q] @ d) for d in used])
            assert value == pytest.approx(want**0.5, rel=1e-6)
        assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_ties_and_single_vectors(spark):
    rows = [("a", [1.0]), ("a", [1.0]), ("a", [1.0]), ("b", [1.0]), ("b", [4.0]), ("c", [0.0]), ("d", [-0.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = {(r.a, r.b): r.distance for r in embeddings.sliced_distances(df, "g", "v", cell=2).collect()}
    assert got["a", "b"] == pytest.approx(4.5**0.5) and got["c", "d"] == 0 and got["a", "c"] == 1
    gauss = {(r.a, r.b): r.distance for r in embeddings.gaussian_distances(df, "g", "v").collect()}
    assert gauss["a", "c"] == 1 and gauss["c", "d"] == 0


def test_nothing_to_measure(spark, vectors):
    df, _, _ = vectors
    none = df.where("id < 0")
    assert embeddings.fit_components(none, "v").transform(none, "v").collect() == []
    assert embeddings.gaussian_distances(none, "g", "v").collect() == embeddings.sliced_distances(none, "g", "v").collect() == []
    assert embeddings.sliced_distances(df, "g", "v", against="zz").collect() == []
    with pytest.raises(ValueError, match="wide"):
        embeddings.moments(df.union(spark.createDataFrame([(1, "a", [1.0])], df.schema)), "v")
