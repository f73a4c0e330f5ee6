"""Measures by a user's model: windows, slices, and agreement with the rules the stand-ins follow."""

import math

import pytest
from pyspark.sql import functions as F

from textscore import functions as ts
from textscore.operators import models


@pytest.mark.parametrize("left_only", [False, True])
@pytest.mark.parametrize(("window", "overlap"), [(1, 0), (5, 0), (5, 4), (6, 3), (100, 10)])
def test_windows_cover_each_item_once(window, overlap, left_only):
    for n in range(0, 60):
        cut = models.windows(n, window, overlap, left_only)
        assert [i for _, _, a, b in cut for i in range(a, b)] == list(range(n))
        assert all(s <= a <= b <= e and e - s <= window for s, e, a, b in cut)
        for (s, e, _, _), (t, _, a, _) in zip(cut, cut[1:], strict=False):
            assert t == e - overlap and (a - t == overlap if left_only else a - t >= overlap // 2)


def test_models_are_made_once_and_see_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(models, "AT_ONCE", 3)

    def make():
        made = []

        def model(lists):
            made.append(1)
            assert 0 < len(lists) <= 3 and all(0 < len(x) <= 7 for x in lists)
            return [[f"{w}:{len(x)}" for w in x] for x in lists]

        return model

    rows = [(i, [f"w{j}" for j in range(n)] if n is not None else None) for i, n in enumerate((0, 1, None, 7, 8, 30, 0, 2, 200, 3))]
    df = spark.createDataFrame(rows, "id long, items array<string>").coalesce(1)
    got = {r.id: r.v for r in df.select("id", models.by_model(F.col("items"), make, window=7, overlap=2).alias("v")).collect()}
    for i, items in rows:
        assert (got[i] is None) == (items is None)
        assert [x.split(":")[0] for x in got[i] or []] == (items or [])
    with pytest.raises(ValueError):
        models.by_model(F.col("items"), make, window=5, overlap=5)


TEXTS = ["The quick fox runs. Go home now! Take it, please.", None, "", "  ", "...", "Invest in Acme Corp and Acme Corp today; 15 of 20 say so.", " ".join(f"word{i % 7}" for i in range(3000))]


def test_measures_agree_with_the_rules(texts):
    df = texts(TEXTS)
    closed = {w: tag for tag, words in ts.annotate.CLOSED_CLASSES.items() for w in words}
    rules = [(name, tuple(endings)) for name, endings in ts.annotate.SUFFIX_RULES]

    def tagger():
        tag = lambda w: closed.get(w) or next((n for n, ends in rules if w.endswith(ends)), "NOUN")
        return lambda lists: [[tag(w) for w in x] for x in lists]

    got = df.select("id", models.formality_by_model(F.col("text"), tagger, window=50, overlap=8).alias("a"), ts.formality_score(F.col("text")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) >= 3

    def moods():
        return lambda lists: [["IMPERATIVE" if s.split()[0].lower() in ("go", "take", "invest") else None if s == "..." else "X" for s in x] for x in lists]

    got = [r.v for r in df.select("id", models.mood_by_model(F.col("text"), moods).alias("v")).orderBy("id").collect()]
    assert got == [2.0, None, None, None, 0.0, 1.0, 0.0]

    def entities():
        names = {"acme": "ORG", "corp": "ORG", "15": "CARDINAL", "20": "CARDINAL", "fox": "PRODUCT"}
        return lambda lists: [[names.get(w, "O") for w in x] for x in lists]

    found = df.select("id", models.entity_density_by_model(F.col("text"), entities, labels=("ORG", "PRODUCT")).alias("v"), models.label_counts(F.col("text"), entities, ["ORG", "CARDINAL"]).alias("n")).orderBy("id").collect()
    assert [r.v for r in found] == [1 / 10, None, None, None, 0.0, 1 / 13, 0.0]
    assert [r.n and tuple(r.n) for r in found] == [(0, 0), None, (0, 0), (0, 0), (0, 0), (2, 2), (0, 0)]

    def language_model():
        return lambda lists: [[None if w == "the" else math.log(1 + len(w)) for w in x] for x in lists]

    for row, text in zip(df.select("id", models.surprisal_by_model(F.col("text"), language_model, window=9, overlap=3).alias("s")).orderBy("id").collect(), TEXTS, strict=True):
        import re

        values = [math.log(1 + len(w)) for w in re.findall(r"\w+", (text or "").lower()) if w != "the"]
        mean = sum(values) / len(values) if values else None
        std = (sum((x - mean) ** 2 for x in values) / len(values)) ** 0.5 if values else None
        assert tuple(row.s) == (pytest.approx(mean) if values else None, pytest.approx(std) if values else None, len(values))


def test_left_context_of_a_language_model(spark):
    """A model that counts the items before each one sees at least the overlap, but at the start."""

    def make():
        return lambda lists: [[float(i) for i in range(len(x))] for x in lists]

    df = spark.createDataFrame([(1, [str(i) for i in range(40)])], "id long, items array<string>")
    (row,) = df.select(models.by_model(F.col("items"), make, "double", window=10, overlap=4, left_only=True).alias("v")).collect()
    assert row.v[:10] == [float(i) for i in range(10)] and all(x >= 4 for x in row.v[10:])


def test_runs_are_found_without_copying_those_before(spark):
    """Many runs in one text; the expression holds no growing list."""
    given = [(["a", "b", "c", "d", "e", "f"], ["X", "X", "Y", "O", "X", None]), ([], []), (["a", "b"], ["X"]), (None, ["X"]), (["a"], ["O"])]
    df = spark.createDataFrame(given, "w array<string>, l array<string>")
    runs = models.labelled_runs(F.col("w"), F.col("l"), ["X", "Y"])
    assert [None if r.r is None else [tuple(x) for x in r.r] for r in df.select(runs.alias("r")).collect()] == [[("X", "a b"), ("Y", "c"), ("X", "e")], [], [("X", "a")], None, []]
    assert "aggregate" not in df.select(runs.alias("r"))._jdf.queryExecution().analyzed().toString()
    n = 100_000
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("w"))
    found = models.labelled_runs(F.col("w"), F.transform("w", lambda w, i: F.when(i % 2 == 0, "X").otherwise("O")), ["X"])
    first = long.select(found.alias("r")).select(F.size("r"), F.col("r")[1]["span"]).first()
    assert tuple(first) == (n // 2, "w3")
