"""Toxicity: held-out results, the lexicon's matches against plain edit distance, context."""

import itertools
import random

import numpy as np
import pytest

from textscore.llm import queries, toxicity
from textscore.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    found = queries.op3_toxicity(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    toxic, clean = [r.predicted for r in held if r.toxic == 1], [r.predicted for r in held if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_equals_edit_distance():
    terms = [("abcab", True), ("bca", True), ("cabba", False), ("abcabcabca", True), ("bb", False)]
    lexicon = toxicity.Lexicon(terms)
    rnd = random.Random(1)
    words = ["".join(w) for n in range(5) for w in itertools.product("abc", repeat=n)] + ["".join(rnd.choices("abcd", k=rnd.randint(4, 12))) for _ in range(4000)]
    for word in words:
        best = []
        for number, (term, whole) in enumerate(terms):
            near = distance(word, term) if whole else min(distance(word[:n], term) for n in range(len(word) + 1))
            if near <= toxicity.edits(term):
                best.append((near, number))
        got = lexicon.match(word)
        assert (got is None) == (not best), word
        if best:
            assert got[1] == min(best)[0], word
            assert (got[1], got[0]) in best


WORDS = "the plan is good and people all over have a sunny day with some music or an idea they like to share".split()


@pytest.fixture(scope="module")
def model(spark):
    """Forty texts of each kind from the same words; one word more in the toxic ones."""
    rnd, rows = random.Random(2), []
    for i in range(80):
        words = rnd.choices(WORDS, k=20)
        if i % 2 == 0:
            words.insert(rnd.randint(0, 20), "moronic")
        rows.append((i, " ".join(words), int(i % 2 == 0)))
    labelled = spark.createDataFrame([*rows, (999, None, 1), (998, "", 0), (997, "no label", None)], "doc_id long, text string, toxic int")
    return toxicity.fit(labelled, ratio=12.0)


def test_small_model(spark, model):
    assert [t for t, _ in model.terms] == ["moronic"]
    texts = ["a moronic one", "a moronik one", 'they say "moronic" here', "a good day", None, "", "x " * 100_000 + "moronic"]
    rows = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    scores = {r.doc_id: r.toxicity for r in toxicity.score(rows, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert scores[0] > 0.5 and scores[6] == scores[0]
    assert scores[0] > scores[1] > scores[3] and scores[0] > scores[2] > scores[3]
    assert scores[3] == scores[4] == scores[5] < 0.5
    assert toxicity.score(rows.limit(0), model).collect() == []


def test_no_labels_of_one_kind(spark):
    model = toxicity.fit(spark.createDataFrame([(1, "a b c", 0)], "doc_id long, text string, toxic int"))
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert {r.toxicity < 0.5 for r in toxicity.score(rows, model).collect()} == {True}


@pytest.mark.parametrize(
    ("text", "share"),
    [("he is x", 1.0), ('"he is x"', toxicity.QUOTED), ('"quoted" and x', 1.0), ("“he is x", toxicity.QUOTED), ("“he” is x", 1.0), ('"open\nx', 1.0)],
)
def test_context(text, share):
    assert toxicity.context(text, text.index("x"), ["he", "is"]) == share
    assert toxicity.context("x", 0, ["said"]) == toxicity.REPORTED


def test_context_is_the_text_s_own():
    scanner = toxicity.Scanner([("moronic", True)])
    alone = lambda t: [own for _, own in scanner.hits([t])]
    mixed = ["they said", "moronic", "he wrote this", "a moronic plan", "palabra", None, "called moronic"]
    got = dict(scanner.hits(mixed))
    assert {r: own[0, 0] for r, own in got.items()} == {1: 1.0, 3: 1.0, 6: toxicity.REPORTED}
    assert all(alone(t) == ([got[i]] if i in got else []) for i, t in enumerate(mixed))


@pytest.mark.parametrize(
    ("text", "share"),
    [
        ('"' + "so " * 200 + 'moronic"', toxicity.QUOTED), ('"' + "so " * 200 + '" moronic', 1.0), ("“" + "so " * 200 + "moronic”", toxicity.QUOTED),
        ('"' + "so " * 200_000 + 'moronic"', toxicity.QUOTED), ('"' + "so " * 200_000 + '\nmoronic', 1.0),
    ],
)
def test_long_quotations(text, share):
    assert [own[0, 0] for _, own in toxicity.Scanner([("moronic", True)]).hits(["x", text, "said"])] == [share]


def test_window_goes_on_behind_a_cut(monkeypatch):
    pieces = toxicity.chars.chunks
    monkeypatch.setattr(toxicity.chars, "chunks", lambda texts: pieces(texts, 8))
    scanner = toxicity.Scanner([("moronic", True)])
    for text, share in [("he said a b moronic", 0.6), ("moronic a b c he said", 0.6), ("said a b c d e moronic", 1.0), ("moronic a b c d e said", 1.0)]:
        assert [own[0, 0] for _, own in scanner.hits([text])] == [share], text
