"""Language ID: held-out accuracy, and the rules for texts without a language."""

import numpy as np
import pytest

from textscore.llm import language, queries
from textscore.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.op5_language(spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000
    held = [r for r in found if r.held_out]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize("n", range(2, 13))
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n
    distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
    assert distance.min() >= (2 ** (n - 2) if n <= 7 else 5)
    assert (np.abs(code.sum(axis=0)) < n).all()


TRAIN = [
    (1, "the house and the tree with the bird", "en"), (2, "this is the way that they think", "en"),
    (3, "das Haus und der Baum mit dem Vogel", "de"), (4, "ich denke, dass es nicht so ist", "de"),
    (5, None, "de"), (6, "", "en"), (7, "texte sans langue", None), (None, "the thing", "en"),
]


def test_small_model_and_edge_cases(spark):
    train = spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.langs == ["de", "en"]
    texts = ["the other thing", "nicht das Haus", None, "", "12 !?", "ü", "THE THING " * 50_000]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, language string")
    got = {r.doc_id: r.language for r in language.predict(rows.union(rows), model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"]
    assert got[2].score == 0 and not got[2].ambiguous
    assert got[6].lang_pred == "en"
    assert language.predict(rows, model).count() == len(texts)
    assert language.predict(rows.limit(0), model).collect() == []


def test_one_language_and_none(spark):
    train = spark.createDataFrame(TRAIN[:2], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    one = {r.doc_id: r.language.lang_pred for r in language.predict(rows, language.fit(train)).collect()}
    assert one == {1: "en", 2: "und"}
    none = language.predict(rows, language.fit(train.limit(0))).collect()
    assert {r.language.lang_pred for r in none} == {"und"}


def test_result_does_not_depend_on_the_memo(spark):
    model = language.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in TRAIN] * 3
    small = language.Predictor(model)
    small.words.limit = 3
    for a, b in zip(language.Predictor(model).predict(texts), small.predict(texts), strict=True):
        assert np.allclose(a, b) if isinstance(a, np.ndarray) and a.dtype == float else list(a) == list(b)
