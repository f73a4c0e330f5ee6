"""Lexical search against scores worked out term by term."""

import math
import random
import re

import numpy as np
import pytest

from textscore.llm import lexical
from textscore.llm.common import table


def brute(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) from plain Python."""
    cut = [(i, re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    documents, words = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    own: dict = {}
    for item, text in items:
        own.setdefault(item, set()).update(t.decode("utf-8", "surrogatepass") for t in lexical.terms_of(text))
    out = []
    for item, terms in own.items():
        scored = []
        df = {t: sum(t in held for _, held in cut) for t in terms}
        for i, held in cut:
            m = 10 + 90 * len(held) * documents // max(words, 1)
            score = 0
            for t in terms & set(held):
                tf = held.count(t)
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k):
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    right = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, lexical.search(left, right, k).collect()), key=str)


def test_given_documents(spark):
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_many_short_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    rng = random.Random(4)
    word = lambda: "w%d" % min(int(rng.expovariate(0.05)), 200)
    docs = [(i // 2, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(800)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(20)]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_edge_cases(spark):
    long = "été-" + "x" * 5000 + " " + "ab CD " * 3000
    docs = [(1, None), (2, ""), (3, "- , !"), (4, "Ab cd ef"), (5, long), (5, long), (None, "ab"), (6, "ab"), (7, "É été 東京 x1"), (8, "　")]
    items = [(1, "AB cd"), (1, "ab"), (2, None), (3, "..."), (None, "été"), (4, "cd ef 東京"), (5, "x" * 5000), (6, "É")]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)
    assert found(spark, docs[:0], items, 3) == []
    assert found(spark, docs, items[:0], 3) == []
    assert found(spark, docs[:3], items, 3) == []


@pytest.mark.parametrize("window", [16, 64, 1 << 21])
def test_spans(monkeypatch, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    texts = ["one two", "three", "", "four, five", "é" * 90 + " a", "b" * 70, "c"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, starts, ends, rows = lexical.Reader().spans(np.frombuffer(data, np.uint8), bounds)
    got = [(int(r), data[a:b].decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert got == [(r, m) for r, t in enumerate(texts) for m in re.findall(lexical.TERM, t)]


def test_equal_hashes_of_different_terms(monkeypatch):
    """Every hash collides; terms are still told apart, and bounds stay bounds."""
    monkeypatch.setattr(lexical.Reader, "_hashes", lambda self, data, starts, ends: np.full(len(starts), 1 << 40, np.uint64))
    texts = ["a b c", "b b d", "e"]
    reader, items = lexical.Reader(), lexical.Items([[b"a", b"b"], [b"d"]])
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, 5, 10, 11])
    spans = reader.spans(data, bounds)
    places, term = items.named(reader, data, *spans[:3])
    known = [b"a", b"b", b"d"]
    assert sorted((int(spans[3][p]), known[t]) for p, t in zip(places, term, strict=True)) == [(0, b"a"), (0, b"b"), (1, b"b"), (1, b"b"), (1, b"d")]
    part, weights = lexical.Slice(reader, data, bounds, 3, 7), np.array([100, 10, 1])
    exact = np.stack([part.scores(np.arange(3), items, weights, i) for i in range(2)], axis=1)
    one, two = (int(lexical.impacts(np.array([t]), np.array([3]), 3, 7)[0]) for t in (1, 2))
    assert exact.tolist() == [[110 * one, 0], [10 * two, one], [0, 0]]
    assert (part.bounds(items, weights) >= exact).all()
