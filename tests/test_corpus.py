"""Similarity, surprisal and table lookups against brute force, on both physical ways."""

import math
import random
import re
import time
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from textscore import functions as ts
from textscore import session
from textscore.operators import automaton, entities, joins, similarity, surprisal


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["Ünit", "quickly", "acme"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None, "the"), (101, "  ", "the"), (102, "single", "the"), (103, "***", "zz yy"), (104, "zz", "***")]
    return spark.createDataFrame(rows, "id long, text string, ref string"), rows


def toks(t):
    return re.findall(r"\w+", (t or "").lower())


def test_overlap(corpus):
    df, rows = corpus
    got = {r["id"]: r["s"] for r in df.select("id", similarity.token_overlap(F.col("text"), F.col("ref")).alias("s")).collect()}
    for i, text, ref in rows:
        if text is None:
            assert got[i] is None
            continue
        c, r = toks(text), toks(ref)
        p = sum(t in r for t in c) / len(c) if c else 0.0
        q = sum(t in c for t in r) / len(r) if r else 0.0
        assert tuple(got[i]) == (p, q, 2 * p * q / (p + q) if p + q else 0.0)


@pytest.mark.parametrize("budget", [similarity.VECTOR_BYTES, 0])
def test_vector_similarity(spark, corpus, budget):
    df, rows = corpus
    rng = np.random.default_rng(1)
    table = {w: rng.normal(size=8).astype("float32").tolist() for w in ["the", "ünit", "acme", "zz"] + [f"w{i}" for i in range(0, 40, 2)]}
    vectors = spark.createDataFrame(list(table.items()), "token string, vector array<float>")
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in similarity.greedy_similarity(df, "id", "text", "ref", vectors, budget).collect()}
    assert set(got) == {r[0] for r in rows if r[1] is not None}
    for i, text, ref in rows:
        if text is None:
            continue
        c, r = ([np.array(table[t], dtype=float) for t in toks(x) if t in table] for x in (text, ref))
        p = q = f = 0.0
        if c and r:
            cos = np.array([[a @ b / np.linalg.norm(a) / np.linalg.norm(b) for b in r] for a in c])
            p, q = cos.max(axis=1).mean(), cos.max(axis=0).mean()
            f = 2 * p * q / (p + q) if p + q > 0 else 0.0
        assert got[i] == pytest.approx((p, q, f), abs=1e-6)


def test_vector_similarity_is_one_operator(spark):
    """NULL, repeated and double vectors give one answer on both sides of the budget; ragged ones raise."""
    rows = [("a", [1.0, 0.1, 0.3]), ("b", [0.2, 1.0, -0.5]), ("c", None), ("d", [0.3, 0.3, 1.0]), ("a", [0.9, 0.2, 0.3]), ("e", [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), ("z", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(1, "a b c", "d a e"), (2, "b z", "d d"), (3, "c", "a"), (4, "a", None)], "id long, text string, ref string")
    vectors = spark.createDataFrame(rows, "token string, vector array<double>")
    found = [sorted(map(tuple, similarity.greedy_similarity(df, "id", "text", "ref", v, b).collect())) for v in (vectors, vectors.orderBy("token")) for b in (similarity.VECTOR_BYTES, 0)]
    for one in found[1:]:
        assert [r[0] for r in one] == [1, 2, 3]
        np.testing.assert_allclose(np.array(one), np.array(found[0]), atol=1e-12)
    ragged = spark.createDataFrame([*rows, ("f", [1.0])], "token string, vector array<double>")
    for budget in (similarity.VECTOR_BYTES, 0):
        with pytest.raises(ValueError, match="wide"):
            similarity.greedy_similarity(df, "id", "text", "ref", ragged, budget)


@pytest.mark.parametrize("budget", [similarity.VECTOR_BYTES, 0])
def test_vectors_that_are_no_numbers_are_left_out(spark, budget):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [inf, 0.0]), ("d", [0.6, 0.8]), ("e", [-inf, nan])]
    df = spark.createDataFrame([(1, "a b c", "d e"), (2, "b c", "a"), (3, "d", "d b")], "id long, text string, ref string")
    vectors = spark.createDataFrame(rows, "token string, vector array<double>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in similarity.greedy_similarity(df, "id", "text", "ref", vectors, budget).collect()}
    assert got == {1: pytest.approx((0.6, 0.6, 0.6)), 2: (0.0, 0.0, 0.0), 3: pytest.approx((1.0, 1.0, 1.0))}


@pytest.mark.parametrize("spread", [1.0, 1e-4, 1e-8, 0.0])
def test_best_cosines_are_exact(monkeypatch, spread):
    """Vectors so alike that single precision cannot rank them; blocks that must be taken whole."""
    monkeypatch.setattr(similarity, "_BLOCK", 16)
    rng = np.random.default_rng(2)
    left, right = (similarity._unit(rng.normal(size=40) + spread * rng.normal(size=(n, 40))) for n in (70, 50))
    best = similarity._best_cosines(left, right, left.astype(np.float32), right.astype(np.float32))
    whole = left @ right.T
    np.testing.assert_allclose(best[0], whole.max(axis=1), atol=1e-14)
    np.testing.assert_allclose(best[1], whole.max(axis=0), atol=1e-14)


def brute_surprisal(train, texts, cap=None):
    pairs, context, vocabulary = Counter(), Counter(), set()
    for t in train:
        w = toks(t)[:cap]
        vocabulary |= set(w)
        pairs.update(zip(w, w[1:]))
        context.update(w[:-1])
    out = {}
    for i, t in texts:
        w = toks(t)[:cap]
        s = [-math.log((pairs[ab] + 1) / (context[ab[0]] + len(vocabulary))) for ab in zip(w, w[1:])]
        out[i] = (np.mean(s), np.std(s), len(s)) if s else (None, None, 0)
    return out


@pytest.mark.parametrize("cap", [None, 5])
@pytest.mark.parametrize(("parts", "budget"), [(300, 0), (2, 0), (2, joins.BROADCAST_BYTES)])
def test_surprisal(corpus, monkeypatch, parts, budget, cap):
    monkeypatch.setattr(joins, "partitions", lambda _: parts)
    monkeypatch.setattr(surprisal, "TEXTS", 7)
    df, rows = corpus
    got = surprisal.text_surprisal(df, "id", "text", max_tokens=cap, budget=budget).collect()
    expected = brute_surprisal([r[1] for r in rows], [(r[0], r[1]) for r in rows], cap)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(expected[r["id"]], abs=1e-9)


@pytest.mark.parametrize("budget", [joins.BROADCAST_BYTES, 0])
def test_surprisal_of_other_texts(corpus, budget):
    df, rows = corpus
    got = surprisal.text_surprisal(df, "id", "ref", train=df, train_text="text", budget=budget).collect()
    expected = brute_surprisal([r[1] for r in rows], [(r[0], r[2]) for r in rows])
    for r in got:
        assert tuple(r)[1:] == pytest.approx(expected[r["id"]], abs=1e-9)


def test_bigrams_travel_as_multisets(spark):
    df = spark.createDataFrame([("x", "A b a b. a"), ("y", None), ("z", "one"), (None, ""), ("x", "b a")], "id string, text string")
    got = sorted(map(tuple, surprisal.text_bigrams(df, "id", "text").collect()), key=str)
    assert got == sorted([("x", "a", "b", 2), ("x", "b", "a", 2), ("x", "b", "a", 1), ("y", None, None, 0), ("z", None, None, 0), (None, None, None, 0)], key=str)
    counts = {(r.a, r.b): (r.n, r.texts) for r in surprisal.bigram_counts(df, "text").collect()}
    assert counts == {("a", "b"): (2, 1), ("b", "a"): (3, 2), ("a", None): (2, 0), ("b", None): (3, 0), ("one", None): (0, 0)}
    # bigrams seen once are not in the model that scores its own texts, and no row per token is shuffled
    for budget in (joins.BROADCAST_BYTES, 0):
        plan = surprisal.text_surprisal(df, "id", "text", budget=budget)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
    assert surprisal.text_surprisal(df.limit(0), "id", "text").collect() == []
    same = spark.createDataFrame([(1, "a b a b a b"), (2, "a b")], "id long, text string")
    assert [r.surprisal_std for r in surprisal.text_surprisal(same, "id", "text").orderBy("id").collect()][1] == 0


def test_bigrams_travel_once_for_each_block(spark, monkeypatch):
    texts = pa.array([["a", "b", "a", "b"]] * 40 + [None, [], ["c"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "t"])
    assert [len(x) for x in surprisal._block_slices(batch, 64)] == [16, 16, 11]
    assert [len(x) for x in surprisal._block_slices(batch, 0)][:40] == [1] * 40
    rows = pa.Table.from_batches(surprisal._block(batch, 0, True, True))
    of = {kind: rows.filter(pc.equal(rows["kind"], kind)) for kind in (surprisal.TEXT, surprisal.BIGRAM, surprisal.CONTEXT)}
    assert [len(x) for x in of.values()] == [len(texts), 2, 3]
    assert sorted(sum(of[surprisal.BIGRAM]["counts"].to_pylist(), [])) == [40, 80]
    assert surprisal._totals(rows, surprisal.CONTEXT, True)[1:] == (3, 0)
    # tokens of one hash are told, so that they are hashed anew
    monkeypatch.setattr(surprisal, "_hashes", lambda names, seed: np.zeros(len(names), np.int64))
    rows = pa.Table.from_batches(surprisal._block(batch, 0, True, True))
    assert surprisal._totals(rows, surprisal.CONTEXT, True)[2] > 0
    monkeypatch.undo()
    # an id of any name, shared ids, and more groups than one
    monkeypatch.setattr(surprisal, "ROWS", 1)
    df = spark.createDataFrame([("x", "a b a b"), ("x", "b a"), (None, "a b"), ("z", "c"), ("n", None)], "counts string, text string")
    got = {r.counts: r for r in surprisal.text_surprisal(df, "counts", "text").collect()}
    ab, ba = -math.log((3 + 1) / (3 + 3)), -math.log((2 + 1) / (2 + 3))
    assert {k: r.n_scored for k, r in got.items()} == {"x": 4, None: 1, "z": 0, "n": 0}
    assert got["x"].surprisal_mean == pytest.approx((2 * ab + 2 * ba) / 4) and got[None].surprisal_mean == pytest.approx(ab)
    assert got["z"].surprisal_mean is None


def test_bigrams_take_little_disk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.zipf(1.3, 60_000) % 30_000]
    rows = [(i, " ".join(words[300 * i : 300 * i + 300])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    expected, since = brute_surprisal([t for _, t in rows], rows), len(session._STORED)
    monkeypatch.setattr(surprisal, "ROWS", 2000)
    for budget in (surprisal.BLOCK_BYTES, 5000 * surprisal.TOKEN_BYTES):
        got = surprisal.text_surprisal(df, "id", "text", budget=budget)
        stored = [f for path in session._STORED[since:] for f in Path(urlparse(path).path).glob("*.parquet")]
        if budget == surprisal.BLOCK_BYTES:
            assert sum(f.stat().st_size for f in stored) < 6 * len(words)
        for r in got.collect():
            assert tuple(r)[1:] == pytest.approx(expected[r["id"]], abs=1e-9)
    session.release(spark, since)


def test_packed_rows_come_back():
    texts = pa.array([["a", "b", "a", "c", "\u00e9"], None, [], ["b", "a", "b"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), texts], names=["id", "t"])
    for seed in (0, 1):
        rows = list(surprisal._block(batch, seed, False, True, 3, 2, {"a": 5}))
        packed = pa.Table.from_batches([surprisal._packed(x) for x in rows])
        for kind, was, names in ((surprisal.BIGRAM, rows[0], ["block", "bucket", "counts", "a", "b"]), (surprisal.CONTEXT, rows[1], ["block", "bucket", "counts", "tokens"])):
            back = surprisal._unpacked(packed, kind)
            assert [back[x].to_pylist() for x in names] == [was[x].to_pylist() for x in names]
    for arrays in ([np.zeros(0, np.int64)], [np.array([0, 255, 256]), np.array([2**64 - 1], np.uint64), np.zeros(3, np.uint8)]):
        assert [x.tolist() for x in surprisal._unpack(surprisal._pack(*arrays))] == [x.tolist() for x in arrays]
    # pairs that mix to one value are still told apart
    a, b = np.array([1, 2, 1, 2]), np.array([0, 7046029254386353131, 0, 7046029254386353131])
    assert surprisal._same(a, b).tolist() == [0, 1, 0, 1]


def test_bigrams_of_a_frequent_token_go_to_several_buckets():
    texts = pa.array([[x for i in range(200) for x in ("the", f"w{i}")], ["the", "w1", "w2"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2)), texts], names=["id", "t"])
    the = surprisal._hashes(pa.array(["the"]), 0)[0]

    def buckets(batch, parts):
        rows = next(surprisal._block(batch, 0, False, True, parts=parts)).to_pylist()
        return {b: r["bucket"] for r in rows for a, b in zip(r["a"], r["b"]) if a == the}

    assert len(set(buckets(batch, None).values())) == 1
    spread = buckets(batch, {"a": 3, "the": 20})
    assert 10 < len(set(spread.values())) <= 20
    assert buckets(batch.slice(1), {"the": 20}).items() <= spread.items()


def test_stored_once_leaves_no_shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in held for f in Path(d).rglob("shuffle_*.data")}

    def left(before):
        for _ in range(50):
            if files() <= before:
                break
            time.sleep(0.2)
        return files() - before

    before, since, df = files(), len(session._STORED), spark.range(1000).repartition(3, "id")
    stored = session.store(df, "once", once=True)
    assert not left(before) and stored.count() == 1000
    assert spark.conf.get(session.DROP_SHUFFLES_KEY) == "false"
    session.release(spark, since)


def test_overlap_counts_many_texts_at_once(spark):
    pairs = [("a b a", "a c"), ("", "a"), (None, "a"), ("a", None), ("É é x", "é"), ("!", "?")] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, c string, r string").coalesce(1)
    scored = df.select("id", similarity.token_overlap(F.col("c"), F.col("r")).alias("s"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "sort_array" not in plan
    got = [r.s and tuple(r.s) for r in scored.orderBy("id").collect()]
    expected = [(2 / 3, 1 / 2, 4 / 7), (0, 0, 0), None, None, (2 / 3, 1, 4 / 5), (0, 0, 0)] * 3
    assert [g is None for g in got] == [e is None for e in expected]
    assert [x for g in got if g for x in g] == pytest.approx([x for e in expected if e for x in e])


@pytest.mark.parametrize("budget", [joins.BROADCAST_BYTES, 0])
def test_lookup_keeps_every_row(spark, monkeypatch, budget):
    monkeypatch.setattr(joins, "partitions", lambda _: 12)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 50, 2)], ("never", 9)], "k string, v long")
    got = joins.lookup(left, right, ["k"], ["id"], budget=budget)
    assert got.columns == ["id", "k", "v"]
    values = {r["k"]: r["v"] for r in right.collect()}
    rows = got.collect()
    assert len(rows) == 3000
    assert all(r["v"] == values.get(r["k"]) for r in rows)
    # a hot key the table lacks
    rows = joins.lookup(left, right.filter("k <> 'hot'"), ["k"], ["id"], budget=budget).collect()
    assert len(rows) == 3000 and all(r["v"] is None for r in rows if r["k"] == "hot")


def test_the_salt_is_part_of_the_shuffle_key(spark):
    left = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joins.lookup(left, right, ["k"], ["id"], budget=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\d+L, __salt#\d+L", plan)


@pytest.mark.parametrize("budget", [joins.BROADCAST_BYTES, 0])
def test_tables_agree_with_column_functions(spark, corpus, budget):
    df, _ = corpus
    lexicon = spark.createDataFrame([(w, tag) for tag, ws in ts.annotate.CLOSED_CLASSES.items() for w in ws], "token string, pos string")
    by_table = entities.formality_by_table(df, "id", "text", lexicon, budget=budget)
    by_column = df.select("id", ts.formality_score(F.col("text")).alias("formality_score"))
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, by_column.collect()))

    names = {"Acme": "ORG", "the w1": "PRODUCT", "Ünit": "ORG", "w2": "GPE"}
    gazetteer = spark.createDataFrame(list(names.items()), "term string, label string")
    by_table = entities.entity_density_by_table(df, "id", "text", gazetteer, budget=budget)
    by_column = df.select("id", ts.entity_density(F.col("text"), names).alias("ner_density"))
    rows = sorted(map(tuple, by_column.collect()))
    assert sorted(map(tuple, by_table.collect())) == rows
    assert sum(r[1] or 0 for r in rows) > 0


def _occurrences(texts, terms):
    out = Counter()
    for i, t in texts:
        w = toks(t or "")
        for term in {tuple(toks(x)) for x in terms} - {()}:
            n = sum(tuple(w[at : at + len(term)]) == term for at in range(len(w)))
            if n:
                out[i, " ".join(term)] = n
    return out


@pytest.mark.parametrize("budget", [joins.BROADCAST_BYTES, 300, 0])
def test_terms_of_any_length(spark, monkeypatch, budget):
    """Terms of one to forty tokens, overlapping and within each other, in one shard or many."""
    monkeypatch.setattr(automaton, "TEXTS", 5)
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.integers(12))}"
    texts = [(i, " ".join(word() for _ in range(int(rng.integers(0, 90))))) for i in range(60)]
    terms = [" ".join(word() for _ in range(n)) for n in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(6)]
    terms += [" ".join(texts[i][1].split()[a : a + n]) for i, a, n in ((3, 2, 30), (3, 5, 20), (9, 0, 40), (11, 1, 5))] + ["unknown words", "W1, w2!", "", None, "é w1"]
    texts += [(60, None), (61, ""), (62, "w1 W2 é w1"), (63, "w1 " * 50)]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    found = {(r.id, r.term): r.n for r in automaton.term_occurrences(df, "id", "text", table, budget=budget).collect()}
    assert found == _occurrences(texts, [t for t in terms if t]) and len(found) > 200
    assert automaton.term_occurrences(df, "id", "text", table.limit(0), budget=budget).collect() == []
    gazetteer = table.withColumn("label", F.lit("ORG"))
    got = dict(map(tuple, entities.entity_density_by_table(df, "id", "text", gazetteer, budget=budget).collect()))
    per_text = Counter(i for i, _ in found)
    words = {i: len((t or "").split()) for i, t in texts}
    assert got == {i: per_text[i] / words[i] if words[i] else None for i, _ in texts}


def test_gazetteer_builds_no_runs_of_tokens(spark, corpus):
    df, _ = corpus
    gazetteer = spark.createDataFrame([(" ".join(f"w{i}" for i in range(30)), "ORG"), ("w1 w2", "ORG")], "term string, label string")
    plan = entities.entity_density_by_table(df, "id", "text", gazetteer)._jdf.queryExecution().executedPlan().toString()
    assert "slice" not in plan and "Generate" not in plan and "Exchange" not in plan


def test_merge(spark):
    left = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (3, "c", 3)], "id long, x string, l int")
    right = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "id long, x string")
    inner = joins.merge_on(left, right, "id")
    assert inner.columns == ["id", "x_x", "l", "x_y"]
    assert [tuple(r) for r in inner.collect()] == [(1, "a", 1, "p")]
    assert {tuple(r) for r in joins.merge_on(left, right, "id", null_keys_match=True).collect()} == {(1, "a", 1, "p"), (None, "b", 2, "q")}
    outer = joins.merge_on(left, right, "id", how="outer", null_keys_match=True)
    assert {r["id"] for r in outer.collect()} == {1, None, 3, 4} and outer.count() == 4


def test_vectors_travel_once_for_a_block_of_texts(spark, monkeypatch):
    """Tokens of many texts are joined once per block; small blocks, and ids that come twice, change no score."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(50)], k=40)), " ".join(rng.choices([f"w{j}" for j in range(60)], k=5))) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, text string, ref string").coalesce(1)
    vectors = spark.createDataFrame([(f"w{j}", [rng.gauss(0, 1) for _ in range(8)]) for j in range(45)], "token string, vector array<double>")
    pairs = df.select("id", similarity.tokens(F.col("text")).alias("c"), similarity.tokens(F.col("ref")).alias("r"))
    blocks = similarity._blocks(pairs, "id", 100)
    assert blocks.where("token IS NOT NULL").count() <= 60
    wanted = {r.id: r[1:] for r in similarity.greedy_similarity(df, "id", "text", "ref", vectors).collect()}
    for size, given in ((8 * 8 * 47, df.union(df)), (1, df)):
        monkeypatch.setattr(similarity, "BLOCK_BYTES", size)
        got = similarity.greedy_similarity(given, "id", "text", "ref", vectors, budget=0).collect()
        assert len(got) == 64 and all(r[1:] == pytest.approx(wanted[r.id], abs=1e-12) for r in got)


def test_formality_sends_distinct_tokens(spark):
    """A token travels once per text with its count; texts without tokens keep their row."""
    df = spark.createDataFrame([(1, "go go quickly the the the"), (2, " "), (3, None), (4, "***"), (None, "walking")], "id long, text string")
    rows = sorted(map(tuple, entities._counted_tokens(df, "id", "text").collect()), key=str)
    assert rows == sorted([(1, True, "go", 2, "NOUN"), (1, True, "quickly", 1, "ADV"), (1, True, "the", 3, "NOUN"), (2, False, None, 0, None), (3, False, None, 0, None), (4, True, None, 0, None), (None, True, "walking", 1, "VERB")], key=str)
    lexicon = spark.createDataFrame([("go", "VERB"), ("the", None)], "token string, pos string")
    for budget in (joins.BROADCAST_BYTES, 0):
        got = dict(map(tuple, entities.formality_by_table(df, "id", "text", lexicon, budget).collect()))
        assert got == {1: 1.0, 2: None, 3: None, 4: 0.0, None: 0.0}
