import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textscore import functions as ts
from textscore.functions import judgments
from textscore.operators import claims

MARKDOWN = "# Title\n## Observations\n\n Sales fell.\n### Detail\nmore\n## interpretations \nIt may be price.\n## RECOMMENDATIONS\nCut cost.\n## Notes\nlast \n"


def test_sections(evaluate):
    values = [MARKDOWN, "no headings", "## Observations", "text ## Observations x", None]
    observed = evaluate(lambda c: ts.extract_observations(F.col(c)), values)
    assert observed == ["Sales fell.\n### Detail\nmore", "", "", "", None]
    assert evaluate(lambda c: ts.extract_interpretations(F.col(c)), values[:1]) == ["It may be price."]
    assert evaluate(lambda c: ts.extract_recommendations(F.col(c)), values[:1]) == ["Cut cost.\n## Notes\nlast"]
    # recommendations need a word edge, the other headings do not
    assert evaluate(lambda c: ts.extract_recommendations(F.col(c)), ["## recommendationsX\na"]) == [""]
    assert evaluate(lambda c: ts.extract_observations(F.col(c)), ["##observations\ta\n##b\n## c"]) == ["a\n##b"]
    with pytest.raises(ValueError):
        ts.extract_section(F.lit("x"), "summary")


def fence(value):
    return "Sure.\n```json\n" + (value if isinstance(value, str) else json.dumps(value)) + "\n```\nBye ```json [] ```"


CHAINS = [
    {"observations": ["b", "a"], "hypotheses": ["h"], "recommendations": "r1", "is_reasoning_valid": True},
    {"observations": "single", "recommendations": ["r2", "r3"], "is_reasoning_valid": "false"},
    {"observations": ["a"], "hypotheses": None, "recommendations": "r4"},
]


def test_judgments(evaluate):
    replies = [fence(CHAINS), fence(CHAINS[0]), fence([]), fence('[{"a: 1}]'), json.dumps(CHAINS), None]
    judged = evaluate(lambda c: ts.evaluate_reasoning(ts.judgment_of_reply(F.col(c))), replies)
    counts = [j and (j["correct_reasoning_count"], j["total_reasoning_to_verify"], j["reasoning_percentage"]) for j in judged]
    assert counts == [(1, 3, 1 / 3), (1, 1, 1.0), (0, 0, None), None, None, None]
    facts = evaluate(lambda c: ts.observations_and_hypotheses(ts.judgment_of_reply(F.col(c))), replies)
    assert facts == [["a", "b", "h", "single"], ["a", "b", "h"], [], None, None, None]
    recs = evaluate(lambda c: ts.recommendations(ts.judgment_of_reply(F.col(c))), replies)
    assert recs[:2] == [["r1", "r2", "r3", "r4"], ["r1"]]


def test_request_format(evaluate):
    got = evaluate(lambda c: ts.judge_request(F.col(c), F.lit("obs")), ["ans", None])
    assert got == [
        "<LLM generated text>\nans\n<\\LLM generated text>\n\n<Human Observations and Hypotheses>obs\n<\\Human Observations and Hypotheses>",
        None,
    ]


def test_flatten_claims(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]], ["a", '["b", "c"]', "[sic] d"])], "n array<array<string>>, m array<string>")
    row = df.select(judgments.flatten_claims(F.col("n"), True).alias("n"), judgments.flatten_claims(F.col("m")).alias("m")).first()
    assert row["n"] == ["a", "b", "c"]
    assert row["m"] == ["a", "b", "c", "[sic] d"]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        (1, ["costs rise fast", "costs", "???"], ["costs fall", "prices rise", "costs rise"]),
        (2, ["a b"], ["b x", "a y"]),  # a tie: the first premise wins
        (3, [], ["x"]),
        (4, ["x"], []),
        (5, None, ["x"]),
        (6, ["x"], None),
    ]
    return spark.createDataFrame(rows, "id long, c array<string>, p array<string>")


def verdict_map(df):
    return {r["id"]: r["verdicts"] and [tuple(v) for v in r["verdicts"]] for r in df.collect()}


def test_verdicts(pairs):
    got = verdict_map(claims.add_verdicts(pairs, "c", "p"))
    assert got[1] == [("costs rise fast", 2 / 3, "costs rise"), ("costs", 1.0, "costs fall"), ("???", 0.0, "costs fall")]
    assert got[2] == [("a b", 0.5, "b x")]
    assert got[3] == []
    assert got[4] == [("x", -1.0, "")]
    assert got[5] is None and got[6] is None
    first_two = verdict_map(claims.add_verdicts(pairs, "c", "p", k=2))
    assert first_two[1][0] == ("costs rise fast", 1 / 3, "costs fall")


@pytest.mark.parametrize("shared", [1, 50, 1 << 21])
def test_index_equals_every_pair(spark, monkeypatch, shared):
    """The in-row index against one intersection per claim and premise, NULLs, ties and long lists included."""
    monkeypatch.setattr(claims, "SHARED", shared)
    monkeypatch.setattr(claims, "ROWS", 3)
    rng = random.Random(shared)
    text = lambda: rng.choice([None, "", "?", *[" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))] * 20])
    rows = [(i, [text() for _ in range(rng.randint(0, 6))], [text() for _ in range(rng.randint(0, 7))]) for i in range(40)]
    rows += [(40, None, ["a"]), (41, ["a"], None), (42, ["a b", "c"], [None, None]), (43, [text() for _ in range(80)], [text() for _ in range(90)])]
    df = spark.createDataFrame(rows, "id long, c array<string>, p array<string>")

    def verdict(claim, premises):
        best, evidence = -1.0, ""
        for premise in premises:
            if claim is not None and premise is not None:
                mine, other = set(re.findall(r"\w+", claim)), set(re.findall(r"\w+", premise))
                value = len(mine & other) / max(1, len(mine))
                if value > best:
                    best, evidence = value, premise
        return claim, best, evidence

    for k in (None, 2):
        got = verdict_map(claims.add_verdicts(df, "c", "p", k=k))
        assert got == {i: None if c is None or p is None else [verdict(x, p[:k]) for x in c] for i, c, p in rows}


def test_own_scorer_runs_per_batch_and_missing_scores_do_not_count(pairs):
    def factory():
        return lambda left, right: [math.nan if "x" in b else (None if "y" in b else len(b) / 100) for b in right]

    got = verdict_map(claims.add_verdicts(pairs, "c", "p", scorer=factory))
    assert got[1][1] == ("costs", 0.11, "prices rise")
    assert got[2] == [("a b", -1.0, "")]
    assert got[3] == [] and got[5] is None and got[6] is None


def test_own_scorer_gets_bounded_slices_and_no_other_column(spark, monkeypatch):
    monkeypatch.setattr(claims, "PAIRS", 4)

    def factory():
        def score(left, right):
            assert 0 < len(left) == len(right) <= 4
            return [len(a) / 100 for a in left]

        return score

    df = spark.createDataFrame([(i, ["a" * i, "b"], ["p"] * 5, "not sent") for i in range(1, 9)], "id long, c array<string>, p array<string>, long_text string")
    out = claims.add_verdicts(df, "c", "p", scorer=factory)
    assert {r["id"]: r["verdicts"][0]["p"] for r in out.collect()} == {i: i / 100 for i in range(1, 9)}
    plan = out.select("id", "verdicts")._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(sent) == 1 and "long_text" not in sent[0]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_missing_lists_score_null_in_both_modes(spark, pairs, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        scored = claims.add_verdicts(pairs, "c", "p").select("id", claims.support_precision(F.col("verdicts")).alias("v"))
        assert {r["id"]: r["v"] for r in scored.collect()} == {1: 2 / 3, 2: 1.0, 3: None, 4: 0.0, 5: None, 6: None}
        ref = F.when(F.col("id") != 2, F.lit("costs rise"))
        shares = pairs.select("id", claims.evaluate_factuality(F.col("c"), ref).alias("v"), claims.evaluate_actionability(F.col("c"), ref).alias("w"))
        assert {r["id"]: r["v"] for r in shares.collect()} == {r["id"]: r["w"] for r in shares.collect()} == {1: 2 / 3, 2: None, 3: None, 4: 0.0, 5: None, 6: 0.0}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_own_scorer_agrees_with_the_native_one(pairs):
    def factory():
        def score(left, right):
            import re

            out = []
            for a, b in zip(left, right):
                ta, tb = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
                out.append(len(ta & tb) / max(len(ta), 1))
            return out

        return score

    assert verdict_map(claims.add_verdicts(pairs, "c", "p", scorer=factory)) == verdict_map(claims.add_verdicts(pairs, "c", "p"))


def test_labels_use_the_unrounded_score(spark):
    df = spark.createDataFrame([(1, [("c", 0.0996, "e"), ("d", 0.0625, "e")])], "id long, verdicts array<struct<claim:string,p:double,evidence:string>>")
    first, second = claims.per_claim(df, "id").orderBy("claim_pos").collect()
    assert (first["p"], first["label_10"]) == (0.1, "NOT_ALIGN")
    assert second["p"] == 0.062


def test_summary_and_precision(pairs):
    scored = claims.add_verdicts(pairs, "c", "p")
    rows = claims.claim_summary(scored, "id", "facts").filter("id = 1 AND summary = 'facts_50_summary'").collect()
    assert {(r["label"], r["n"], r["total"]) for r in rows} == {("ALIGN", 2, 3), ("NOT_ALIGN", 1, 3)}
    got = {r["id"]: r["v"] for r in scored.select("id", claims.support_precision(F.col("verdicts")).alias("v")).collect()}
    assert got == {1: 2 / 3, 2: 1.0, 3: None, 4: 0.0, 5: None, 6: None}
    direct = pairs.select("id", claims.evaluate_factuality(F.col("c"), F.lit("costs rise")).alias("v"))
    assert {r["id"]: r["v"] for r in direct.collect()} == {1: 2 / 3, 2: 0.0, 3: None, 4: 0.0, 5: None, 6: 0.0}


def test_batches_are_judged_in_slices():
    """Arrow batches of any length: results leave in slices of rows, equal to those of single rows."""
    rows = [[{"claims": [f"c{i}"] * (i % 3), "premises": ["c1", f"c{i} x"]}] for i in range(150)]
    kind = pa.list_(pa.struct([("claims", pa.list_(pa.string())), ("premises", pa.list_(pa.string()))]))
    score = lambda left, right: [float(a == b) for a, b in zip(left, right)]
    parts = list(claims._judge_batches(score, iter([pa.array(rows, kind), pa.array([], kind)])))
    assert [len(x) for x in parts] == [64, 64, 22]
    assert [v for x in parts for v in x.to_pylist()] == [v for r in rows for x in claims._judge_batches(score, iter([pa.array([r], kind)])) for v in x.to_pylist()]


def test_index_support_leaves_in_slices():
    texts = pa.array([[["a", f"w{i}"]] * (i % 3) for i in range(600)], pa.list_(pa.list_(pa.string())))
    parts = list(claims._index_support.func(iter([(texts, texts)])))
    assert [len(x) for x in parts] == [256, 256, 88]
    assert [len(r) for x in parts for r in x.to_pylist()] == [i % 3 for i in range(600)]
    assert all(v["p"] == 1.0 and v["at"] == 1 for x in parts for r in x.to_pylist() for v in r)
