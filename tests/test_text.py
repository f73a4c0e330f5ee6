import random
import re

import pytest
from pyspark.sql import functions as F

from textscore import functions as ts
from textscore.functions import lexicons as lex
from textscore.functions import registry, text

ALPHABET = list("aeilouyé ñ.!?,;-'\n\t0123%$") + [" ", "\x1c", "ß", "É", "_", "ſ", "¿"]
VOCABULARY = [
    *lex.CAUSAL_CONNECTIVES, *lex.GROUNDED_EVIDENTIALS, *lex.UNGROUNDED_ASSERTIONS, *lex.HEDGES, *lex.BOOSTERS,
    *lex.MODALS, "maybe", "evidently", "the", "née", "table", "3.5%", "$1,000", "Q3 2024", "2024-03-31", "10:30",
    "Review", "It", "20 units", "...", "e.g.", "rhythm", "a", "éée",
]


def random_texts(n=300, seed=7):
    rng = random.Random(seed)
    out = ["", " ", " \x1f", None, "one"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 12)):
            word = rng.choice(VOCABULARY)
            word = rng.choice([word, word.upper(), word.title(), word.replace("s", "ſ")])
            noise = "".join(rng.choices(ALPHABET, k=rng.randint(0, 5)))
            parts += [word, rng.choice([" ", "  ", "\n", " ", ". ", "! ", ""]), noise]
        out.append("".join(parts))
    return out


def column(fn):
    return lambda name: fn(F.col(name))


def is_missing(t):
    return t is None or not t.strip()


def py_count(t, phrases):
    edge = r"[^\W]"
    return sum(1 for _ in re.finditer(rf"(?<!{edge})(?:{'|'.join(phrases)})(?!{edge})", t, re.IGNORECASE))


def test_blank_and_words_match_python(evaluate):
    values = random_texts()
    assert evaluate(column(ts.is_blank), values) == [is_missing(t) for t in values]
    assert evaluate(column(ts.word_count), values) == [max(len((t or "").split()), 1) for t in values]


def test_tokens_match_python(evaluate):
    values = [t for t in random_texts() if t is not None]
    assert evaluate(column(ts.tokens), values) == [re.findall(r"\b\w+\b", t.lower()) for t in values]
    assert evaluate(column(ts.token_count), values) == [len(re.findall(r"\w+", t)) for t in values]


@pytest.mark.parametrize("phrases", [lex.CAUSAL_CONNECTIVES, lex.GROUNDED_EVIDENTIALS, lex.UNGROUNDED_ASSERTIONS, lex.HEDGES, lex.BOOSTERS])
def test_phrases_match_python(evaluate, phrases):
    values = [t for t in random_texts() if t is not None]
    got = evaluate(lambda c: text.count_matches(F.col(c), text.phrase_pattern(phrases)), values)
    assert got == [py_count(t, phrases) for t in values]
    assert sum(got) > 20


def test_causal_density_by_hand(evaluate):
    got = evaluate(
        column(ts.causal_connective_density),
        ["Sales fell BECAUSE, as a result, costs rose.", "Thusly as a\nresult none", "", None, "thus thus"],
    )
    assert got == [2 / 8, 0.0, None, None, 1.0]


def test_evidentiality_by_hand(evaluate):
    got = evaluate(
        column(ts.evidentiality_index),
        ["The data shows and KPIs indicate it; it is clear. Clearly evident.", "Based on x, metrics reveal y", "nothing", " "],
    )
    assert [(g or {}).get("evidentiality_ratio") for g in got] == [2 / 3, 2.0, 0.0, None]
    assert (got[0]["grounded_count"], got[0]["ungrounded_count"]) == (2.0, 3.0)
    assert got[3] is None or set(got[3].values()) == {None}


def test_hedging_by_hand(evaluate):
    got = evaluate(column(ts.hedging_calibration), ["It may, might and must always work", "perhaps likely", "must"])
    assert got[0] == {"hedge_to_booster_ratio": 1.0, "hedge_density": 2 / 7, "booster_density": 2 / 7}
    assert got[1]["hedge_to_booster_ratio"] == 2.0
    assert got[2]["hedge_to_booster_ratio"] == 0.0


def test_modals_match_python(evaluate):
    values = random_texts()
    got = evaluate(column(ts.modal_verb_profile), values)
    for t, g in zip(values, got):
        if is_missing(t):
            assert g is None or set(g.values()) == {None}
            continue
        words = re.findall(r"\b\w+\b", t.lower())
        for m in lex.MODALS:
            assert g[f"modal_{m}_freq"] == words.count(m) / max(len(t.split()), 1)


def test_lists_can_be_replaced(evaluate):
    assert evaluate(lambda c: ts.causal_connective_density(F.col(c), ["weil"]), ["gut, weil WEIL"]) == [2 / 3]


def test_sentences(evaluate):
    values = ["One. Two! Three?", "No end", "Price is 3.5 now. Ok", "Wait... what?!", "..." * 3000 + "a", ". ", "", "End.\n"]
    assert evaluate(column(ts.sentence_count), values) == [3, 1, 2, 2, 1, 1, None, 1]
    pieces = evaluate(column(ts.sentences), values)
    assert [len(p) for p in pieces] == [3, 1, 2, 2, 1, 1, 0, 1]
    assert pieces[0] == ["One.", "Two!", "Three?"]


def test_quantities_by_hand(evaluate):
    values = ["It rose 3.5% to $1,200.50 million on 2024-03-31 in Q3 2024 at 10:30, 20 units, 7.", "none", None]
    spans = evaluate(column(text.quantity_spans), values)
    assert spans[0] == ["3.5%", "$1,200.50 million", "2024-03-31", "Q3 2024", "10:30", "20 units", "7"]
    assert evaluate(column(ts.quantification_density), values) == [7.0, 0.0, None]
    labels = evaluate(lambda c: F.transform(text.quantity_spans(F.col(c)), text.span_label), values[:1])
    assert labels == [["PERCENT", "MONEY", "DATE", "DATE", "TIME", "QUANTITY", "CARDINAL"]]


def test_long_number_runs_do_not_overflow(evaluate):
    assert evaluate(column(ts.quantification_density), ["1,2." * 60_000 + "3"]) == [1.0]


def test_entities_are_distinct_and_lower_cased(evaluate):
    names = {"Acme Corp": "ORG", "Widget": "PRODUCT", "Paris": "GPE"}
    got = evaluate(
        lambda c: ts.entity_density(F.col(c), names), ["ACME corp sold a widget to acme  Corp in Paris for 5% and 5%.", " ", "acme corpus"]
    )
    assert got == [3 / 14, None, 0.0]


def test_formality_and_mood(evaluate):
    # report NOUN, shows NOUN, growth NOUN, in ADP, sales NOUN / quickly ADV, it PRON
    assert evaluate(column(ts.formality_score), ["Report shows growth in sales; it quickly", "the and", None]) == [2.5, 0.0, None]
    values = ["Review the plan. Cut cost now! We grew.", "Cut cost", "*** ", "It works. *** ", ""]
    assert evaluate(column(ts.mood_ratio), values) == [2.0, 1.0, 0.0, 0.0, None]


def py_syllables(t):
    total = 0
    for w in re.findall(r"[^\W]+", t.lower()):
        groups = len(re.findall("[aeiouyàâäéèêëîïôöùûüáíóúñ]+", w))
        total += max(1, groups - bool(re.search("[^aeiouyl]e$", w)))
    return total


def test_syllables_match_the_rule_per_token(evaluate):
    values = [t for t in random_texts() if t is not None] + ["the née éée table e é rhythm tsk ale be eé ée"]
    assert evaluate(column(ts.syllable_count), values) == [py_syllables(t) for t in values]


def test_readability_formulas(evaluate):
    t = "The cat sat. It ran away home."
    words, sentences, syll = 7, 2, py_syllables(t)
    assert evaluate(column(ts.flesch_reading_ease), [t, "...", None])[0] == pytest.approx(206.835 - 1.015 * words / sentences - 84.6 * syll / words)
    assert evaluate(column(ts.flesch_kincaid_grade), [t, "...", None]) == [pytest.approx(0.39 * words / sentences + 11.8 * syll / words - 15.59), None, None]


def test_labels(evaluate):
    names = ["Average Overall Quality Index by Model", "HTTPServer2Go", "already_snake"]

    def python(t):
        first = re.sub("(.)([A-Z][a-z]+)", r"\1_\2", t)
        return re.sub("([a-z0-9])([A-Z])", r"\1_\2", first).lower()

    assert evaluate(column(ts.to_snake_case), names) == [python(n) for n in names]
    assert evaluate(column(ts.clean_label), ["norm_answer_modal_must_freq", "norm_answer_hedge_density"]) == ["Modal Must", "Hedge"]


def test_registry_takes_native_and_pandas_measures(texts):
    import pandas as pd

    @F.pandas_udf("double")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.count("!").astype(float)

    registry.register("shout", shout, replace=True)
    registry.register("double_words", lambda c: ts.word_count(c) * 2, replace=True)
    row = registry.add_measures(texts(["Hi! there!"]), "text", ["shout", "double_words", "causal_density"]).first()
    assert (row["shout"], row["double_words"], row["causal_density"]) == (2.0, 4, 0.0)
    with pytest.raises(ValueError):
        registry.register("shout", shout)
    with pytest.raises(KeyError):
        registry.measure("nope")


def test_measures_from_sql(spark, texts):
    """Every registered measure called from SQL equals its Column form and runs no Python."""
    values = [None, "", "  ", "It's 3.5% - \\n 'quoted' `x`; we MAY, perhaps. Go!", "Costs fell on 2024-03-31 because of Ünit.\nRun. Must we? $15M", "the cat"]
    texts(values).createOrReplaceTempView("sql_texts")
    # other tests may have registered measures of their own
    own = [n for n in ts.names() if n != "shout"]
    assert ts.register_sql(spark, own, prefix="m_") == ["m_" + n for n in own] and len(own) >= 12
    for name in own:
        called = spark.sql(f"SELECT id, m_{name}(text) AS v FROM sql_texts ORDER BY id")
        assert "Python" not in called._jdf.queryExecution().executedPlan().toString()
        assert called.collect() == spark.table("sql_texts").select("id", ts.measure(name)(F.col("text")).alias("v")).orderBy("id").collect()
    whole = spark.sql("SELECT count(*) AS n, max(m_word_count(text)) AS w FROM sql_texts WHERE m_sentence_count(text) > 1").first()
    assert whole.n == 2 and whole.w > 5


def test_python_measures_have_no_sql(spark):
    ts.register("shout", F.pandas_udf(lambda s: s.str.upper(), "string"), replace=True)
    try:
        with pytest.raises(ValueError, match="Python"):
            ts.register_sql(spark, ["shout"])
    finally:
        ts.registry._MEASURES.pop("shout")
