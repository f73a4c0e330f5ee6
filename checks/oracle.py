"""The same results in SQL for DuckDB, written from the definitions, not from the Spark code."""

from __future__ import annotations

from textscore.functions import lexicons as lex
from textscore.operators.reports import CORRELATED, GAP_FEATURES

from . import planted

T = planted.duckdb_table
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
PARTS = {
    "PERCENT": rf"{NUMBER}\s?(?:%|percent)",
    "MONEY": rf"[$€£]\s?{NUMBER}(?:\s?(?:million|billion|[KMB]))?",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|Q[1-4](?:\s[0-9]{4})?",
    "TIME": r"[0-9]{1,2}:[0-9]{2}",
    "QUANTITY": rf"{NUMBER}\s?(?:kg|km|hours|days|units)",
    "CARDINAL": NUMBER,
}
QUANTITY = "|".join(PARTS.values())

SQL: dict[str, str] = {}


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items())


ANSWERS = {"answers": planted.answers(T)}
REPLIES = {"replies": planted.replies(T)}
METRICS = {"metrics": planted.metrics(T)}


def add(name: str, select: str, **parts: str) -> None:
    SQL[name] = (ctes(**parts) + "\n" if parts else "") + select


# ---- text expressions ----


def found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def nonblank(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '[^{SPACES}]'), false)"


def words(text: str) -> str:
    return found(text, f"[^{SPACES}]+")


def toks(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{W}+')"


def cue(text: str, phrases) -> str:
    """RE2 has no look-around: double every separator, so that neighbours keep one each."""
    doubled = f"regexp_replace({text}, '({NW})', '\\1\\1', 'g')"
    listed = "|".join(p.replace(" ", "  ") for p in phrases)
    return found(doubled, f"(?i)(?:^|{NW})(?:{listed})(?:$|{NW})")


def n_sentences(text: str) -> str:
    ends = found(text, r"[.!?]+(?:\s+|\z)")
    return f"({ends} + CASE WHEN regexp_matches({text}, '[.!?]+\\s*\\z') THEN 0 ELSE 1 END)"


def sentence_list(text: str) -> str:
    """Split after a terminator: mark the ends, split on the mark, drop blank pieces."""
    marked = f"regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(7), 'g')"
    return f"list_filter(string_split({marked}, chr(7)), lambda s: regexp_matches(s, '[^{SPACES}]'))"


def balance(plus: str, minus: str) -> str:
    return f"({plus})::DOUBLE / greatest({minus}, 1)"


def when_text(text: str, value: str) -> str:
    return f"CASE WHEN {nonblank(text)} THEN {value} END"


def both_sides(measures) -> str:
    cols = []
    for side in ("answer", "human_answer"):
        cols += [f"{value} AS {side}_{name}" for name, value in measures(side).items()]
    return "SELECT id, " + ", ".join(cols) + " FROM answers"


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


SYLLABLES = r"[aeiouyàâäéèêëîïôöùûüáíóúñ]+"


def syllables(text: str) -> str:
    one = (
        f"greatest(1, len(regexp_extract_all(w, '{SYLLABLES}'))"
        " - CASE WHEN regexp_matches(w, '[^aeiouyl]e$') THEN 1 ELSE 0 END)"
    )
    return f"coalesce(list_sum(list_transform({toks(text)}, lambda w: {one})), 0)::BIGINT"


def section(name: str) -> str:
    head = rf"(?msi)^##[{SPACES}]*{name}"
    if name == "recommendations":
        pattern = rf"{head}\b[{SPACES}]*(.*)\z"
    else:
        pattern = rf"{head}[{SPACES}]*(.*?)(?:^##[{SPACES}]|\z)"
    body = f"regexp_extract(human_answer, '{pattern}', 1)"
    return f"regexp_replace({body}, '\\A[{SPACES}]+|[{SPACES}]+\\z', '', 'g')"


FENCED = "nullif(regexp_extract(reply, '(?s)```json\\s*(.*?)\\s*```', 1), '')"
JUDGED = {
    **REPLIES,
    "fenced": f"SELECT id, human_answer, {FENCED} AS js FROM replies",
    "valid": "SELECT id, human_answer, CASE WHEN js IS NOT NULL AND json_valid(js) THEN js::JSON END AS j FROM fenced",
    "judged": """SELECT id, human_answer, CASE WHEN j IS NULL THEN NULL
        WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END AS chains FROM valid""",
}


def json_list(field: str) -> str:
    value = f"json_extract(c, '$.{field}')"
    return (
        f"CASE WHEN {value} IS NULL THEN []::VARCHAR[] WHEN json_type({value}) = 'ARRAY'"
        f" THEN from_json({value}, '[\"VARCHAR\"]') ELSE [json_extract_string(c, '$.{field}')] END"
    )


def gathered(*fields: str) -> str:
    lists = " || ".join(f"({json_list(f)})" for f in fields)
    return f"flatten(list_transform(chains, lambda c: {lists}))"


FACTS = f"list_sort(list_distinct({gathered('observations', 'hypotheses')}))"
RECS = gathered("recommendations")
CLAIMS = {
    **JUDGED,
    "claims": f"""SELECT id, CASE WHEN chains IS NOT NULL THEN {FACTS} END AS facts,
        CASE WHEN chains IS NOT NULL THEN {RECS} END AS recs,
        {section('observations')} || chr(10) || {section('interpretations')} AS fact_ref,
        {section('recommendations')} AS rec_ref, chains FROM judged""",
}


def support(claim: str, premise: str) -> str:
    ct, pt = f"list_distinct({toks(claim)})", f"list_distinct({toks(premise)})"
    return f"len(list_intersect({ct}, {pt}))::DOUBLE / greatest(len({ct}), 1)"


def share(claims: str, ref: str) -> str:
    return (
        f"CASE WHEN len({claims}) > 0 AND {ref} IS NOT NULL THEN len(list_filter({claims}, lambda c: {support('c', ref)} >= 0.5))::DOUBLE"
        f" / len({claims}) END"
    )


# ---- scans, projections, joins ----

add(
    "evaluation_input",
    """SELECT a.id, strategy, category, length(answer) AS answer_chars, len(facts) AS n_facts, len(recs) AS n_recs,
    length(fact_ref) AS reference_chars, chains IS NOT NULL AS judged FROM answers a JOIN claims c ON c.id = a.id""",
    **ANSWERS,
    **CLAIMS,
)
add(
    "analysis_frame",
    "SELECT id, strategy, department, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM answers LEFT JOIN labels ON doc_id = id",
    **ANSWERS,
)
add(
    "merge_with_suffixes",
    "SELECT d.id, d.lang, d.n AS n_x, l.n AS n_y FROM d JOIN l ON d.id IS NOT DISTINCT FROM l.id",
    d="SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS id, lang, length(text) AS n FROM documents",
    l="SELECT CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS id, max(quality)::BIGINT AS n FROM labels GROUP BY 1",
)
add("blank_texts", f"SELECT id, NOT {nonblank('answer')} AS blank FROM answers", **ANSWERS)
add(
    "complete_rows",
    """SELECT id, strategy, clarity_score_avg, flesch_reading_ease, factuality_precision_50 AS factuality FROM metrics
    WHERE department IS NOT NULL AND category IS NOT NULL AND strategy IS NOT NULL AND clarity_score_avg IS NOT NULL""",
    **METRICS,
)
add(
    "labelled_answers",
    """SELECT department AS label, id, strategy FROM answers WHERE strategy IN ('cot', 'symcot') AND department IN
    (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'sales' ELSE 'marketing' END FROM nation)""",
    **ANSWERS,
)
add("distinct_strategies", "SELECT DISTINCT strategy FROM metrics", **METRICS)
_profile_types = {"id": "bigint", "strategy": "string", "department": "string", "category": "string"}
_profile_columns = [*_profile_types, *planted.METRIC_COLUMNS]
add(
    "dataset_profile",
    "\nUNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{_profile_types.get(c, 'double')}' AS type,"
        f" count({c}) AS non_null, count(*) AS n_rows FROM metrics"
        for i, c in enumerate(_profile_columns)
    ),
    **METRICS,
)
add(
    "scoped_sample",
    """SELECT id, department, strategy FROM answers WHERE department IN ('sales', 'marketing', 'development')
    QUALIFY row_number() OVER (PARTITION BY department, strategy ORDER BY md5('42:' || id::VARCHAR), id) <= 20""",
    **ANSWERS,
)
for _fmt in ("parquet", "json", "csv"):
    add(
        f"sink_{_fmt}",
        f"SELECT id, strategy, md5(answer) AS answer_md5, len({toks('human_answer')}) AS n_tokens FROM answers",
        **ANSWERS,
    )

# ---- per-text measures ----

add(
    "text_counts",
    f"""SELECT id, greatest(coalesce({words('answer')}, 0), 1) AS n_words, len({toks('answer')}) AS n_tokens,
    {when_text('answer', n_sentences('answer'))} AS n_sentences FROM answers""",
    **ANSWERS,
)
add(
    "sentence_table",
    "SELECT id, i - 1 AS pos, md5(pieces[i]) AS sentence_md5 FROM split, unnest(range(1, len(pieces) + 1)) AS u(i)",
    **ANSWERS,
    split=f"SELECT id, {sentence_list('answer')} AS pieces FROM answers WHERE answer IS NOT NULL",
)
add(
    "token_frequencies",
    "SELECT token, count(*) AS n FROM t GROUP BY token",
    **ANSWERS,
    t=f"SELECT unnest({toks('answer')}) AS token FROM answers",
)
add(
    "causal_density",
    both_sides(
        lambda s: {"causal_density": when_text(s, f"{cue(s, lex.CAUSAL_CONNECTIVES)}::DOUBLE / {words(s)}")}
    ),
    **ANSWERS,
)


def _evidence(s: str) -> dict[str, str]:
    g, u = cue(s, lex.GROUNDED_EVIDENTIALS), cue(s, lex.UNGROUNDED_ASSERTIONS)
    return {
        "evidentiality_ratio": when_text(s, balance(g, u)),
        "grounded_count": when_text(s, f"{g}::DOUBLE"),
        "ungrounded_count": when_text(s, f"{u}::DOUBLE"),
    }


def _hedging(s: str) -> dict[str, str]:
    h, b = cue(s, lex.HEDGES), cue(s, lex.BOOSTERS)
    return {
        "hedge_to_booster_ratio": when_text(s, balance(h, b)),
        "hedge_density": when_text(s, f"{h}::DOUBLE / {words(s)}"),
        "booster_density": when_text(s, f"{b}::DOUBLE / {words(s)}"),
    }


def _modals(s: str) -> dict[str, str]:
    return {
        f"modal_{m}_freq": when_text(s, f"len(list_filter({toks(s)}, lambda w: w = '{m}'))::DOUBLE / {words(s)}")
        for m in lex.MODALS
    }


def _quantities(s: str) -> dict[str, str]:
    return {"quantification_density": when_text(s, f"{found(s, QUANTITY)}::DOUBLE / {n_sentences(s)}")}


add("evidentiality", both_sides(_evidence), **ANSWERS)
add("hedging", both_sides(_hedging), **ANSWERS)
add("modal_profile", both_sides(_modals), **ANSWERS)
add(
    "quantification",
    f"SELECT id, {found('answer', QUANTITY)} AS n_quantities, {_quantities('answer')['quantification_density']} AS quantification_density FROM answers",
    **ANSWERS,
)


def label_of(span: str) -> str:
    tests = " ".join(f"WHEN regexp_full_match({span}, '{p}') THEN '{name}'" for name, p in PARTS.items())
    return f"CASE {tests} END"


add(
    "quantity_labels",
    f"SELECT {label_of('span')} AS label, count(*) AS n FROM spans GROUP BY 1",
    **ANSWERS,
    spans=f"SELECT unnest(regexp_extract_all(answer, '{QUANTITY}')) AS span FROM answers",
)
ENTITY_SPANS = {
    "found": f"SELECT id, unnest(regexp_extract_all(answer, '{QUANTITY}')) AS span FROM answers",
    "spans": f"SELECT DISTINCT id, lower(span) AS entity FROM found WHERE {label_of('span')} IN ('MONEY', 'PERCENT', 'DATE')",
}


def density(entities: str) -> str:
    return f"""SELECT a.id, {when_text('answer', f"coalesce(n, 0)::DOUBLE / {words('answer')}")} AS ner_density
    FROM answers a LEFT JOIN (SELECT id, count(*) AS n FROM {entities} GROUP BY id) e ON e.id = a.id"""


add("entity_density", density("spans"), **ANSWERS, **ENTITY_SPANS)
add(
    "entity_density_table",
    density("entities"),
    **ANSWERS,
    **ENTITY_SPANS,
    terms=f"SELECT DISTINCT array_to_string({toks('term')}, ' ') AS term FROM ({planted.gazetteer(T)}) WHERE label IN ('ORG', 'PRODUCT')",
    # a term occurs where its tokens stand in a row: compare token strings with edges
    spaced=f"SELECT id, ' ' || array_to_string({toks('answer')}, ' ') || ' ' AS line FROM answers",
    hits="SELECT id, term AS entity FROM spaced JOIN terms ON contains(line, ' ' || term || ' ')",
    entities="SELECT id, entity FROM spans UNION SELECT id, entity FROM hits",
)


def tag_of(token: str, closed: bool = True) -> str:
    tests = []
    if closed:
        for name, listed in lex.CLOSED_CLASSES.items():
            tests.append(f"WHEN {token} IN ({', '.join(repr(w) for w in listed)}) THEN '{name}'")
    for name, endings in lex.SUFFIX_RULES:
        tests.append("WHEN " + " OR ".join(f"{token} LIKE '%{e}'" for e in endings) + f" THEN '{name}'")
    return f"CASE {' '.join(tests)} ELSE 'NOUN' END"


_TOKENS = {"t": f"SELECT id, unnest({toks('answer')}) AS token FROM answers"}
_FORMAL = """SELECT a.id, {score} AS formality_score FROM answers a LEFT JOIN
    (SELECT id, count(*) FILTER (tag IN ('NOUN', 'PROPN', 'ADJ', 'ADP')) AS f,
     count(*) FILTER (tag IN ('VERB', 'ADV', 'PRON', 'INTJ')) AS i FROM tagged GROUP BY id) s ON s.id = a.id""".format(
    score=when_text("answer", balance("coalesce(f, 0)", "coalesce(i, 0)"))
)
add("formality", _FORMAL, **ANSWERS, **_TOKENS, tagged=f"SELECT id, {tag_of('token')} AS tag FROM t")
add(
    "formality_table",
    _FORMAL,
    **ANSWERS,
    **_TOKENS,
    tagged=f"""SELECT id, CASE WHEN token IN (SELECT lower(n_name) FROM nation) THEN 'PROPN' ELSE {tag_of('token')} END AS tag FROM t""",
)
_FIRST = f"regexp_extract_all(lower(answer), '(?:\\A|[.!?]\\s+){NW}*({W}+)', 1)"
_VERBS = ", ".join(repr(v) for v in lex.BASE_VERBS)
add(
    "sentence_mood",
    f"SELECT id, {when_text('answer', balance('i', 'n - i'))} AS imperative_to_declarative_ratio FROM c",
    **ANSWERS,
    f=f"SELECT id, answer, {_FIRST} AS firsts FROM answers",
    c=f"SELECT id, answer, len(firsts) AS n, len(list_filter(firsts, lambda w: w IN ({_VERBS}))) AS i FROM f",
)
_COUNTS = {
    "counts": f"""SELECT id, {syllables('answer')} AS syl, len({toks('answer')}) AS tok,
    {when_text('answer', n_sentences('answer'))} AS sen, answer FROM answers"""
}


def flesch(base: float, per_sentence: float, per_syllable: float) -> str:
    return f"CASE WHEN tok > 0 THEN round({base} + {per_sentence} * (tok / sen) + {per_syllable} * (syl / tok), 6) END"


EASE, GRADE = flesch(206.835, -1.015, -84.6), flesch(-15.59, 0.39, 11.8)
add(
    "readability",
    f"SELECT id, CASE WHEN answer IS NOT NULL THEN syl END AS n_syllables, {EASE} AS flesch_reading_ease, {GRADE} AS flesch_kincaid_grade FROM counts",
    **ANSWERS,
    **_COUNTS,
)


def title(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


_camel = f"({title('p_type')} || 'Of' || p_name)"
_pass1 = f"regexp_replace({_camel}, '([^\\n])([A-Z][a-z]+)', '\\1_\\2', 'g')"
add("snake_case_names", f"SELECT p_partkey, lower(regexp_replace({_pass1}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM part")
add("readable_labels", f"SELECT p_partkey, {title('lower(p_type)')} AS label FROM part")
add(
    "custom_measure",
    f"""SELECT id, {when_text('answer', f"(length(answer) - length(replace(answer, ',', '')))::DOUBLE / {words('answer')}")} AS comma_density,
    greatest(coalesce({words('answer')}, 0), 1) AS word_count FROM answers""",
    **ANSWERS,
)

# ---- sections, judgments, claims ----

add(
    "human_sections",
    "SELECT id, " + ", ".join(f"{section(s)} AS {s}" for s in lex.SECTIONS) + " FROM answers",
    **ANSWERS,
)
add(
    "judge_requests",
    "SELECT id, md5(q) AS request_md5, length(q) AS n_chars FROM asked",
    **ANSWERS,
    asked=f"""SELECT id, '<LLM generated text>' || chr(10) || answer || chr(10) || '<' || chr(92) || 'LLM generated text>' || chr(10) || chr(10)
    || '<Human Observations and Hypotheses>' || {section('observations')} || chr(10) || '<' || chr(92)
    || 'Human Observations and Hypotheses>' AS q FROM answers WHERE answer IS NOT NULL AND human_answer IS NOT NULL""",
)
_VALID = "len(list_filter(chains, lambda c: coalesce(json_extract(c, '$.is_reasoning_valid')::VARCHAR = 'true', false)))"
add(
    "reasoning_validity",
    f"""SELECT id, {_VALID} AS correct_reasoning_count, len(chains) AS total_reasoning_to_verify,
    CASE WHEN len(chains) > 0 THEN {_VALID}::DOUBLE / len(chains) END AS reasoning_percentage FROM judged""",
    **JUDGED,
)
add(
    "judged_claims",
    """SELECT id, 'fact' AS kind, i - 1 AS pos, md5(facts[i]) AS claim_md5 FROM claims, unnest(range(1, len(facts) + 1)) AS u(i)
    UNION ALL SELECT id, 'rec', i - 1, md5(recs[i]) FROM claims, unnest(range(1, len(recs) + 1)) AS u(i)""",
    **CLAIMS,
)
_flat = f"md5(array_to_string({sentence_list('human_answer')} || ['Act.', 'Wait.'], '|'))"
add("nested_claims", f"SELECT id, {_flat} AS nested_md5, {_flat} AS mixed_md5 FROM answers", **ANSWERS)


def verdicts(k: int | None) -> dict[str, str]:
    limit = f"[:{k}]" if k else ""
    return {
        **ANSWERS,
        "texts": f"SELECT id, {sentence_list('answer')} AS claims, {sentence_list('human_answer')}{limit} AS premises FROM answers",
        "c": f"SELECT id, i - 1 AS claim_pos, claims[i] AS claim, list_distinct({toks('claims[i]')}) AS ct FROM texts, unnest(range(1, len(claims) + 1)) AS u(i)",
        "p": f"SELECT id, j, premises[j] AS premise, list_distinct({toks('premises[j]')}) AS pt FROM texts, unnest(range(1, len(premises) + 1)) AS u(j)",
        "scored": "SELECT c.id, claim_pos, claim, j, premise, len(list_intersect(ct, pt))::DOUBLE / greatest(len(ct), 1) AS s FROM c JOIN p ON p.id = c.id",
        "best": "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id, claim_pos ORDER BY s DESC, j) = 1",
    }


add(
    "claim_labels",
    "SELECT id, claim_pos, md5(claim) AS claim, "
    + ", ".join(f"CASE WHEN s >= {t} THEN 'ALIGN' ELSE 'NOT_ALIGN' END AS label_{round(t * 100)}" for t in lex.ALIGN_THRESHOLDS)
    + ", round_even(s, 3) AS p, md5(premise) AS evidence FROM best",
    **verdicts(None),
)
SQL["claim_labels_leading_premises"] = SQL["claim_labels"].replace(
    f"{sentence_list('human_answer')} AS premises", f"{sentence_list('human_answer')}[:5] AS premises"
)
add(
    "claim_summary",
    "SELECT id, summary, label, count(*) AS n, max(total) AS total FROM ("
    + " UNION ALL ".join(
        f"SELECT id, 'facts_{round(t * 100)}_summary' AS summary, CASE WHEN s >= {t} THEN 'ALIGN' ELSE 'NOT_ALIGN' END AS label,"
        " count(*) OVER (PARTITION BY id) AS total FROM best"
        for t in lex.ALIGN_THRESHOLDS
    )
    + ") GROUP BY id, summary, label",
    **verdicts(None),
)
add(
    "claim_best_of_all",
    """SELECT a.id, b.x AS precision_25 FROM answers a LEFT JOIN
    (SELECT id, count(*) FILTER (s >= 0.25)::DOUBLE / count(*) AS x FROM best GROUP BY id) b ON b.id = a.id""",
    **verdicts(None),
)
_by_length = {k: v for k, v in verdicts(None).items()}
_by_length["scored"] = """SELECT c.id, claim_pos, claim, j, premise,
    least(length(claim), length(premise))::DOUBLE / greatest(length(claim), length(premise), 1) AS s FROM c JOIN p ON p.id = c.id"""
add(
    "claim_scorer",
    """SELECT id, claim_pos, md5(claim) AS claim, round_even(s, 3) AS p, md5(premise) AS evidence,
    CASE WHEN s >= 0.5 THEN 'ALIGN' ELSE 'NOT_ALIGN' END AS label_50 FROM best""",
    **_by_length,
)
add("factuality", f"SELECT id, {share('facts', 'fact_ref')} AS factuality_precision_50 FROM claims", **CLAIMS)
add("actionability", f"SELECT id, {share('recs', 'rec_ref')} AS recommendations_precision_50 FROM claims", **CLAIMS)

# ---- similarity and corpus statistics ----

_OVERLAP = {
    "tok": f"""SELECT id, 0 AS side, unnest({toks('answer')}) AS token FROM answers WHERE answer IS NOT NULL AND human_answer IS NOT NULL
        UNION ALL SELECT id, 1, unnest({toks('human_answer')}) FROM answers WHERE answer IS NOT NULL AND human_answer IS NOT NULL""",
    "per": "SELECT id, token, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM tok GROUP BY id, token",
    "pr": """SELECT id, coalesce(sum(CASE WHEN r > 0 THEN c END) / nullif(sum(c), 0), 0)::DOUBLE AS p,
        coalesce(sum(CASE WHEN c > 0 THEN r END) / nullif(sum(r), 0), 0)::DOUBLE AS q FROM per GROUP BY id""",
}


def overlap(p: str, r: str, f: str) -> str:
    return f"p AS {p}, q AS {r}, CASE WHEN p IS NULL THEN NULL WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS {f}"


add(
    "token_similarity",
    f"SELECT a.id, {overlap('precision', 'recall', 'f1')} FROM answers a LEFT JOIN pr ON pr.id = a.id",
    **ANSWERS,
    **_OVERLAP,
)
add(
    "vector_similarity",
    """SELECT id, round(p, 5) AS precision, round(r, 5) AS recall,
    CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 5) ELSE 0 END AS f1 FROM
    (SELECT a.id, coalesce(any_value(l.x), 0) AS p, coalesce(any_value(m.x), 0) AS r FROM answers a
     LEFT JOIN (SELECT id, sum(best * n) / sum(n) AS x FROM by_c GROUP BY id) l ON l.id = a.id
     LEFT JOIN (SELECT id, sum(best * n) / sum(n) AS x FROM by_r GROUP BY id) m ON m.id = a.id
     WHERE answer IS NOT NULL AND human_answer IS NOT NULL GROUP BY a.id)""",
    **ANSWERS,
    tok=_OVERLAP["tok"],
    vocab="SELECT DISTINCT token, ('0x' || substr(md5(token), 1, 8))::BIGINT AS code FROM tok",
    vec="""SELECT token, vec_id, embedding::DOUBLE[] AS v FROM vocab JOIN embeddings
        ON vec_id = code % (SELECT count(*) FROM embeddings)
        WHERE code % 10 <> 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0""",
    # a token stands for its vector: compare distinct vectors
    placed="SELECT id, side, vec_id, any_value(v) AS v, count(*) AS n FROM tok JOIN vec USING (token) GROUP BY id, side, vec_id",
    ids="SELECT DISTINCT vec_id, v FROM vec",
    cos="SELECT a.vec_id AS ca, b.vec_id AS cb, list_cosine_similarity(a.v, b.v) AS x FROM ids a, ids b",
    pairs="""SELECT c.id, c.vec_id AS cv, c.n AS cn, r.vec_id AS rv, r.n AS rn, x
        FROM placed c JOIN placed r ON r.id = c.id AND c.side = 0 AND r.side = 1 JOIN cos ON ca = c.vec_id AND cb = r.vec_id""",
    by_c="SELECT id, cv, max(x) AS best, any_value(cn) AS n FROM pairs GROUP BY id, cv",
    by_r="SELECT id, rv, max(x) AS best, any_value(rn) AS n FROM pairs GROUP BY id, rv",
)


SQL["vector_similarity_joined"] = SQL["vector_similarity"]


def _bigram_ctes(column: str) -> dict[str, str]:
    return {
        "train": f"SELECT id, {toks('answer')} AS ts FROM answers",
        "occ": "SELECT ts[i] AS a, ts[i + 1] AS b FROM train, unnest(range(1, len(ts) + 1)) AS u(i)",
        "big": "SELECT a, b, count(*) AS n FROM occ WHERE b IS NOT NULL GROUP BY a, b",
        "ctx": "SELECT a, sum(n) AS n FROM big GROUP BY a",
        "v": "SELECT count(DISTINCT a) AS v FROM occ",
        "scan": f"SELECT id, {toks(column)} AS ts FROM answers",
        "seen": "SELECT id, ts[i] AS a, ts[i + 1] AS b FROM scan, unnest(range(1, len(ts))) AS u(i)",
        "lp": """SELECT seen.id, -ln((coalesce(big.n, 0) + 1)::DOUBLE / (coalesce(ctx.n, 0) + v)) AS s FROM seen
            LEFT JOIN big ON big.a = seen.a AND big.b = seen.b LEFT JOIN ctx ON ctx.a = seen.a, v""",
    }


for _name, _column in (("token_surprisal", "answer"), ("human_surprisal", "human_answer")):
    add(
        _name,
        """SELECT a.id, round(avg(s), 6) AS surprisal_mean, round(stddev_pop(s), 6) AS surprisal_std, count(s) AS n_scored
        FROM answers a LEFT JOIN lp ON lp.id = a.id GROUP BY a.id""",
        **ANSWERS,
        **_bigram_ctes(_column),
    )

# ---- wide tables ----

add(
    "main_metrics",
    f"""SELECT a.id, {EASE} AS flesch_reading_ease, {GRADE} AS flesch_kincaid_grade,
    round(p, 6) AS precision_bert, round(q, 6) AS recall_bert,
    CASE WHEN p IS NULL THEN NULL WHEN p + q > 0 THEN round(2 * p * q / (p + q), 6) ELSE 0 END AS f1_bert,
    round({share('facts', 'fact_ref')}, 6) AS factuality_precision_50, round({share('recs', 'rec_ref')}, 6) AS recommendations_precision_50,
    CASE WHEN len(chains) > 0 THEN round({_VALID}::DOUBLE / len(chains), 6) END AS reasoning_percentage
    FROM counts a JOIN claims ON claims.id = a.id LEFT JOIN pr ON pr.id = a.id""",
    **ANSWERS,
    **_COUNTS,
    **_OVERLAP,
    **CLAIMS,
)


SQL["stored_evaluation"] = f"SELECT * REPLACE (id::VARCHAR AS id) FROM ({SQL['main_metrics']})"


def _free(s: str) -> dict[str, str]:
    causal = {"causal_density": when_text(s, f"{cue(s, lex.CAUSAL_CONNECTIVES)}::DOUBLE / {words(s)}")}
    return {**_quantities(s), **causal, **_hedging(s), **_modals(s)}


_FREE = both_sides(_free)
add("reference_free", _FREE, **ANSWERS)

# ---- normalisation ----


def skew(x: str) -> str:
    moments = f"(avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * avg({x}) * avg({x}) * avg({x}))"
    return f"CASE WHEN max({x}) > min({x}) THEN {moments} / power(var_pop({x}), 1.5) END"


def log1p(x: str) -> str:
    return f"CASE WHEN {x} > -1 THEN ln(1 + {x}) END"


_shown = [c for c in planted.METRIC_COLUMNS if c != "relevance_score_avg"]
_long = "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"Metric\", s, l, abs(s) - abs(l) AS g, lo, hi FROM (SELECT {skew('x')} AS s, CASE WHEN min(x) > -1 THEN {skew('y')} END AS l,"
    f" min(x) AS lo, max(x) AS hi FROM (SELECT {c} AS x, {log1p(c)} AS y FROM metrics))"
    for c in _shown
)
add(
    "skew_report",
    f"""SELECT "Metric", round_even(s, 3) AS "Original Skew", round_even(l, 3) AS "Log1p Skew", round_even(g, 3) AS "Skew Reduction",
    round_even(lo, 5) AS "Min Val", round_even(hi, 5) AS "Max Val",
    CASE WHEN abs(s) > 1.0 AND g > 0.1 THEN 'YES' ELSE 'NO' END AS "Log Transform?" FROM ({_long})""",
    **METRICS,
)


def feature(c: str, logged, lower) -> str:
    x = log1p(c) if c in logged else c
    return f"-({x})" if c in lower else x


def scaled(columns, logged, lower, table: str = "metrics", keys: str = "id") -> dict[str, str]:
    """CTEs ``work`` (features), ``st`` (mean and scale), ``norm`` (z-scores and index)."""
    feats = ", ".join(f"{feature(c, logged, lower)} AS f_{c}" for c in columns)
    stats = ", ".join(
        f"avg(f_{c}) AS m_{c}, CASE WHEN min(f_{c}) = max(f_{c}) THEN 1.0 ELSE stddev_pop(f_{c}) END AS s_{c}" for c in columns
    )
    zs = ", ".join(f"(f_{c} - m_{c}) / s_{c} AS norm_{c}" for c in columns)
    return {
        "work": f"SELECT {keys}, {feats} FROM {table}",
        "st": f"SELECT {stats} FROM work",
        "z": f"SELECT {keys}, {zs} FROM work, st",
    }


def index_of(columns) -> str:
    listed = ", ".join(f"norm_{c}" for c in columns)
    return f"list_avg([{listed}])"


_logged = [c for c in lex.DEFAULT_SKEWED if c in planted.METRIC_COLUMNS]
_lower = list(lex.DEFAULT_LOWER_IS_BETTER)
_order = [*_logged, *_lower, *[c for c in planted.METRIC_COLUMNS if c not in _logged and c not in _lower]]
_standard = scaled(_order, _logged, _lower, keys="id, strategy, department, category")
NORMALISED = {**METRICS, **_standard, "norm": f"SELECT *, {index_of(_order)} AS overall_quality_index FROM z"}
add(
    "normalizer_stats",
    "\nUNION ALL ".join(
        f"SELECT 'norm_{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale, {i}::BIGINT AS place FROM st"
        for i, c in enumerate(_order)
    ),
    **METRICS,
    **_standard,
)


def _rounded_norm(order) -> str:
    return "SELECT id, " + ", ".join(f"round(norm_{c}, 6) AS norm_{c}" for c in order) + ", round(overall_quality_index, 6) AS overall_quality_index FROM norm"


add("normalise", _rounded_norm(_order), **NORMALISED)


def _auto() -> None:
    """The automatic choice depends on the data: SQL takes the log where the skew report says YES."""
    lower = ["flesch_kincaid_grade", "precision_bert"]
    cols = list(planted.METRIC_COLUMNS)
    flags = ", ".join(
        f"(SELECT coalesce(abs({skew('x')}) > 1.0 AND abs({skew('x')}) - abs({skew('y')}) > 0.1 AND min(x) > -1, false)"
        f" FROM (SELECT {c} AS x, {log1p(c)} AS y FROM metrics)) AS yes_{c}"
        for c in cols
    )
    feats = ", ".join(
        f"{'-1' if c in lower else '1'} * CASE WHEN yes_{c} THEN {log1p(c)} ELSE {c} END AS f_{c}" for c in cols
    )
    parts = scaled(cols, [], [])
    parts["work"] = f"SELECT id, {feats} FROM metrics, flags"
    add(
        "normalise_auto",
        _rounded_norm(cols),
        **METRICS,
        flags=f"SELECT {flags}",
        **parts,
        norm=f"SELECT *, {index_of(cols)} AS overall_quality_index FROM z",
    )


_auto()

# ---- reports ----

_RANK = """SELECT strategy, round(m, 6) AS mean_value, rank() OVER (ORDER BY m DESC NULLS LAST) AS place FROM
    (SELECT strategy, avg(overall_quality_index) AS m FROM {0} WHERE strategy IS NOT NULL GROUP BY strategy)"""
add("strategy_ranking", _RANK.format("norm"), **NORMALISED)


def boxes(by: str, where: str) -> dict[str, str]:
    return {
        "kept": f"SELECT {by}, overall_quality_index AS x FROM norm WHERE {where} AND overall_quality_index IS NOT NULL",
        "q": f"SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS q3 FROM kept GROUP BY {by}",
        "f": f"SELECT {by}, x, q1, md, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM kept JOIN q USING ({by})",
    }


def box_select(by: str) -> str:
    return f"""SELECT {by}, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max,
    round(min(x) FILTER (inside), 6) AS low_whisker, round(max(x) FILTER (inside), 6) AS high_whisker,
    count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY {by}, f.q1, f.md, f.q3"""


add("strategy_boxes", box_select("strategy"), **NORMALISED, **boxes("strategy", "strategy IS NOT NULL"))
_complete = "department IS NOT NULL AND category IS NOT NULL AND strategy IS NOT NULL"
add("department_boxes", box_select("department, strategy"), **NORMALISED, **boxes("department, strategy", _complete))
add(
    "length_outliers",
    """SELECT id, strategy, x AS answer_quantification_density FROM k JOIN q USING (strategy)
    WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)""",
    **METRICS,
    k="SELECT id, strategy, answer_quantification_density AS x FROM metrics",
    q="SELECT strategy, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM k WHERE strategy IS NOT NULL GROUP BY strategy",
)


def levels(columns: str, grouping: str, where: str) -> str:
    return f"""SELECT {columns}, grouping({columns})::BIGINT AS level_id, count(*) AS n, round(avg(overall_quality_index), 6) AS mean_value
    FROM norm WHERE {where} AND overall_quality_index IS NOT NULL GROUP BY {grouping}"""


add(
    "quality_hierarchy",
    levels(
        "department, category, strategy",
        "GROUPING SETS ((department), (department, category), (department, category, strategy))",
        _complete,
    ),
    **NORMALISED,
)
_two = "department IS NOT NULL AND strategy IS NOT NULL"
add("quality_cube", levels("department, strategy", "CUBE (department, strategy)", _two), **NORMALISED)
add("quality_rollup", levels("department, strategy", "ROLLUP (department, strategy)", _two), **NORMALISED)
add(
    "strata",
    """SELECT department, category, count(*) AS n, round(avg(overall_quality_index), 6) AS mean_overall_quality_index,
    round(stddev_pop(overall_quality_index), 6) AS std_overall_quality_index,
    round(avg(norm_answer_causal_density), 6) AS mean_norm_answer_causal_density,
    round(stddev_pop(norm_answer_causal_density), 6) AS std_norm_answer_causal_density FROM norm GROUP BY department, category""",
    **NORMALISED,
)
_present = [c for c in CORRELATED if c == "overall_quality_index" or c.removeprefix("norm_") in planted.METRIC_COLUMNS]


def _corr(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS metric_a, '{b}' AS metric_b,
    CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS corr
    FROM (SELECT {a} AS x, {b} AS y FROM norm WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


add("correlations", "\nUNION ALL ".join(_corr(a, b) for a in _present for b in _present), **NORMALISED)
add(
    "hedging_trend",
    """SELECT strategy, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2,
    regr_count(y, x)::BIGINT AS n FROM (SELECT strategy, norm_answer_hedge_density AS x, norm_factuality_precision_50 AS y FROM norm)
    WHERE strategy IS NOT NULL GROUP BY strategy""",
    **NORMALISED,
)


def pretty(f: str) -> str:
    return f.replace("_freq", "").replace("_density", "").replace("_", " ").title()


def gap(features) -> str:
    rows = []
    for f in features:
        if f"answer_{f}" not in planted.METRIC_COLUMNS or f"human_answer_{f}" not in planted.METRIC_COLUMNS:
            continue
        rows.append(f"SELECT '{pretty(f)}' AS Feature, round(avg(norm_human_answer_{f}), 6) AS Value, 'Human Reference' AS Source FROM norm")
        rows.append(
            f"SELECT '{pretty(f)}', round(avg(norm_answer_{f}), 6), 'Model: ' || strategy FROM norm WHERE strategy IS NOT NULL GROUP BY strategy"
        )
    return "\nUNION ALL ".join(rows)


add("human_gap", 'SELECT Feature AS "Feature", Value AS "Value", Source AS "Source" FROM (' + gap(GAP_FEATURES) + ")", **NORMALISED)
_radar = ["quantification_density", "causal_density", "hedge_density", "modal_must_freq"]
add(
    "gap_radar",
    """SELECT p.point, p."Feature", """
    + ", ".join(
        f"max(Value) FILTER (Source = '{s}') AS {s.lower().replace(': ', '_').replace(' ', '_')}"
        for s in ("Human Reference", "Model: cot", "Model: nocot", "Model: symcot")
    )
    + " FROM points p JOIN gap g ON g.Feature = p.\"Feature\" GROUP BY ALL",
    **NORMALISED,
    gap=gap(_radar),
    points="\nUNION ALL ".join(
        f"SELECT {i}::BIGINT AS point, '{pretty(f)}' AS \"Feature\"" for i, f in enumerate([*_radar, _radar[0]])
    ),
)
add(
    "gap_radar_without_first",
    """SELECT p.point, p."Feature", max(Value) FILTER (Source = 'Human Reference') AS human_reference,
    max(Value) FILTER (Source = 'Model: cot') AS model_cot FROM points p JOIN gap g ON g.Feature = p."Feature" GROUP BY ALL""",
    **NORMALISED,
    gap=gap(["causal_density", "quantification_density"]),
    points="\nUNION ALL ".join(
        f"SELECT {i}::BIGINT AS point, '{pretty(f)}' AS \"Feature\""
        for i, f in enumerate(["causal_density", "quantification_density", "causal_density"])
    ),
)
_answer_side = list(_free("answer"))
_all_free = [f"{s}_{m}" for m in _answer_side for s in ("answer", "human_answer")]


def _scored_texts(chosen) -> dict[str, str]:
    """Automatic logs as in ``normalise_auto``, over the measures of the texts themselves."""
    cols = [c for c in lex.ALL_METRICS if c in _all_free]
    flags = ", ".join(
        f"(SELECT coalesce(abs({skew('x')}) > 1.0 AND abs({skew('x')}) - abs({skew('y')}) > 0.1 AND min(x) > -1, false)"
        f" FROM (SELECT {c} AS x, {log1p(c)} AS y FROM free)) AS yes_{c}"
        for c in cols
    )
    feats = ", ".join(f"CASE WHEN yes_{c} THEN {log1p(c)} ELSE {c} END AS f_{c}" for c in cols)
    parts = scaled(cols, [], [])
    parts["work"] = f"SELECT id, {feats} FROM free, flags"
    norm = f"SELECT id, {index_of([c for c in cols if chosen(c)])} AS overall_quality_index FROM z"
    return {"free": _FREE, "flags": f"SELECT {flags}", **parts, "norm": norm}


add(
    "scorecard",
    _RANK.format("scored"),
    **ANSWERS,
    **_scored_texts(lambda c: not c.startswith("human")),
    scored="SELECT a.id, strategy, overall_quality_index FROM answers a LEFT JOIN norm ON norm.id = a.id",
)
_CUES = "CASE WHEN doc_id % 3 = 0 THEN ' It may rise by 5%, thus we must act.' ELSE ' Sales could fall.' END"
add(
    "stream_scores",
    "SELECT id, round(overall_quality_index, 6) AS overall_quality_index FROM norm",
    answers=f"""SELECT doc_id AS id, text || {_CUES} AS answer,
    {_CUES} || ' Perhaps we should, and will, definitely cut 20 units.' || source AS human_answer FROM documents""",
    **_scored_texts(lambda c: True),
)
_h = _hedging("answer")
add(
    "strategy_hedging",
    """SELECT strategy, count(*) AS n_answers, sum(w)::BIGINT AS n_words, round(avg(r), 9) AS hedge_to_booster_ratio,
    round(avg(h), 9) AS hedge_density, round(avg(b), 9) AS booster_density FROM m GROUP BY strategy""",
    **ANSWERS,
    m=f"""SELECT strategy, greatest(coalesce({words('answer')}, 0), 1) AS w, {_h['hedge_to_booster_ratio']} AS r,
    {_h['hedge_density']} AS h, {_h['booster_density']} AS b FROM answers""",
)

# ---- streams: windows the final watermark has passed ----

_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
add(
    "stream_rolling_index",
    f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events)
    WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL""",
)
add(
    "stream_sliding_index",
    f"""SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS window_start, event_type, value FROM events, range(2) AS r(k))
    WHERE window_start + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY ALL""",
)
add(
    "stream_sessions",
    f"""SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
      (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY event_type, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
_streamed = _evidence("answer")
add(
    "stream_measures",
    f"""SELECT c.id, md5({section('observations')}) AS observations_md5, {section('interpretations')} AS interpretations,
    {section('recommendations')} AS recommendations, {EASE} AS flesch_reading_ease, {GRADE} AS flesch_kincaid_grade,
    1 + (c.id % 3 <> 0)::BIGINT AS correct_reasoning_count, 2::BIGINT AS total_reasoning_to_verify,
    (1 + (c.id % 3 <> 0)::BIGINT) / 2::DOUBLE AS reasoning_percentage, {", ".join(f"{v} AS {k}" for k, v in _streamed.items())}
    FROM counts c""",
    answers="""SELECT doc_id AS id, '## Observations' || chr(10) || text || chr(10) || '## Interpretations' || chr(10)
    || 'The data shows it, clearly, for ' || source || '.' || chr(10) || '## Recommendations' || chr(10)
    || 'Review the plan in ' || lang || '.' AS answer FROM documents""",
    counts=_COUNTS["counts"].replace("answer FROM answers", "answer, answer AS human_answer FROM answers"),
)

# ---- embeddings ----

_VECTORS = {
    "v": "SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0",
    "flat": "SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v",
}
_CENTRED = {
    **_VECTORS,
    "mean": "SELECT i, avg(x) AS mu FROM flat GROUP BY i",
    "centred": "SELECT vec_id, i, x - mu AS d FROM flat JOIN mean USING (i)",
}
add(
    "pca_variance",
    """SELECT count(DISTINCT i) AS components, round(sum(v) FILTER (i = j), 6) AS total, round(sum(v * v), 6) AS squares,
    (SELECT round(avg(mu), 6) FROM mean) AS mean FROM covariance""",
    **_CENTRED,
    covariance="SELECT a.i, b.i AS j, sum(a.d * b.d) / (count(*) - 1) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i",
)
add(
    "pca_distances",
    "SELECT vec_id, round(sqrt(sum(d * d)), 5) AS distance FROM embeddings LEFT JOIN centred USING (vec_id) GROUP BY vec_id",
    **_CENTRED,
)
add(
    "group_marginals",
    "SELECT a, b, round(sqrt(sum(value) / count(*)), 6) AS distance FROM lines GROUP BY a, b",
    **_VECTORS,
    placed="""SELECT label, i, x, row_number() OVER (PARTITION BY label, i ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY label, i) AS n
    FROM flat WHERE label IS NOT NULL""",
    lines="""SELECT p.label AS a, q.label AS b, p.i, sum((least((p.r + 1) / p.n, (q.r + 1) / q.n) - greatest(p.r / p.n, q.r / q.n)) * (p.x - q.x) * (p.x - q.x)) AS value
    FROM placed p JOIN placed q ON p.i = q.i AND p.label < q.label AND (p.r + 1) * q.n > q.r * p.n AND (q.r + 1) * p.n > p.r * q.n
    GROUP BY p.label, q.label, p.i""",
)
add(
    "group_gaussians",
    "SELECT p.label AS a, q.label AS b, round(sqrt((p.m - q.m) * (p.m - q.m) + (p.s - q.s) * (p.s - q.s)), 6) AS distance FROM moments p JOIN moments q ON p.label < q.label",
    **_VECTORS,
    moments="""SELECT label, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s
    FROM (SELECT label, list_sum(e) / len(e) AS x FROM v WHERE label IS NOT NULL) GROUP BY label""",
)

# ---- measures called from SQL ----

add(
    "sql_measures",
    f"""SELECT id, {EASE} AS flesch_reading_ease, {GRADE} AS flesch_kincaid_grade, round({_hedging("answer")["hedge_density"]}, 6) AS hedge_density,
    greatest(coalesce({words("answer")}, 0), 1) AS n_words FROM counts WHERE greatest(coalesce({words("answer")}, 0), 1) > 5 OR answer IS NULL""",
    **ANSWERS,
    **_COUNTS,
)

SQL["merged_skew_report"] = SQL["skew_report"]

# ---- measures by a user's model ----

SQL["tagger_formality"] = SQL["formality"]
add(
    "classifier_mood",
    f"""SELECT id, {when_text('answer', balance("len([s FOR s IN parts IF s LIKE '%!'])", "len([s FOR s IN parts IF s LIKE '%.'])"))} AS imperative_to_declarative_ratio
    FROM (SELECT id, answer, {sentence_list('answer')} AS parts FROM answers)""",
    **ANSWERS,
)
add(
    "recogniser_entities",
    f"""SELECT id, CASE WHEN {words('answer')} > 0 THEN
    len(list_distinct(regexp_extract_all(array_to_string({toks('answer')}, ' '), '[^ ]{{10,}}(?: [^ ]{{10,}})*')))::DOUBLE / {words('answer')} END AS ner_density FROM answers""",
    **ANSWERS,
)
add(
    "model_surprisal",
    f"""SELECT a.id, round(avg(s), 6) AS surprisal_mean, round(stddev_pop(s), 6) AS surprisal_std, count(s) AS n_scored
    FROM answers a LEFT JOIN (SELECT id, ln(1 + length(unnest({toks('answer')}))) AS s FROM answers) t ON t.id = a.id GROUP BY a.id""",
    **ANSWERS,
)

# ---- sketches ----

add(
    "distinct_strata",
    """SELECT day, event_type, 'hour' AS "column", count(hour) AS n, count(DISTINCT hour) AS n_distinct FROM e GROUP BY day, event_type
    UNION ALL SELECT day, event_type, 'bucket', count(bucket), count(DISTINCT bucket) FROM e GROUP BY day, event_type""",
    e="SELECT ts::DATE AS day, hour(ts) AS hour, event_type, trunc(value)::BIGINT % 50 AS bucket FROM events",
)
add(
    "distinct_tokens_bounded",
    "SELECT strategy, count(*) AS n, count(DISTINCT token) AS exact, true AS near FROM t GROUP BY strategy",
    **ANSWERS,
    t=f"SELECT strategy, unnest({toks('answer')}) AS token FROM answers",
)
SQL["analysis_summary"] = SQL["skew_report"]

add(
    "loaded_analysis",
    f"SELECT id::VARCHAR AS id, strategy, department, category, CASE WHEN abs(id) % 2 = 0 THEN {EASE} END AS flesch_reading_ease, true AS told FROM counts",
    **ANSWERS,
    counts=_COUNTS["counts"].replace("SELECT id", "SELECT id, strategy, department, category", 1),
)
add("first_rows", "SELECT id, strategy, department, category FROM answers ORDER BY id LIMIT 5", **ANSWERS)
