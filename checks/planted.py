"""Tables derived from the given ones, in SQL that Spark and DuckDB both run.

The given texts hold no cue word, heading or judged JSON, so sentences with them
are added to every whole text. ``t`` maps a table name to how the engine reads it.
"""

from __future__ import annotations

from collections.abc import Callable

Source = Callable[[str], str]


def duckdb_table(name: str) -> str:
    return name


def parquet_table(folder: str) -> Source:
    return lambda name: f"parquet.`{folder}/{name}.parquet`"


def answers(t: Source) -> str:
    """id, strategy, department, category, answer, human_answer: every document, and under
    negative ids added rows with a blank answer, no answer, or no human answer."""
    docs = t("documents")
    return f"""
SELECT d.id,
 CASE (d.doc_id % 7) % 3 WHEN 0 THEN 'nocot' WHEN 1 THEN 'cot' ELSE 'symcot' END AS strategy,
 CASE (d.doc_id + d.n_chars) % 4 WHEN 0 THEN 'development' WHEN 1 THEN 'sales'
      WHEN 2 THEN 'customer_care' ELSE 'marketing' END AS department,
 CASE WHEN d.doc_id % 29 = 0 THEN NULL WHEN d.n_chars % 4 = 0 THEN 'kpi_trend'
      WHEN d.n_chars % 4 = 1 THEN 'customer' WHEN d.n_chars % 4 = 2 THEN 'process'
      ELSE 'planning' END AS category,
 CASE d.kind WHEN 'blank' THEN '  ' WHEN 'no answer' THEN NULL ELSE
  d.text || ' ' ||
  CASE d.doc_id % 7
   WHEN 0 THEN 'The data shows a $15M gain, or 15% in Q3 2024, because demand rose.'
   WHEN 1 THEN 'KPIs indicate orders MAY fall; costs could rise and it might rain. Perhaps so.'
   WHEN 2 THEN 'You must definitely invest. Clearly, it is clear that this always pays.'
   WHEN 3 THEN 'As a result, sales fell 3.5% on 2024-03-31. Thus we should act, and we will.'
   WHEN 4 THEN 'This is evidently maybe likelyhood, thusly unmust: no cue at all.'
   WHEN 5 THEN 'Based on metrics, churn reveals risk;' || chr(10) || 'as a' || chr(10)
            || 'result we wait. Probably driven by price.'
   ELSE 'Review the plan. Cut cost by 20 percent. It suggests nothing, but may-be certainly May.'
  END || ' Demand grew in ' || n.n_name || ', ' || r.r_name || ' and ' || n.n_name || '.' END AS answer,
 CASE WHEN d.kind = 'no human answer' THEN NULL ELSE '## Observations' || chr(10) || b.text || chr(10) || '## Interpretations' || chr(10) ||
  CASE d.doc_id % 2 WHEN 0
   THEN 'It is clear the data shows demand could rise because prices fell 5%.'
   ELSE 'This must be seasonal.' END || chr(10) ||
 '## Recommendations' || chr(10) || 'You should review the plan.' || chr(10) ||
 '## Notes' || chr(10) || 'It will possibly change in ' || r.r_name || '.' END AS human_answer
FROM (
 SELECT doc_id AS id, doc_id, n_chars, text, 'whole' AS kind FROM {docs}
 UNION ALL SELECT -3 * doc_id - 1, doc_id, n_chars, text, 'blank' FROM {docs} WHERE doc_id % 23 = 0
 UNION ALL SELECT -3 * doc_id - 2, doc_id, n_chars, text, 'no answer' FROM {docs} WHERE doc_id % 31 = 0
 UNION ALL SELECT -3 * doc_id - 3, doc_id, n_chars, text, 'no human answer' FROM {docs} WHERE doc_id % 37 = 0
) d
JOIN {t("benchmark")} b ON b.item_id = d.doc_id % (SELECT count(*) FROM {t("benchmark")})
JOIN {t("nation")} n ON n.n_nationkey = d.doc_id % 25
JOIN {t("region")} r ON r.r_regionkey = n.n_regionkey"""


def replies(t: Source) -> str:
    """id, reply, human_answer: fenced lists and objects, unfenced, malformed, odd types."""
    clean = "translate({0}, chr(10) || chr(9) || chr(13) || '\"' || chr(92), '     ')"
    text, bench = clean.format("d.text"), clean.format("b.text")
    return f"""
SELECT d.doc_id AS id,
 CASE d.doc_id % 8
  WHEN 0 THEN 'Here is the review.' || chr(10) || '```json' || chr(10)
   || '[{{"observations": ["' || {text} || '", "Demand rose because prices fell."], "hypotheses": ["' || {bench}
   || '"], "recommendations": "Review the plan.", "validity_reasoning": "fits", "is_reasoning_valid": true}},'
   || ' {{"observations": ["Demand rose because prices fell."], "hypotheses": ["It must be seasonal."],'
   || ' "recommendations": "Invest more in growth.", "validity_reasoning": "no", "is_reasoning_valid": false}}]'
   || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 1 THEN '```json {{"observations": ["' || {bench} || '", "' || {text} || '"], "hypotheses": ["This must be seasonal."],'
   || ' "recommendations": "You should review the plan.", "is_reasoning_valid": true}} ```'
  WHEN 2 THEN '[{{"observations": ["' || {text} || '"], "is_reasoning_valid": true}}]'
  WHEN 3 THEN '```json' || chr(10) || '[{{"observations": ["' || {text} || '"], "validity_reasoning: "x"}}]' || chr(10) || '```'
  WHEN 4 THEN '```json' || chr(10) || '[{{"observations": ["' || {text} || '"], "hypotheses": [],'
   || ' "recommendations": "Wait.", "is_reasoning_valid": "false"}}]' || chr(10) || '```'
  WHEN 5 THEN '```json' || chr(10) || '[{{"observations": ["' || {text} || '", "Demand could rise."],'
   || ' "hypotheses": ["This must be seasonal.", "Demand could rise."],'
   || ' "recommendations": ["Review the plan.", "Cut cost."], "is_reasoning_valid": true}}]' || chr(10) || '```'
  WHEN 6 THEN '```json' || chr(10) || '[]' || chr(10) || '``` ' || {text}
  ELSE '```json' || chr(10) || '[{{"observations": ["' || {text} || '"], "recommendations": "Review the plan."}},'
   || ' {{"hypotheses": ["' || {bench} || '"], "recommendations": "Act.", "is_reasoning_valid": true}}]' || chr(10) || '```'
 END AS reply,
 CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE '## Observations' || chr(10) || b.text || chr(10) || '## Interpretations' || chr(10) ||
  CASE d.doc_id % 2 WHEN 0
   THEN 'It is clear the data shows demand could rise because prices fell 5%.'
   ELSE 'This must be seasonal.' END || chr(10) ||
 '## Recommendations' || chr(10) || 'You should review the plan.' || chr(10) ||
 '## Notes' || chr(10) || 'It will possibly change.' END AS human_answer
FROM {t("documents")} d
JOIN {t("benchmark")} b ON b.item_id = d.doc_id % (SELECT count(*) FROM {t("benchmark")})"""


def metrics(t: Source) -> str:
    """Dimensions and metrics with a constant, an all-NULL, a negative, a skewed one with values below -1, and skewed columns."""
    x = "CAST({0} AS DOUBLE)"
    return f"""
SELECT d.doc_id AS id,
 CASE WHEN d.doc_id % 37 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'symcot' WHEN d.doc_id % 9 = 1 THEN 'nocot' ELSE 'cot' END AS strategy,
 CASE (d.doc_id + d.n_chars) % 4 WHEN 0 THEN 'development' WHEN 1 THEN 'sales'
      WHEN 2 THEN 'customer_care' ELSE 'marketing' END AS department,
 CASE WHEN d.doc_id % 29 = 0 THEN NULL WHEN d.n_chars % 3 = 0 THEN 'kpi_trend' WHEN d.n_chars % 3 = 1 THEN 'customer' ELSE 'planning' END AS category,
 {x.format("d.n_chars % 97")} - 30 AS flesch_reading_ease,
 {x.format("(d.doc_id * 7) % 23")} / 2 AS flesch_kincaid_grade,
 {x.format("l.quality")} AS clarity_score_avg,
 CAST(0.5 AS DOUBLE) AS f1_bert,
 CAST(NULL AS DOUBLE) AS relevance_score_avg,
 1 / (1 + {x.format("d.doc_id % 50")}) AS precision_bert,
 CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE {x.format("d.n_chars % 11")} / 10 END AS factuality_precision_50,
 {x.format("d.doc_id % 5")} / 4 AS recommendations_precision_50,
 {x.format("d.n_chars")} / 1000 AS answer_quantification_density,
 {x.format("d.n_chars % 7")} / 7 AS human_answer_quantification_density,
 {x.format("d.n_chars % 13")} / (10 + {x.format("d.doc_id % 7")}) AS answer_causal_density,
 {x.format("d.doc_id % 17")} / 100 AS human_answer_causal_density,
 {x.format("d.n_chars")} * {x.format("d.n_chars")} / 1000000 AS answer_hedge_to_booster_ratio,
 {x.format("d.n_chars % 19")} / 40 AS answer_hedge_density,
 {x.format("d.doc_id % 31")} / 200 AS human_answer_hedge_density,
 CASE WHEN d.doc_id % 10 = 3 THEN -2 ELSE {x.format("d.n_chars")} * {x.format("d.n_chars")} / 10000 END AS answer_booster_density,
 {x.format("d.n_chars % 5")} / 50 AS answer_modal_must_freq,
 CASE WHEN d.doc_id % 6 = 1 THEN NULL ELSE {x.format("d.doc_id % 12")} / 90 END AS human_answer_modal_must_freq
FROM {t("documents")} d LEFT JOIN {t("labels")} l ON l.doc_id = d.doc_id"""


METRIC_COLUMNS = (
    "flesch_reading_ease",
    "flesch_kincaid_grade",
    "clarity_score_avg",
    "f1_bert",
    "relevance_score_avg",
    "precision_bert",
    "factuality_precision_50",
    "recommendations_precision_50",
    "answer_quantification_density",
    "human_answer_quantification_density",
    "answer_causal_density",
    "human_answer_causal_density",
    "answer_hedge_to_booster_ratio",
    "answer_hedge_density",
    "human_answer_hedge_density",
    "answer_booster_density",
    "answer_modal_must_freq",
    "human_answer_modal_must_freq",
)


def gazetteer(t: Source) -> str:
    """term, label: the given nations and regions; one label is not counted."""
    return f"""
SELECT n_name AS term, 'ORG' AS label FROM {t("nation")}
UNION ALL SELECT r_name, CASE WHEN r_name = 'ASIA' THEN 'GPE' ELSE 'PRODUCT' END FROM {t("region")}"""
