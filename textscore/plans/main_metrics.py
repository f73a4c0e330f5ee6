"""The main table: readability, similarity, factuality, actionability, reasoning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.judgments import (
    evaluate_reasoning,
    flatten_claims,
    judgment_of_reply,
    observations_and_hypotheses,
    parse_judgment,
    recommendations,
)
from ..functions.readability import flesch_kincaid_grade, flesch_reading_ease
from ..functions.sections import extract_interpretations, extract_observations, extract_recommendations
from ..operators.claims import PairScorer, evaluate_actionability, evaluate_factuality, scored_verdicts, support_precision
from ..operators.joins import join_on_id
from ..operators.similarity import greedy_similarity, token_overlap

COLUMNS = (
    "flesch_reading_ease",
    "flesch_kincaid_grade",
    "precision_bert",
    "recall_bert",
    "f1_bert",
    "factuality_precision_50",
    "recommendations_precision_50",
    "reasoning_percentage",
)


def nested_strings(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "array<array<string>>"


def main_metrics(
    df: DataFrame,
    id_col: str = "id",
    vectors: DataFrame | None = None,
    scorer: Callable[[], PairScorer] | None = None,
) -> DataFrame:
    """``id`` and eight measures of the joined input table.

    Needs ``answer, human_answer, fact_ai_list, fact_human_str, rec_ai_list,
    rec_human_str, reasoning_dict`` (JSON text). With the defaults this is a map-only
    job; ``vectors`` (token, vector) switches similarity to cosine matching and
    ``scorer`` (a factory, called once per task) replaces the native claim support.
    """
    facts = flatten_claims(F.col("fact_ai_list"), nested_strings(df, "fact_ai_list"))
    recs = flatten_claims(F.col("rec_ai_list"), nested_strings(df, "rec_ai_list"))
    judged = evaluate_reasoning(parse_judgment(F.col("reasoning_dict")))
    base = df.select(
        id_col,
        flesch_reading_ease(F.col("answer")).alias("flesch_reading_ease"),
        flesch_kincaid_grade(F.col("answer")).alias("flesch_kincaid_grade"),
        "answer",
        "human_answer",
        facts.alias("facts"),
        recs.alias("recs"),
        "fact_human_str",
        "rec_human_str",
        judged["reasoning_percentage"].alias("reasoning_percentage"),
    )
    if scorer is None:
        base = base.withColumns(
            {
                "factuality_precision_50": evaluate_factuality(F.col("facts"), F.col("fact_human_str")),
                "recommendations_precision_50": evaluate_actionability(F.col("recs"), F.col("rec_human_str")),
            }
        )
    else:
        pool = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
        lists = [(F.col("facts"), pool("fact_human_str")), (F.col("recs"), pool("rec_human_str"))]
        base = base.withColumn("verdicts", scored_verdicts(lists, scorer))
        base = base.withColumns(
            {
                "factuality_precision_50": support_precision(F.col("verdicts")[0]),
                "recommendations_precision_50": support_precision(F.col("verdicts")[1]),
            }
        )
    if vectors is None:
        overlap = token_overlap(F.col("answer"), F.col("human_answer"))
        base = base.withColumn("similarity", overlap).select(
            "*", *[F.col(f"similarity.{f}").alias(f"{f}_bert") for f in ("precision", "recall", "f1")]
        )
    else:
        scored = greedy_similarity(df, id_col, "answer", "human_answer", vectors)
        scored = scored.withColumnsRenamed({f: f"{f}_bert" for f in ("precision", "recall", "f1")})
        base = base.join(scored, id_col, "left")
    return base.select(id_col, *COLUMNS)


def claims_from_sources(df: DataFrame, id_col: str = "id", reply: str = "reply", human: str = "human_answer") -> DataFrame:
    """The input columns of :func:`main_metrics` from a judge's reply and the human Markdown.

    Facts are the judged observations and hypotheses, their reference the human
    observations and interpretations; recommendations likewise.
    """
    # parsed in a projection of its own: every column below reads the result
    df = df.select(id_col, judgment_of_reply(F.col(reply)).alias("judged"), human)
    judged = F.col("judged")
    human_facts = F.when(
        F.col(human).isNotNull(), F.concat_ws("\n", extract_observations(F.col(human)), extract_interpretations(F.col(human)))
    )
    return df.select(
        id_col,
        observations_and_hypotheses(judged).alias("fact_ai_list"),
        human_facts.alias("fact_human_str"),
        recommendations(judged).alias("rec_ai_list"),
        extract_recommendations(F.col(human)).alias("rec_human_str"),
        F.to_json(judged).alias("reasoning_dict"),
    )


def evaluation_input(
    basic_info: DataFrame, answer: DataFrame, nli_info: DataFrame, reasoning_info: DataFrame, id_col: str = "id"
) -> DataFrame:
    """The four input tables joined on ``id``."""
    return join_on_id([basic_info, answer, nli_info, reasoning_info], id_col)
