"""Reasoning judgments: requests to a judge, its fenced JSON reply, and counts over it.

A judgment column is ``ARRAY<STRUCT<...>>`` whose fields are all STRING, so that a
field of an unexpected JSON type keeps its text and its siblings survive. A reply
without a fenced block, or with malformed JSON, gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# ---- fixed values: field names of one judged reasoning chain -------------------
JUDGMENT_SCHEMA = (
    "array<struct<observations:string,hypotheses:string,recommendations:string,"
    "validity_reasoning:string,is_reasoning_valid:string>>"
)
# ---- fixed value: the fence around a judge's JSON ----
FENCED_JSON = r"(?s)```json\s*(.*?)\s*```"


def judge_request(answer: Column, human_observation: Column) -> Column:
    """User message that asks a judge about ``answer``. Its parts and their order."""
    return F.concat(
        F.lit("<LLM generated text>\n"),
        answer,
        F.lit("\n<\\LLM generated text>\n\n<Human Observations and Hypotheses>"),
        human_observation,
        F.lit("\n<\\Human Observations and Hypotheses>"),
    )


def fenced_json(reply: Column) -> Column:
    """Text of the first fenced json block; NULL without one."""
    body = F.regexp_extract(reply, FENCED_JSON, 1)
    return F.when(body != "", body)


def parse_judgment(json_text: Column) -> Column:
    """Judged chains; a lone object counts as a list of one."""
    return F.from_json(json_text, JUDGMENT_SCHEMA)


def judgment_of_reply(reply: Column) -> Column:
    return parse_judgment(fenced_json(reply))


def as_list(field: Column) -> Column:
    """A STRING field as a list: JSON arrays are opened, a scalar becomes one element."""
    opened = F.when(field.startswith("["), F.from_json(field, "array<string>"))
    return F.when(field.isNotNull(), F.coalesce(opened, F.array(field)))


def flatten_claims(claims: Column, nested: bool = False) -> Column:
    """One flat list of claims.

    ``nested`` marks ARRAY<ARRAY<STRING>> input. In ARRAY<STRING> input an element
    that holds a JSON array (a list among strings) is opened by one level.
    """
    if nested:
        return F.flatten(claims)
    return F.flatten(F.transform(claims, lambda c: F.coalesce(as_list(c), F.array(c))))


def _gather(judgment: Column, *fields: str) -> Column:
    none = F.array().cast("array<string>")
    lists = F.transform(
        judgment, lambda j: F.concat(*[F.coalesce(as_list(j[name]), none) for name in fields])
    )
    return F.flatten(lists)


def observations_and_hypotheses(judgment: Column) -> Column:
    """Distinct observations and hypotheses over all chains, sorted."""
    return F.array_sort(F.array_distinct(_gather(judgment, "observations", "hypotheses")))


def recommendations(judgment: Column) -> Column:
    """Recommendations over all chains, in order, list-valued ones opened."""
    return _gather(judgment, "recommendations")


def valid_reasoning_count(judgment: Column) -> Column:
    """Chains whose flag is JSON true; a quoted or missing flag is not valid."""
    return F.array_size(F.filter(judgment, lambda j: F.coalesce(j["is_reasoning_valid"] == "true", F.lit(False)))).cast("long")


def total_reasoning_count(judgment: Column) -> Column:
    return F.array_size(judgment).cast("long")


def evaluate_reasoning(judgment: Column) -> Column:
    """Struct of valid chains, all chains, and their ratio (NULL for an empty list)."""

    def fields(j: Column) -> Column:
        valid, total = valid_reasoning_count(j), total_reasoning_count(j)
        counted = F.struct(
            valid.alias("correct_reasoning_count"),
            total.alias("total_reasoning_to_verify"),
            F.try_divide(valid.cast("double"), total).alias("reasoning_percentage"),
        )
        return F.when(j.isNotNull(), counted)

    return let(judgment, fields)


def request_table(df: DataFrame, id_col: str, answer: str, human_observation: str, system: str) -> DataFrame:
    """(id, system, user): one request to a judge per answer, to be answered outside Spark.

    A row that lacks the answer or the human observations gives no request.
    """
    asked = df.select(
        id_col, F.lit(system).alias("system"), judge_request(F.col(answer), F.col(human_observation)).alias("user")
    )
    return asked.filter(F.col("user").isNotNull())
