"""A corpus pipeline: language ID, toxicity, near-duplicates, packing; each stage one operator of ``textscore.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of ``docs``; the last returns the packed pieces. A filtering stage keeps
a document unless its operator speaks against it:

- language: goes if the text is NULL or has no letter, or if its two best languages are too
  close to tell apart;
- toxicity: goes if its score is 0.5 or more; a NULL or empty text would stay;
- near_duplicates: of each class the smallest doc_id stays (all rows of that id); rows with
  a NULL doc_id stay.

Columns beyond those of the operators are carried along, whatever their names. Empty tables
give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm import language, minhash, packing, queries, toxicity
from textscore.llm.common import table, unused
from textscore.session import store


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told."""
    result = unused(docs, "_language")
    named = language.predict(docs, queries.language_model(docs), result=result)
    return named.where((F.col(f"{result}.lang_pred") != language.UNKNOWN) & ~F.col(f"{result}.ambiguous")).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic."""
    result = unused(docs, "_toxicity")
    scored = toxicity.score(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")), result=result)
    return scored.where(F.col(result) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    judged = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept"))
    return docs.join(judged.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(queries.PACKED_FILE))


STAGES = [("language", keep_languages), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
#: Learned scores and signatures decide the rows; SQL cannot express them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is written to the shared folder and read again.

    ``textscore.session.release`` deletes those tables once the result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
