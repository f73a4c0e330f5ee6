"""Lexicon and gazetteer lookups held in tables of any size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotate import labelled_spans
from ..functions.lexical import balance
from ..functions.lexicons import ENTITY_LABELS, FORMAL_TAGS, INFORMAL_TAGS, SUFFIX_RULES
from ..functions.text import NON_SPACE, raw_word_count, tokens
from .automaton import distinct_terms, normal_term
from .joins import BROADCAST_BYTES, lookup


#: Texts whose tokens are counted together in a task.
TEXTS = 1024


def _ending_tags(words: pa.Array) -> pa.Array:
    """What :func:`textscore.functions.annotate.suffix_tag` gives each word."""
    tags = np.full(len(words), "NOUN", object)
    for name, endings in reversed(SUFFIX_RULES):
        for ending in endings:
            tags[pc.ends_with(words, ending).to_numpy(zero_copy_only=False)] = name
    return pa.array(tags, pa.string())


def _counted_tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, has_text, token, n, ending): the distinct tokens of each text, how often each occurs and the tag
    of its ending; a text without tokens has a row of NULLs and n = 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sizes = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
                coded = part.column(2).flatten().dictionary_encode()
                names, width = coded.dictionary, max(1, len(coded.dictionary))
                keys, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
                without = np.flatnonzero(sizes == 0)
                rows = pa.array(np.concatenate([keys // width, without]))
                none = np.arange(len(rows)) >= len(keys)
                place = pa.array(np.concatenate([keys % width, np.zeros(len(without), np.int64)]), mask=none)
                columns = [part.column(0).take(rows), part.column(1).take(rows), names.take(place), pa.array(np.concatenate([n, np.zeros(len(without), np.int64)])), _ending_tags(names).take(place)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "has_text", "token", "n", "ending"])

    has_text = F.coalesce(F.col(text).rlike(NON_SPACE), F.lit(False)).alias("has_text")
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, has_text, tokens(F.col(text)).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, has_text boolean, token string, n long, ending string")


def formality_by_table(
    df: DataFrame, id_col: str, text: str, lexicon: DataFrame, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Formality with a part-of-speech table (token, pos); tokens it lacks follow the suffix rule.

    A text's distinct tokens travel with their counts, and endings are looked at once per distinct token of many
    texts. A text without tokens travels as one row without a token, so nothing is joined back.
    """
    words = _counted_tokens(df, id_col, text)
    one_per_token = lexicon.groupBy("token").agg(F.min("pos").alias("pos"))
    tagged = lookup(words, one_per_token, ["token"], spread_by=[id_col], row_bytes=64, budget=budget)
    tag = F.coalesce(F.col("pos"), F.col("ending"))
    count = lambda wanted: F.sum(F.when(tag.isin(*wanted), F.col("n")).otherwise(0))
    sums = tagged.groupBy(id_col, "has_text").agg(count(FORMAL_TAGS).alias("f"), count(INFORMAL_TAGS).alias("i"))
    return sums.select(id_col, F.when(F.col("has_text"), balance(F.col("f"), F.col("i"))).alias("formality_score"))


def entity_density_by_table(
    df: DataFrame,
    id_col: str,
    text: str,
    gazetteer: DataFrame,
    labels: Iterable[str] = ENTITY_LABELS,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Distinct entities per word with a gazetteer table (term, label).

    The rule is that of :func:`textscore.functions.annotate.entity_density`: a term
    is found where its tokens occur in a row. The terms are a trie over tokens, or several
    beyond ``budget`` bytes (:mod:`textscore.operators.automaton`), and every text is walked where it is: nothing
    is joined. ``id_col`` must be unique where there are several tries.
    """
    labels = list(labels)
    terms = gazetteer.filter(F.col("label").isin(*labels)).select(normal_term(F.col("term")).alias("entity")).filter("entity <> ''").distinct()
    spans = labelled_spans(F.col(text), labels)
    sent = df.select(id_col, raw_word_count(F.col(text)).alias("words"), spans.alias("spans"), tokens(F.col(text)).alias("t"))
    sent = sent.withColumn("n_spans", F.array_size("spans").cast("long"))
    found = distinct_terms(sent, terms, "t", "spans", "n_terms", budget)
    n = (F.col("n_spans") + F.col("n_terms")).cast("double")
    return found.select(id_col, F.try_divide(n, F.col("words")).alias("ner_density"))
