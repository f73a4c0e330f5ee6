"""The reference-free table: lexical measures of the answer and the human answer side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import balance
from ..functions.lexicons import BOOSTERS, CAUSAL_CONNECTIVES, HEDGES, MODALS
from ..functions.text import (
    find_all,
    phrase_pattern,
    quantity_spans,
    raw_word_count,
    sentence_count,
)

SIDES = ("answer", "human_answer")
MEASURES = (
    "quantification_density",
    "causal_density",
    "hedge_to_booster_ratio",
    "hedge_density",
    "booster_density",
    *(f"modal_{m}_freq" for m in MODALS),
)
COLUMNS = tuple(f"{side}_{m}" for m in MEASURES for side in SIDES)

_CUES = tuple(dict.fromkeys([*CAUSAL_CONNECTIVES, *HEDGES, *BOOSTERS, *MODALS]))


def _hits(words: Column, wanted: Sequence[str]) -> Column:
    whole = rf"(?iu)\A(?:{'|'.join(wanted)})\z"
    return F.array_size(F.filter(words, lambda w: w.rlike(whole))).cast("double")


def _exact(words: Column, modal: str) -> Column:
    return F.array_size(F.filter(words, lambda w: F.lower(w) == modal)).cast("double")


def reference_free_metrics(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` and 22 measures, answer and human side alternating; a map-only job.

    Hedges, boosters and modals are all single words and no connective contains one,
    so matches never overlap and one scan of the text finds all of them. The first
    projection holds that short list and the plain counts, the second one does the
    arithmetic. Equal to the single functions.
    """
    scans = {}
    for side in SIDES:
        text = F.col(side)
        scans[f"{side}.words"] = raw_word_count(text)
        scans[f"{side}.sentences"] = sentence_count(text)
        scans[f"{side}.quantities"] = F.array_size(quantity_spans(text))
        scans[f"{side}.cues"] = find_all(text, phrase_pattern(_CUES))
    scanned = df.select(id_col, *[c.alias(name) for name, c in scans.items()])

    out: dict[str, Column] = {}
    for side in SIDES:
        words, cues = F.col(f"`{side}.words`"), F.col(f"`{side}.cues`")
        hedges, boosters = _hits(cues, HEDGES), _hits(cues, BOOSTERS)
        out[f"{side}_quantification_density"] = F.col(f"`{side}.quantities`").cast("double") / F.col(f"`{side}.sentences`")
        out[f"{side}_causal_density"] = F.try_divide(_hits(cues, CAUSAL_CONNECTIVES), words)
        out[f"{side}_hedge_to_booster_ratio"] = F.when(words > 0, balance(hedges, boosters))
        out[f"{side}_hedge_density"] = F.try_divide(hedges, words)
        out[f"{side}_booster_density"] = F.try_divide(boosters, words)
        for modal in MODALS:
            out[f"{side}_modal_{modal}_freq"] = F.try_divide(_exact(cues, modal), words)
    return scanned.select(id_col, *[out[c].alias(c) for c in COLUMNS])
