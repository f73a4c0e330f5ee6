"""Cue-phrase densities. All results are DOUBLE and NULL for blank text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import (
    BOOSTERS,
    CAUSAL_CONNECTIVES,
    GROUNDED_EVIDENTIALS,
    HEDGES,
    MODALS,
    UNGROUNDED_ASSERTIONS,
)
from .text import (
    count_matches,
    find_all,
    let,
    per_word,
    phrase_pattern,
    quantity_spans,
    raw_word_count,
    sentence_count,
    unless_blank,
)


def causal_connective_density(text: Column, connectives: Iterable[str] = CAUSAL_CONNECTIVES) -> Column:
    """Causal connectives per word."""
    return per_word(count_matches(text, phrase_pattern(connectives)), text)


def balance(plus: Column, minus: Column) -> Column:
    """``plus / minus``, or ``plus`` itself where ``minus`` is 0."""
    return plus.cast("double") / F.greatest(minus, F.lit(1))


def evidentiality_index(
    text: Column,
    grounded: Iterable[str] = GROUNDED_EVIDENTIALS,
    ungrounded: Iterable[str] = UNGROUNDED_ASSERTIONS,
) -> Column:
    """Struct of the grounded-to-ungrounded ratio and both counts."""
    pair = F.struct(
        count_matches(text, phrase_pattern(grounded)).alias("g"),
        count_matches(text, phrase_pattern(ungrounded)).alias("u"),
    )

    def fields(c: Column) -> Column:
        return F.struct(
            balance(c.g, c.u).alias("evidentiality_ratio"),
            c.g.cast("double").alias("grounded_count"),
            c.u.cast("double").alias("ungrounded_count"),
        )

    return unless_blank(text, let(pair, fields))


def hedging_calibration(
    text: Column, hedges: Iterable[str] = HEDGES, boosters: Iterable[str] = BOOSTERS
) -> Column:
    """Struct of the hedge-to-booster ratio and both densities."""
    counts = F.struct(
        count_matches(text, phrase_pattern(hedges)).alias("h"),
        count_matches(text, phrase_pattern(boosters)).alias("b"),
        raw_word_count(text).alias("n"),
    )

    def fields(c: Column) -> Column:
        return F.struct(
            balance(c.h, c.b).alias("hedge_to_booster_ratio"),
            F.try_divide(c.h.cast("double"), c.n).alias("hedge_density"),
            F.try_divide(c.b.cast("double"), c.n).alias("booster_density"),
        )

    return unless_blank(text, let(counts, fields))


def modal_verb_profile(text: Column, modals: Iterable[str] = MODALS) -> Column:
    """Struct of each modal's count per word.

    One scan collects every modal, the counts then read that short list.
    """
    modals = tuple(modals)
    found = F.struct(
        find_all(F.lower(text), phrase_pattern(modals, any_case=False)).alias("hits"),
        raw_word_count(text).alias("n"),
    )

    def frequency(c: Column, modal: str) -> Column:
        same = F.filter(c.hits, lambda m: m == modal)
        return F.try_divide(F.array_size(same).cast("double"), c.n).alias(f"modal_{modal}_freq")

    def fields(c: Column) -> Column:
        return F.struct(*[frequency(c, m) for m in modals])

    return unless_blank(text, let(found, fields))


def quantification_density(text: Column) -> Column:
    """Quantities, dates, amounts and numbers per sentence.

    Declared rule: spans of :func:`text.quantity_spans` over :func:`text.sentence_count`.
    """
    return F.array_size(quantity_spans(text)).cast("double") / sentence_count(text)
