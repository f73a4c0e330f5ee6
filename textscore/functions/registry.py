"""Named text measures, open to a user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from . import annotate, lexical, readability, text

Measure = Callable[[Column], Column]

_MEASURES: dict[str, Measure] = {}


def register(name: str, measure: Measure, replace: bool = False) -> None:
    """Add ``measure`` (Column -> Column, native or a pandas UDF) under ``name``."""
    if name in _MEASURES and not replace:
        raise ValueError(f"measure {name!r} is already registered")
    _MEASURES[name] = measure


def measure(name: str) -> Measure:
    try:
        return _MEASURES[name]
    except KeyError:
        raise KeyError(f"no measure {name!r}; known: {', '.join(sorted(_MEASURES))}") from None


def names() -> list[str]:
    return sorted(_MEASURES)


def add_measures(df: DataFrame, text_col: str, wanted: Iterable[str], prefix: str = "") -> DataFrame:
    """``df`` with one column per wanted measure of ``text_col``."""
    return df.withColumns({f"{prefix}{name}": measure(name)(df[text_col]) for name in wanted})


for _name, _measure in {
    "word_count": text.word_count,
    "sentence_count": text.sentence_count,
    "causal_density": lexical.causal_connective_density,
    "evidentiality": lexical.evidentiality_index,
    "hedging": lexical.hedging_calibration,
    "modal_profile": lexical.modal_verb_profile,
    "quantification_density": lexical.quantification_density,
    "entity_density": annotate.entity_density,
    "formality_score": annotate.formality_score,
    "imperative_to_declarative_ratio": annotate.mood_ratio,
    "flesch_reading_ease": readability.flesch_reading_ease,
    "flesch_kincaid_grade": readability.flesch_kincaid_grade,
}.items():
    register(_name, _measure)
