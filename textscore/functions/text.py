"""Text primitives as native Columns: blank test, words, tokens, sentences, labels.

Unicode contract: a *word* is a whitespace-free run, where whitespace is the
Unicode property plus U+001C..U+001F; a *token* is a run of letters, numbers and
underscores of any script. Patterns spell these classes out, so that results do
not depend on the JVM's meaning of ``\\w`` and ``\\b``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import QUANTITY_LABELS

NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
WORD = NON_SPACE + "++"
TOKEN_CHAR = r"[\p{L}\p{N}_]"
NOT_TOKEN_CHAR = r"[^\p{L}\p{N}_]"
TOKEN = TOKEN_CHAR + "++"
EDGE_LEFT = rf"(?<!{TOKEN_CHAR})"
EDGE_RIGHT = rf"(?!{TOKEN_CHAR})"
STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"

# The last mark of a run ends a sentence; looking at single marks keeps long runs linear.
SENTENCE_END = r"[.!?](?:\s|\z)"
CLOSED_SENTENCE = r"[.!?]\s*+\z"
FIRST_TOKEN = rf"(?:\A|[.!?]\s+){NOT_TOKEN_CHAR}*+({TOKEN_CHAR}++)"

_NUMBER = r"\d++(?:[.,]\d++)*+"
# One alternation, tried in the order of QUANTITY_LABELS.
QUANTITY_PARTS = {
    "PERCENT": rf"{_NUMBER}\s?(?:%|percent)",
    "MONEY": rf"[$€£]\s?{_NUMBER}(?:\s?(?:million|billion|[KMB]))?",
    "DATE": r"\d{4}-\d{2}-\d{2}|Q[1-4](?:\s\d{4})?",
    "TIME": r"\d{1,2}:\d{2}",
    "QUANTITY": rf"{_NUMBER}\s?(?:kg|km|hours|days|units)",
    "CARDINAL": _NUMBER,
}
# The look-ahead lists every possible first character, so most positions fail at once.
QUANTITY = "(?=[0-9$€£Q])(?:" + "|".join(QUANTITY_PARTS[label] for label in QUANTITY_LABELS) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def count_matches(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches, as a BIGINT."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _first_letters(phrases: Iterable[str]) -> str:
    """Every character a phrase may start with when case is ignored."""
    folded = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}  # letters that fold to ASCII
    firsts = {p[0].lower() for p in phrases}
    return "".join(sorted({c for f in firsts for c in f + f.upper() + folded.get(f, "")}))


def phrase_pattern(phrases: Iterable[str], any_case: bool = True) -> str:
    """Any of the phrases as whole words; the first listed wins at a position.

    A look-ahead for the first letter, outside the case-folding group, rejects most
    positions of a text with one table look-up.
    """
    phrases = tuple(phrases)
    listed = "|".join(re.escape(p) for p in phrases)
    if not any_case:
        starts = "".join(sorted({p[0] for p in phrases}))
        return rf"(?=[{re.escape(starts)}]){EDGE_LEFT}(?:{listed}){EDGE_RIGHT}"
    return rf"(?=[{re.escape(_first_letters(phrases))}]){EDGE_LEFT}(?iu:{listed}){EDGE_RIGHT}"


def is_blank(text: Column) -> Column:
    """True for NULL and for text without a single non-space character."""
    return text.isNull() | ~text.rlike(NON_SPACE)


def unless_blank(text: Column, value: Column) -> Column:
    return F.when(text.rlike(NON_SPACE), value)


def raw_word_count(text: Column) -> Column:
    """Whitespace-separated words: 0 for blank text, NULL for NULL.

    As a divisor under ``try_divide`` it turns blank texts into NULL on its own.
    """
    return count_matches(text, WORD)


def word_count(text: Column) -> Column:
    """Word count of at least 1; NULL and blank text count 1."""
    return F.greatest(F.coalesce(raw_word_count(text), F.lit(0)), F.lit(1)).cast("long")


def per_word(hits: Column, text: Column) -> Column:
    """``hits`` over the words of ``text``; NULL for blank text."""
    return F.try_divide(hits.cast("double"), raw_word_count(text))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens, in order."""
    return find_all(F.lower(text), TOKEN)


def token_count(text: Column) -> Column:
    return count_matches(text, TOKEN)


def sentence_count(text: Column) -> Column:
    """Sentences, at least 1; a mark inside a number does not end one; NULL for blank text."""
    ends = count_matches(text, SENTENCE_END)
    tail = F.when(text.rlike(CLOSED_SENTENCE), 0).otherwise(1)
    return unless_blank(text, ends + tail)


def sentences(text: Column) -> Column:
    """The sentences themselves, split after a terminator; blank pieces are dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(NON_SPACE))


def first_tokens(text: Column) -> Column:
    """First word token of every sentence that has one."""
    return find_all(text, FIRST_TOKEN, 1)


def quantity_spans(text: Column) -> Column:
    """Percentages, amounts of money, dates, times, quantities and numbers, in order."""
    return find_all(text, QUANTITY)


def span_label(span: Column) -> Column:
    """Label of a span: the first alternative that matches all of it."""
    label = F.lit(None).cast("string")
    for name in reversed(QUANTITY_LABELS):
        label = F.when(span.rlike(rf"\A(?:{QUANTITY_PARTS[name]})\z"), name).otherwise(label)
    return label


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, STRIP, "")


def to_snake_case(text: Column) -> Column:
    """``KeyRate By Team`` -> ``key_rate by _team``: two passes over case changes, then lower case."""
    first = F.regexp_replace(text, r"([^\n])([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(first, r"([a-z0-9])([A-Z])", "$1_$2"))


def clean_label(text: Column) -> Column:
    """Readable feature name of a normalised answer-side metric column."""
    for piece in ("norm_answer_", "_freq", "_density"):
        text = F.replace(text, F.lit(piece), F.lit(""))
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
