"""Published readability formulas over declared word, sentence and syllable rules.

Syllables of a token: vowel groups, minus one for a silent final ``e``, at least 1.
The sum over a text is taken with whole-text match counts instead of a per-token
loop: no vowel group or silent ``e`` crosses a token edge, so

    syllables = groups - silent finals + tokens whose own balance is 0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE_LEFT, EDGE_RIGHT, TOKEN_CHAR, count_matches, sentence_count, token_count

# ---- fixed values: vowel letters of the syllable rule --------------------------
PLAIN_VOWELS = "aeiouy"
ACCENTED_VOWELS = "àâäéèêëîïôöùûüáíóúñ"

_VOWEL = f"[{PLAIN_VOWELS}{ACCENTED_VOWELS}]"
_CONSONANT = f"[{TOKEN_CHAR}&&[^{PLAIN_VOWELS}{ACCENTED_VOWELS}]]"
_BEFORE_SILENT = f"[{TOKEN_CHAR}&&[^{PLAIN_VOWELS}l]]"

VOWEL_GROUP = f"{_VOWEL}++"
SILENT_FINAL = f"e{EDGE_RIGHT}(?<={_BEFORE_SILENT}e)"
# No vowel at all, or a single vowel group that is a silent final.
ZERO_BALANCE = (
    f"{EDGE_LEFT}(?:{_CONSONANT}++{EDGE_RIGHT}"
    f"|{_CONSONANT}*(?:[{_CONSONANT}&&[^l]]|{_VOWEL}*[{ACCENTED_VOWELS}])e{EDGE_RIGHT})"
)


def syllable_count(text: Column) -> Column:
    low = F.lower(text)
    return count_matches(low, VOWEL_GROUP) - count_matches(low, SILENT_FINAL) + count_matches(low, ZERO_BALANCE)


def _formula(text: Column, base: float, per_sentence: float, per_syllable: float) -> Column:
    words = token_count(text).cast("double")
    length = F.try_divide(words, sentence_count(text))
    weight = F.try_divide(syllable_count(text).cast("double"), words)
    return F.lit(base) + F.lit(per_sentence) * length + F.lit(per_syllable) * weight


def flesch_reading_ease(text: Column) -> Column:
    """206.835 - 1.015 words/sentences - 84.6 syllables/words; NULL without tokens."""
    return _formula(text, 206.835, -1.015, -84.6)


def flesch_kincaid_grade(text: Column) -> Column:
    """0.39 words/sentences + 11.8 syllables/words - 15.59; lower is better; NULL without tokens."""
    return _formula(text, -15.59, 0.39, 11.8)
