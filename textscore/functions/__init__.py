"""Column functions: text in, measure out; no shuffle, no Python worker."""

from .annotate import entity_density, formality_score, mood_ratio
from .judgments import (
    evaluate_reasoning,
    fenced_json,
    flatten_claims,
    judge_request,
    judgment_of_reply,
    observations_and_hypotheses,
    parse_judgment,
    recommendations,
    request_table,
    total_reasoning_count,
    valid_reasoning_count,
)
from .lexical import (
    causal_connective_density,
    evidentiality_index,
    hedging_calibration,
    modal_verb_profile,
    quantification_density,
)
from .readability import flesch_kincaid_grade, flesch_reading_ease, syllable_count
from .registry import add_measures, measure, names, register
from .sections import extract_interpretations, extract_observations, extract_recommendations, extract_section
from .sql import register_sql
from .text import clean_label, is_blank, sentence_count, sentences, to_snake_case, token_count, tokens, word_count
