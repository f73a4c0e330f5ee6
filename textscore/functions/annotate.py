"""Declared rules for measures that would otherwise need a tagger or parser.

The values follow the rules stated here; they are not comparable with those of a
pretrained model.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import BASE_VERBS, CLOSED_CLASSES, ENTITY_LABELS, FORMAL_TAGS, INFORMAL_TAGS, SUFFIX_RULES
from .lexical import balance
from .text import find_all, first_tokens, let, per_word, quantity_spans, span_label, tokens, unless_blank


def suffix_tag(token: Column) -> Column:
    """Part of speech of an open-class token by its ending; a noun if none fits."""
    tag = F.lit("NOUN")
    for name, endings in reversed(SUFFIX_RULES):
        fits = F.lit(False)
        for ending in endings:
            fits = fits | token.endswith(ending)
        tag = F.when(fits, name).otherwise(tag)
    return tag


def token_tag(token: Column, closed: Mapping[str, Iterable[str]] = CLOSED_CLASSES) -> Column:
    """Closed classes by lookup, all other tokens by suffix."""
    tag = suffix_tag(token)
    for name, words in closed.items():
        tag = F.when(token.isin(*words), name).otherwise(tag)
    return tag


def formality_score(text: Column, closed: Mapping[str, Iterable[str]] = CLOSED_CLASSES) -> Column:
    """(nouns, proper nouns, adjectives, prepositions) over (verbs, adverbs, pronouns, interjections)."""
    tags = F.transform(tokens(text), lambda t: token_tag(t, closed))

    def score(ts: Column) -> Column:
        formal = F.array_size(F.filter(ts, lambda t: t.isin(*FORMAL_TAGS)))
        informal = F.array_size(F.filter(ts, lambda t: t.isin(*INFORMAL_TAGS)))
        return balance(formal, informal)

    return unless_blank(text, let(tags, score))


def mood_ratio(text: Column, verbs: Iterable[str] = BASE_VERBS) -> Column:
    """Imperative over declarative sentences.

    A sentence is imperative when its first token is a base verb of the list, and
    declarative otherwise; sentences without a token are left out.
    """
    verbs = tuple(verbs)

    def score(firsts: Column) -> Column:
        commands = F.array_size(F.filter(firsts, lambda t: t.isin(*verbs)))
        return balance(commands, F.array_size(firsts) - commands)

    return unless_blank(text, let(first_tokens(F.lower(text)), score))


def labelled_spans(text: Column, labels: Iterable[str]) -> Column:
    """Distinct lower-cased quantity spans that carry one of the labels."""
    labels = tuple(labels)
    kept = F.filter(quantity_spans(text), lambda s: span_label(s).isin(*labels))
    return F.array_distinct(F.transform(kept, F.lower))


def entity_density(
    text: Column,
    gazetteer: Mapping[str, str] | None = None,
    labels: Iterable[str] = ENTITY_LABELS,
) -> Column:
    """Distinct entities per word.

    Entities are quantity spans labelled MONEY, PERCENT or DATE, and the terms of
    ``gazetteer`` (term -> label) found as runs of tokens. For a gazetteer held in
    a table use :func:`textscore.operators.entities.entity_density_by_table`.
    """
    labels = tuple(labels)
    spans = labelled_spans(text, labels)
    terms = {" ".join(re.findall(r"\w+", t.lower())) for t, lab in (gazetteer or {}).items() if lab in labels} - {""}
    if terms:
        listed = F.array(*[F.lit(t) for t in sorted(terms)])
        line = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
        spans = let(line, lambda whole: F.array_union(spans, F.filter(listed, lambda t: whole.contains(F.concat(F.lit(" "), t, F.lit(" "))))))
    return per_word(F.array_size(spans), text)
