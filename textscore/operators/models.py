"""Measures by a user's model: a tagger, an entity recogniser, a sentence classifier or a language model.

All go through one Arrow iterator: the model is made once per task, sees a bounded number of
windows at once, and a text longer than a window is cut into overlapping ones, of which each gives the
values of its own part. Only tokens or sentences cross to Python, and one value per item comes back.

A model is a callable on a list of windows, each a list of strings, that returns a list of values for each
window, one per string. A factory of such a callable is what the functions take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexical import balance
from ..functions.lexicons import ENTITY_LABELS, FORMAL_TAGS, INFORMAL_TAGS
from ..functions.text import let, raw_word_count, sentences, tokens, unless_blank

Model = Callable[[list[list[str]]], Sequence[Sequence[object]]]

#: Items of a window, items that neighbouring windows share, and windows that a model sees at once.
WINDOW, OVERLAP, AT_ONCE = 512, 64, 32


def windows(n: int, window: int, overlap: int, left_only: bool) -> list[tuple[int, int, int, int]]:
    """(start, end, first kept, end of kept) of the windows over ``n`` items; what is kept covers each item once.

    Neighbours share ``overlap`` items. Of these each gives the half that lies nearer to its
    middle, or all to the later one where only what is on the left counts as context.
    """
    out, start, kept = [], 0, 0
    while n:
        end = min(start + window, n)
        until = n if end == n else end if left_only else end - overlap // 2
        out.append((start, end, kept, until))
        if end == n:
            break
        start, kept = end - overlap, until
    return out


def _values(model: Model, lists: Iterator[list[str] | None], window: int, overlap: int, left_only: bool) -> Iterator[list | None]:
    """The values of each list in order; the model sees at most ``AT_ONCE`` windows of several lists."""
    waiting: list[tuple[list | None, int, list[tuple[int, int]]]] = []
    queue: list[list[str]] = []

    def finish() -> Iterator[list | None]:
        given = iter(model(queue)) if queue else iter(())
        for out, last, parts in waiting:
            for first, end in parts:
                values = list(next(given))
                out += values[first:end]
            if last:
                yield out
        waiting.clear()
        queue.clear()

    for items in lists:
        out: list | None = None if items is None else []
        cut = windows(len(items or ()), window, overlap, left_only)
        if not cut:
            waiting.append((out, 1, []))
        for at, (start, end, kept, until) in enumerate(cut):
            queue.append(items[start:end])
            waiting.append((out, at == len(cut) - 1, [(kept - start, until - start)]))
            if len(queue) == AT_ONCE:
                yield from finish()
    yield from finish()


def by_model(items: Column, make: Callable[[], Model], kind: str = "string", window: int = WINDOW, overlap: int = OVERLAP, left_only: bool = False) -> Column:
    """array<kind>: the model's value for each of the array ``items``; NULL for NULL.

    ``left_only`` is for models that read from left to right: a later window's first ``overlap`` items
    are context alone.
    """
    if not 0 <= overlap < window:
        raise ValueError("windows must overlap by less than their length")

    @F.arrow_udf(f"array<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            lists = (batch[i].as_py() for i in range(len(batch)))
            yield pa.array(list(_values(model, lists, window, overlap, left_only)), kind_)

    kind_ = pa.list_({"string": pa.string(), "double": pa.float64()}[kind])
    return run(items)


def token_tags(text: Column, make: Callable[[], Model], **cut) -> Column:
    """The tagger's tag of each token of ``text``."""
    return by_model(tokens(text), make, **cut)


def formality_by_model(text: Column, make: Callable[[], Model], **cut) -> Column:
    """(nouns, proper nouns, adjectives, prepositions) over (verbs, adverbs, pronouns, interjections), as a tagger names them."""

    def score(tags: Column) -> Column:
        count = lambda wanted: F.array_size(F.filter(tags, lambda t: t.isin(*wanted)))
        return balance(count(FORMAL_TAGS), count(INFORMAL_TAGS))

    return unless_blank(text, let(token_tags(text, make, **cut), score))


def mood_by_model(text: Column, make: Callable[[], Model], imperative: str = "IMPERATIVE", other: str | None = None, **cut) -> Column:
    """Imperative over other sentences, by a model of sentences; those it leaves without a label do not count.

    ``other`` names the label that counts as declarative; by default every other label does.
    """

    def score(labels: Column) -> Column:
        commands = F.array_size(F.filter(labels, lambda x: x == imperative))
        rest = F.filter(labels, lambda x: (x == other) if other else (x != imperative))
        return balance(commands, F.array_size(rest))

    return unless_blank(text, let(by_model(sentences(text), make, **cut), score))


def labelled_runs(words: Column, labels: Column, wanted: Sequence[str]) -> Column:
    """array<struct<label, span>>: the maximal runs of tokens of one wanted label, joined by a space, in order; linear in the tokens."""

    def runs(x: Column) -> Column:
        tag = lambda i: F.get(x["tags"], i)
        # the place of each token that begins a run, and of each that ends one: as many, in the same order
        edge = lambda step: F.filter(F.transform(x["tags"], lambda t, i: F.when(t.isNotNull() & ~t.eqNullSafe(tag(i + step)), i)), lambda i: i.isNotNull())

        def cut(edges: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                span = F.slice(x["words"], start + 1, F.get(edges["last"], k) - start + 1)
                return F.struct(tag(start).alias("label"), F.array_join(span, " ").alias("span"))

            return F.transform(edges["first"], run)

        return let(F.struct(edge(-1).alias("first"), edge(1).alias("last")), cut)

    def tagged(x: Column) -> Column:
        label = lambda w, i: F.get(x["labels"], i)
        tags = F.transform(x["words"], lambda w, i: F.when(label(w, i).isin(*wanted), label(w, i)))
        return let(F.struct(x["words"].alias("words"), tags.alias("tags")), runs)

    return let(F.struct(words.alias("words"), labels.alias("labels")), tagged)


def entity_density_by_model(text: Column, make: Callable[[], Model], labels: Sequence[str] = ENTITY_LABELS, **cut) -> Column:
    """Distinct entities per word; an entity is a maximal run of tokens to which the model gives one of the labels."""
    words = tokens(text)
    both = F.struct(words.alias("words"), by_model(words, make, **cut).alias("labels"))

    def distinct(x: Column) -> Column:
        found = labelled_runs(x["words"], x["labels"], labels)
        return F.array_size(F.array_distinct(F.transform(found, lambda r: r["span"])))

    return F.try_divide(let(both, distinct).cast("double"), raw_word_count(text))


def label_counts(text: Column, make: Callable[[], Model], labels: Sequence[str], **cut) -> Column:
    """Struct with the number of runs of each label, as ``labels`` names them."""
    words = tokens(text)
    both = F.struct(words.alias("words"), by_model(words, make, **cut).alias("labels"))

    def of(found: Column, name: str) -> Column:
        return F.array_size(F.filter(found, lambda r: r["label"] == name)).cast("long").alias(name)

    def count(x: Column) -> Column:
        return let(labelled_runs(x["words"], x["labels"], labels), lambda found: F.struct(*[of(found, name) for name in labels]))

    return F.when(text.isNotNull(), let(both, count))


def surprisal_by_model(text: Column, make: Callable[[], Model], **cut) -> Column:
    """Struct (surprisal_mean, surprisal_std, n_scored) of the surprisals that a language model gives each token.

    A token to which it gives NULL or NaN, such as a first one, has no score; mean and deviation are NULL without any.
    """
    found = by_model(tokens(text), make, kind="double", **{"left_only": True, **cut})

    def summary(values: Column) -> Column:
        n = F.array_size(values)
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

        def spread(mean: Column) -> Column:
            square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            return F.struct(mean.alias("surprisal_mean"), F.sqrt(F.try_divide(square, n.cast("double"))).alias("surprisal_std"), n.cast("long").alias("n_scored"))

        return let(F.try_divide(total, n.cast("double")), spread)

    known = F.filter(found, lambda x: x.isNotNull() & ~F.isnan(x))
    return let(F.coalesce(known, F.array().cast("array<double>")), summary)
