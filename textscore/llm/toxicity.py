"""Toxicity by a learned lexicon, matched fuzzily and weighed by context.

A bounded sample of labelled texts gives the terms: words and word stems that many toxic
and hardly any clean texts hold. The terms form a trie; the Levenshtein automata of all of
them run along it together, made deterministic as words come in, so that a word costs one
table step per letter and a misspelt term (one edit from five letters on, two from nine) is
still found. Every (term, edits) pair is weighed by how much more often it occurs in toxic
than in clean texts of the sample.

Each hit is weighed by the window around it: inside quotation marks, or next to a word of
reporting, it counts less than in plain use. A text's evidence is the sum over its distinct
terms of the best hit; the score is the logistic function of evidence minus a border that
separates the sample best.

NULL and empty texts have no evidence and so the lowest score. Without labelled texts of
both kinds there is no lexicon and every text gets that score. Texts are read whole;
repeated rows each give their row.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm import chars, pretokens
from textscore.llm.common import SLICE, broadcast, sample_per_class, slices, worker_cache
from textscore.session import store

#: Distinct words a worker remembers.
MEMO = 600_000
#: Letters of the stems that are counted; longer terms are whole words.
STEMS = range(4, 9)
# Quotation marks that open and close, and words of reporting.
OPENING, CLOSING, EITHER = "“«„‹", "”»‟›", "\""
REPORTING = frozenset("said says quoted quotes quote wrote writes called named sagte zitierte schrieb zitat nannte cité cita écrit appelé dijo citó escribió llamó palabra".split())
#: Share of a hit's weight that is left inside quotation marks, and beside a word of reporting.
QUOTED, REPORTED = 0.3, 0.6
#: Words of the same text on either side of a hit that are searched for reporting.
WORD_WINDOW = 5
_MARKS = re.compile(f"[\n{OPENING}{CLOSING}{EITHER}]")
_WORD = re.compile(r"[^\W\d_]+")
#: Outside of any quotation: no opening mark, no odd straight ones.
PLAIN: tuple[bool, frozenset[str]] = (False, frozenset())


def edits(term: str) -> int:
    """How many edits a misspelling of ``term`` may have."""
    return (len(term) >= 5) + (len(term) >= 9)


class Lexicon:
    """The terms' Levenshtein automata along their trie, as one automaton built on demand.

    A state maps trie nodes to the fewest edits that lead there. ``match`` gives
    (term number, edits) of the closest term, the first one of equals, or None. A term that
    is a stem matches every word that begins like it.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.room = [0]
        for number, (term, _) in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], edits(term))
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                node = self.children[node][char]
                self.room[node] = max(self.room[node], edits(term))
            self.ends.setdefault(node, number)
        self.states: list[dict[int, int]] = []
        self.found: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        open_ = list(nodes.items())
        while open_:  # a letter of the term may be missing from the word
            node, e = open_.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    open_.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            hits = [(e, self.ends[n]) for n, e in key if n in self.ends and e <= edits(self.terms[self.ends[n]][0])]
            best = lambda some: min(some, default=None)
            self.found.append((best(hits), best([h for h in hits if not self.terms[h[1]][1]])))
        return self.numbers[key]

    def _step(self, state: int, char: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.room[node] and e < nodes.get(node, 99):
                nodes[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)
            for letter, child in self.children[node].items():
                reach(child, e + (letter != char))
        self.steps[state][char] = to = self._state(nodes) if nodes else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for char in word:
            to = self.steps[state].get(char)
            state = self._step(state, char) if to is None else to
            if state < 0:
                break
            stem = self.found[state][1]
            if stem and (best is None or stem < best):
                best = stem
        else:
            whole = self.found[state][0]
            if whole and (best is None or whole < best):
                best = whole
        return best and (best[1], best[0])


@dataclass
class ToxicityModel:
    """What ``fit`` learned; bounded by ``max_terms``."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int], float]
    border: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scanner:
    """Finds the hits of a lexicon in texts, with the share of weight that their context leaves."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.lexicon = Lexicon(terms)
        self.alphabet = chars.Alphabet()
        self._start()

    def _start(self) -> None:
        self.memo = chars.Memo(MEMO)
        self.matches = np.zeros(0, np.int64)
        self.known = 0

    def _learn(self, words: list[str]) -> None:
        match = self.lexicon.match
        got = [match(w) for w in words]
        while self.known + len(got) > len(self.matches):
            self.matches = np.concatenate([self.matches, np.full(max(1024, len(self.matches)), -1)])
        self.matches[self.known : self.known + len(got)] = [-1 if m is None else m[0] * 4 + m[1] for m in got]
        self.known += len(got)

    def hits(self, texts: Iterable[str | None]) -> Iterator[tuple[int, dict[tuple[int, int], float]]]:
        """(row, {(term, edits): largest share}) of every piece of text with a hit."""
        if not self.lexicon.terms:
            return
        texts = list(texts)
        now, offset, state, earlier = -1, 0, PLAIN, []
        for rows, parts in chars.chunks(texts):
            if self.memo.full():
                self._start()
            points, kinds, ends = self.alphabet.read(parts)
            small = self.alphabet.lower[points]
            starts, stops = chars.runs(kinds, (chars.LETTER,))
            numbers, new = self.memo.numbers(self.alphabet.hashes(small, starts, stops))
            if len(new):
                self._learn(pretokens.strings(small, starts[new], stops[new]))
            found = self.matches[numbers]
            borders = ends - np.diff(ends, prepend=-1) + 1
            firsts, lasts = np.searchsorted(starts, borders), np.searchsorted(starts, ends)
            hit = np.flatnonzero(found >= 0)
            for part, (row, low, high) in enumerate(zip(rows, np.searchsorted(hit, firsts).tolist(), np.searchsorted(hit, lasts).tolist(), strict=True)):
                if row != now:
                    now, offset, state, earlier = row, 0, PLAIN, []
                whole = len(parts[part]) == len(texts[row] or "")
                if low == high and whole:
                    continue
                first, last = int(firsts[part]), int(lasts[part])
                words = hit[low:high].tolist()
                inside, state = quotation(parts[part], (starts[words] - borders[part]).tolist(), state)
                offset += len(parts[part])
                own: dict[tuple[int, int], float] = {}
                for word, quoted in zip(words, inside, strict=True):
                    left, right = max(first, word - WORD_WINDOW), min(last, word + WORD_WINDOW + 1)
                    near = pretokens.strings(small, starts[left:right], stops[left:right])
                    if not whole:  # a long text's window goes on in the pieces before and behind
                        near += earlier[max(0, len(earlier) - (WORD_WINDOW - (word - left))) :]
                        near += [w[0].lower() for w in itertools.islice(_WORD.finditer(texts[row], offset), word + WORD_WINDOW + 1 - right)]
                    pair = divmod(int(found[word]), 4)
                    own[pair] = max(share(quoted, near), own.get(pair, 0.0))
                if not whole:
                    tail = slice(max(first, last - WORD_WINDOW), last)
                    earlier = [*earlier, *pretokens.strings(small, starts[tail], stops[tail])][-WORD_WINDOW:]
                if own:
                    yield row, own


def quotation(text: str, places: list[int], state: tuple[bool, frozenset[str]] = PLAIN) -> tuple[list[bool], tuple[bool, frozenset[str]]]:
    """Whether each of ``places``, in order, is quoted on its line, and the state behind ``text``; ``state`` is that before it."""
    opened, odd = state
    inside: list[bool] = []
    for found in _MARKS.finditer(text):
        while len(inside) < len(places) and places[len(inside)] <= found.start():
            inside.append(opened or bool(odd))
        if found[0] == "\n":
            opened, odd = PLAIN
        elif found[0] in EITHER:
            odd = odd ^ {found[0]}
        else:
            opened = found[0] in OPENING
    inside += [opened or bool(odd)] * (len(places) - len(inside))
    return inside, (opened, odd)


def share(quoted: bool, near: list[str]) -> float:
    """The share of a hit's weight that its context leaves; ``near`` are the words around it."""
    return QUOTED if quoted else REPORTED if REPORTING.intersection(near) else 1.0


def context(text: str, at: int, near: list[str]) -> float:
    """The share that is left of a hit at ``at`` of ``text``."""
    return share(quotation(text[:at], [at])[0][0], near)


class Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.scanner = model, Scanner(model.terms)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        best: dict[int, dict[int, float]] = defaultdict(dict)
        for row, hits in self.scanner.hits(texts):
            for pair, share in hits.items():
                weight = share * self.model.weights.get(pair, 0.0)
                best[row][pair[0]] = max(weight, best[row].get(pair[0], 0.0))
        out = np.zeros(len(texts))
        for row, terms in best.items():
            out[row] = sum(terms.values())
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.model.border - self.evidence(texts), -500, 500)))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, clean texts): distinct words and stems of each text, summed per task."""
    find = re.compile(r"[^\W\d_]+").findall
    for batch in slices(batches):
        tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(find((text or "").lower()))
            own = {w[:n] for w in words for n in STEMS if len(w) >= n}
            own.update(w + " " for w in words)
            for feature in own:
                tally[feature][0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(tally.keys(), pa.string()), pa.array([x[0] for x in tally.values()], pa.int64()), pa.array([x[1] for x in tally.values()], pa.int64())], names=["feature", "toxic", "clean"]
        )


def _distinct(sample: DataFrame) -> list[tuple[object, int]]:
    """(key, label) of one text of each group of near copies, so that a copied text counts once.

    Two texts count as copies where any of four smallest five-word hashes agree. The sample is bounded.
    """

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, salts = chars.Alphabet(), np.arange(1, 5, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            least = np.full((batch.num_rows, 4), np.iinfo(np.uint64).max, np.uint64)
            for rows, parts in chars.chunks(batch.column(2).to_pylist()):
                points, kinds, ends = alphabet.read(parts)
                starts, stops = chars.runs(kinds, (chars.LETTER,))
                hashes = alphabet.hashes(alphabet.lower[points], starts, stops)
                for row, own in zip(rows, np.split(hashes, np.cumsum(chars.counts_per_part(starts, ends))[:-1]), strict=True):
                    grams = sum((own[i : len(own) - 4 + i] * np.uint64(2 * i + 3) for i in range(5)), np.uint64(0)) if len(own) > 4 else own
                    if len(grams):
                        least[row] = np.minimum(least[row], chars.mix(grams[None] ^ salts).min(axis=1))
            columns = [pa.array((least[:, i] >> np.uint64(1)).astype(np.int64)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "toxic", "a", "b", "c", "d"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "toxic", "text").mapInArrow(smallest, f"key {kind}, toxic int, a long, b long, c long, d long").collect()
    seen: set = set()
    kept = []
    for row in sorted(rows, key=lambda r: str(r.key)):
        own = {(i, row.toxic, v) for i, v in enumerate((row.a, row.b, row.c, row.d))}
        if not own & seen:
            kept.append((row.key, row.toxic))
        seen |= own
    return kept


def choose_terms(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, ratio: float, max_terms: int) -> list[tuple[str, bool]]:
    """(term, whole word) from (feature, toxic texts, clean texts).

    A stem that goes with toxicity is lengthened while that loses hardly any text; where one
    word makes up nearly all of it, the word itself is the term.
    """
    odds = {f: (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1)) for f, t, c in rows}
    seen = {f: t for f, t, _ in rows}
    good = {f for f in odds if odds[f] >= ratio}
    longer: dict[str, list[str]] = defaultdict(list)
    for f in seen:
        longer[f[:-1]].append(f)
    terms: dict[str, bool] = {}
    for f in sorted(good, key=lambda f: (len(f.rstrip()), f)):
        word = f.rstrip()
        if any(word[:n] in terms and not terms[word[:n]] for n in range(1, len(word) + 1)) or word in terms:
            continue
        if f.endswith(" "):
            terms[word] = True
            continue
        stem = f
        while step := [x for x in longer[stem] if not x.endswith(" ") and seen[x] >= 0.95 * seen[stem]]:
            stem = max(step, key=lambda x: seen[x])
        whole = [x for x in seen if x.endswith(" ") and x.startswith(stem) and seen[x] >= 0.9 * seen[stem]]
        if whole:
            terms[max(whole, key=lambda x: seen[x]).rstrip()] = True
        else:
            terms[stem] = False
    ranked = sorted(terms, key=lambda t: (-seen.get(t + " " if terms[t] else t, 0), t))[:max_terms]
    return [(t, terms[t]) for t in ranked]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = 8000, ratio: float = 30.0, chance: float = 5.0, max_terms: int = 2000) -> ToxicityModel:
    """A model from about ``rows`` labelled texts of each kind (1 toxic, 0 clean).

    A term must occur ``ratio`` times as often in toxic texts, and in so many that about
    ``chance`` of all features counted would do so if toxicity had no words of its own.
    """
    source = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(toxic).cast("int").alias("toxic")).where("toxic in (0, 1)")
    sample = sample_per_class(source, "toxic", "key", rows)
    kept = dict(_distinct(sample))
    spark = labelled.sparkSession
    n_toxic = sum(kept.values())
    n_clean = len(kept) - n_toxic
    if not n_toxic or not n_clean:
        return ToxicityModel([], {}, 2.0)
    chosen = spark.createDataFrame([(k,) for k in kept], f"kept {source.schema['key'].dataType.simpleString()}")
    texts = sample.join(F.broadcast(chosen), F.col("key") == F.col("kept"), "left_semi").select("text", "toxic")
    expected = (F.col("toxic") + F.col("clean")) * F.lit(n_toxic / (n_toxic + n_clean))
    surprise = 2 * F.col("toxic") * F.log(F.col("toxic") / expected)
    tallied = texts.mapInArrow(_features, "feature string, toxic long, clean long").groupBy("feature")
    features = store(tallied.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3"), "features")
    least = 2 * float(np.log(max(1, features.count()) / chance))
    counted = (
        features.where((surprise >= least) & ((F.col("toxic") + 0.5) / (n_toxic + 1) >= ratio * (F.col("clean") + 0.5) / (n_clean + 1)))
        .orderBy(F.desc("toxic"), "feature")
        .limit(20 * max_terms)
        .collect()
    )
    terms = choose_terms([tuple(r) for r in counted], n_toxic, n_clean, ratio, max_terms)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for number, batch in enumerate(slices(batches)):
            labels = batch.column(1).to_pylist()
            own: dict[int, dict] = {row: {} for row in range(batch.num_rows)}
            for row, hits in scanner.hits(batch.column(0).to_pylist()):
                for pair, share in hits.items():
                    own[row][pair] = max(share, own[row].get(pair, 0.0))
            listed = [[f"{t}:{e}:{s}" for (t, e), s in own[row].items()] for row in own]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(listed, pa.list_(pa.string()))], names=["toxic", "hits"])

    # bounded: one short row per text of the sample
    scanned = [(r.toxic, [(int(t), int(e), float(s)) for t, e, s in (h.split(":") for h in r.hits)]) for r in texts.mapInArrow(scan, "toxic int, hits array<string>").collect()]
    seen: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for label, hits in scanned:
        for t, e, _ in hits:
            seen[t, e][0 if label else 1] += 1

    def log_odds(t: int, c: int) -> float:
        """A cautious weight: two texts prove less than two hundred."""
        odds = np.log((t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1)))
        return float(np.clip(odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), 0, 6))

    weights: dict[tuple[int, int], float] = {}
    for t, (term, _) in enumerate(terms):
        weights[t, 0] = log_odds(*seen[t, 0])
        for e in range(1, edits(term) + 1):
            # not seen in the sample at all: a misspelling counts for part of the term
            weights[t, e] = min(weights[t, 0], log_odds(*seen[t, e]) if sum(seen[t, e]) else weights[t, 0] * 0.5**e)
    return ToxicityModel(terms, weights, _border(weights, scanned))


def _border(weights: dict, scanned: list[tuple[int, list]]) -> float:
    """The evidence that separates the sample best; with room to spare, nearer to the clean side."""
    points = []
    for label, hits in scanned:
        best: dict[int, float] = {}
        for t, e, share in hits:
            best[t] = max(best.get(t, 0.0), share * weights[t, e])
        points.append((sum(best.values()), label))
    values = sorted({x for x, _ in points} | {0.0})
    sums = np.array([[sum(1 for x, y in points if x <= v and y == k) for k in (0, 1)] for v in values]) if len(values) < 2000 else None
    if sums is None:
        ordered = sorted(points)
        values = [x for x, _ in ordered]
        sums = np.cumsum([[y == 0, y == 1] for _, y in ordered], axis=0)
    # a clean text called toxic weighs as much as three toxic ones missed
    right = 3 * sums[:, 0] / max(1, sums[-1, 0]) + 1 - sums[:, 1] / max(1, sums[-1, 1])
    gaps = np.diff([*values, values[-1] + 4.0])
    best = max(range(len(values)), key=lambda i: (round(float(right[i]), 6), gaps[i]))
    return values[best] + min(2.0, gaps[best] / 2)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", result: str = "toxicity") -> DataFrame:
    """``docs`` with a DOUBLE column ``result`` from 0 to 1 (a column of that name is replaced)."""
    read, key = broadcast(docs.sparkSession, model), model.key

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_cache("toxicity", key, lambda: Scorer(read()))
        for batch in texts:
            yield pa.array(np.concatenate([np.zeros(0), *[own.score(batch.slice(at, SLICE).to_pylist()) for at in range(0, len(batch), SLICE)]]))

    return docs.withColumn(result, run(F.col(text).cast("string")))
