"""Ranked lexical search: hashed max-sketches give upper bounds, descending bounds are rescored exactly.

Terms are the maximal runs of letters and digits of ASCII and of all other characters beyond
it, A-Z lower-cased. Within a document a term's impact is ``10**9 tf div (1000 tf + 8 m)``
with ``m = 10 + (90 n N) div L`` (n the document's terms, N the documents that hold a term, L
all terms); a document's score sums impact times ``floor(1000 ln((2N + 2) / (2df + 1)))`` over
an item's distinct terms. All sums are exact integers.

Two scans of the texts, no shuffle of them. The first counts N, L and the df of the items'
terms. In the second, a task takes a few documents at a time: every term of a document folds
its impact into the cells that two hashes choose, by maximum, in a sketch four to eight
times as wide as the document's distinct terms. One lookup of all items' terms in all
sketches of one width gives upper bounds: a cell holds the term's impact or more. The task
keeps each item's k best so far; the documents whose bound reaches the k-th are scored exactly in
descending order of their bounds, until the next bound is below. The tasks' winners meet in one
ranking. Terms are found by a 64-bit hash and compared byte by byte before they count.

Items go in blocks of bounded size, each broadcast to the tasks. NULL and empty texts hold no
term. Ties go to the smaller id, NULL ids last; repeated rows are documents of their own; rows
of one item id are one item. Items without a term, and empty tables, give no rows. Only
documents with a score above 0 are returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm import chars
from textscore.llm.common import broadcast

#: What a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and rows worked on at once.
WINDOW, ROWS = 1 << 21, 4096
#: Items, and bytes of their texts, of one block.
ITEMS, ITEM_BYTES = 4096, 8 << 20
#: Cells of a sketch for each distinct term of its document, at least.
CELLS = 4
#: Values of a lookup held at once.
LOOKUP = 1 << 22
_BITS = 50
_LOW = np.uint64(64 - _BITS)
_PLACES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of a text, in order."""
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [t.encode("utf-8", "surrogatepass") for t in dict.fromkeys(re.findall(TERM, lowered))]


class Reader:
    """Finds and hashes the terms of texts given as UTF-8 bytes."""

    def __init__(self) -> None:
        byte = np.arange(256)
        self.is_term = (byte >= 128) | ((byte >= 48) & (byte < 58)) | ((byte >= 65) & (byte < 91)) | ((byte >= 97) & (byte < 123))
        self.lower = np.where((byte >= 65) & (byte < 91), byte + 32, byte).astype(np.uint8)
        self.value = chars.mix(self.lower.astype(np.uint64) + np.uint64(1))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data):
            size = max(len(data), WINDOW)
            factor, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
            self.powers = np.cumprod(np.full(size, factor, np.uint64), dtype=np.uint64)
            self.inverses = np.cumprod(np.full(size, inverse, np.uint64), dtype=np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.inverses[starts]
        return chars.mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hash(self, term: bytes) -> int:
        data = np.frombuffer(term, np.uint8)
        return int(self._hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0])

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end, row) of every term; row i of the texts is ``data[bounds[i]:bounds[i + 1]]``."""
        found, at, stop = [], int(bounds[0]), int(bounds[-1])
        while at < stop:
            end = min(stop, at + WINDOW)
            while end < stop:  # a window ends where no term can go on
                step = min(stop, end + 4096)
                free = np.flatnonzero(~self.is_term[data[end:step]])
                if len(free):
                    end += int(free[0])
                    break
                end = step
            part = data[at:end]
            inside = np.zeros(len(part) + 2, bool)
            inside[1:-1] = self.is_term[part]
            first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
            # texts lie side by side: a term also ends where its text does
            edges = bounds[(bounds > at) & (bounds < end)] - at
            edges = edges[inside[edges] & inside[edges + 1]]
            first[edges], last[edges - 1] = True, True
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            found.append((self._hashes(part, starts, ends), starts + at, ends + at))
            at = end
        if not found:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        hashes, starts, ends = (np.concatenate([f[i] for f in found]) for i in range(3))
        return hashes, starts, ends, np.searchsorted(bounds, starts, "right") - 1

    def equal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether each span of ``data``, lower-cased, equals its span of ``text``."""
        same = ends - starts == stops - begins
        rest, at = np.flatnonzero(same), 0
        while len(rest):
            rest = rest[starts[rest] + at < ends[rest]]
            good = self.lower[data[starts[rest] + at]] == text[begins[rest] + at]
            same[rest[~good]] = False
            rest, at = rest[good], at + 1
        return same


class Items:
    """The terms of a block of items: distinct ones with their hashes and bytes, and (item, term) pairs in order of item."""

    def __init__(self, terms: list[list[bytes]]) -> None:
        reader = Reader()
        known = sorted({t for own in terms for t in own}, key=lambda t: (reader.hash(t), t))
        number = {t: i for i, t in enumerate(known)}
        self.count = len(terms)
        self.hashes = np.array([reader.hash(t) for t in known], np.uint64)
        self.text = np.frombuffer(b"".join(known), np.uint8)
        self.edges = np.cumsum([0, *map(len, known)])
        self.item = np.repeat(np.arange(len(terms)), [len(own) for own in terms])
        self.term = np.array([number[t] for own in terms for t in own], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def named(self, reader: Reader, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the spans that are terms of an item, which); equal hashes of different terms are told apart."""
        places = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        first = np.searchsorted(self.hashes, hashes[places])
        out = []
        shift = 0
        while len(places):
            term = np.minimum(first + shift, len(self.hashes) - 1)
            hit = (first + shift < len(self.hashes)) & (self.hashes[term] == hashes[places])
            places, first, term = places[hit], first[hit], term[hit]
            same = reader.equal(data, starts[places], ends[places], self.text, self.edges[term], self.edges[term + 1])
            out.append((places[same], term[same]))
            places, first, shift = places[~same], first[~same], shift + 1
        return tuple(np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in range(2))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, bounds) of a few rows at a time; NULL texts count as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
        _, offsets, held = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(bounds, bounds[at] + WINDOW, "right")) - 1
            end = min(max(end, at + 1), at + ROWS, len(texts))
            yield batch.column(0).slice(at, end - at), data, bounds[at : end + 1]
            at = end


def counted(docs: DataFrame, read_items) -> DataFrame:
    """(term, n): the documents that hold each of the items' terms; under -1 those with any term, under -2 all terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, reader = read_items(), Reader()
        df, some, every = np.zeros(len(items.hashes), np.int64), 0, 0
        for ids, data, bounds in _texts(batches):
            hashes, starts, ends, rows = reader.spans(data, bounds)
            some, every = some + int((np.bincount(rows, minlength=len(ids)) > 0).sum()), every + len(rows)
            places, term = items.named(reader, data, hashes, starts, ends)
            pairs = np.sort(rows[places] * len(df) + term)
            df += np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % len(df), minlength=len(df))
        terms, found = np.arange(-2, len(df)), np.concatenate([[every, some], df])
        yield pa.RecordBatch.from_arrays([pa.array(terms[found > 0]), pa.array(found[found > 0])], names=["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, words: int) -> np.ndarray:
    """A term's impact where it occurs ``tf`` times among ``length`` terms."""
    if 90 * int(length.max(initial=0)) * documents < 1 << 62:
        m = 10 + 90 * length * documents // words
    else:
        m = 10 + np.array([90 * int(n) * documents // words for n in length], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Slice:
    """A few documents: their terms sorted by row and hash, and their sketches grouped by width."""

    def __init__(self, reader: Reader, data: np.ndarray, bounds: np.ndarray, documents: int, words: int) -> None:
        self.reader, self.data, self.documents, self.words = reader, data, documents, words
        hashes, starts, ends, rows = reader.spans(data, bounds)
        self.length = np.bincount(rows, minlength=len(bounds) - 1)
        keys = (rows.astype(np.uint64) << np.uint64(_BITS)) | (hashes >> _LOW)
        order = np.argsort(keys)
        keys, self.starts, self.ends = keys[order], starts[order], ends[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.first = np.append(np.flatnonzero(new), len(keys))
        self.keys = keys[self.first[:-1]]
        self.rows = (self.keys >> np.uint64(_BITS)).astype(np.int64)
        self.impact = impacts(np.diff(self.first), self.length[self.rows], documents, words)

    def bounds(self, items: Items, weights: np.ndarray) -> np.ndarray:
        """An upper bound of each document's score for each item."""
        out = np.zeros((len(self.length), items.count), np.int64)
        distinct = np.bincount(self.rows, minlength=len(self.length))
        bits = np.ceil(np.log2(np.maximum(distinct * CELLS, 64))).astype(np.int64)
        begins = np.flatnonzero(np.diff(items.item, prepend=-1))
        step = max(1, LOOKUP // max(1, len(items.term)))
        weight = weights[items.term]
        for size in np.unique(bits[distinct > 0]).tolist():
            chosen = np.flatnonzero((bits == size) & (distinct > 0))
            step_ = min(step, max(1, LOOKUP >> size))
            for at in range(0, len(chosen), step_):
                own = chosen[at : at + step_]
                place = np.full(len(self.length), -1)
                place[own] = np.arange(len(own))
                sketch = np.zeros((len(own), 1 << size), np.int32)
                low, high = np.searchsorted(self.rows, [own[0], own[-1] + 1])
                line = place[self.rows[low:high]]
                mine = np.flatnonzero(line >= 0)
                for factor in _PLACES:
                    np.maximum.at(sketch, (line[mine], _cell(self.keys[low:high][mine], factor, size)), self.impact[low:high][mine].astype(np.int32))
                held = np.minimum(*(sketch[:, _cell(items.hashes >> _LOW, factor, size)] for factor in _PLACES))
                out[own[:, None], items.item[begins]] = np.add.reduceat(held[:, items.term] * weight, begins, axis=1)
        return out

    def scores(self, rows: np.ndarray, items: Items, weights: np.ndarray, item: int) -> np.ndarray:
        """The exact scores of some documents for one item."""
        low, high = np.searchsorted(items.item, [item, item + 1])
        terms = items.term[low:high]
        wanted = (rows.astype(np.uint64)[:, None] << np.uint64(_BITS)) | (items.hashes[terms] >> _LOW)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        line, column = np.nonzero(self.keys[place] == wanted)
        place = place[line, column]
        # every occurrence is compared: a hash alone does not make two terms one
        many = self.first[place + 1] - self.first[place]
        pair = np.repeat(np.arange(len(place)), many)
        spot = self.first[place][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        term = terms[column][pair]
        same = self.reader.equal(self.data, self.starts[spot], self.ends[spot], items.text, items.edges[term], items.edges[term + 1])
        tf = np.bincount(pair[same], minlength=len(place))
        worth = impacts(tf, self.length[rows[line]], self.documents, self.words) * weights[terms[column]]
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, line, worth)
        return out


def _cell(hashes: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
    return ((hashes & np.uint64((1 << _BITS) - 1)) * factor >> np.uint64(64 - bits)).astype(np.int64)


class Best:
    """The k best documents of each item so far; ``least`` is what a document's score must reach."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items
        self.least = np.ones(items, np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        good = scores > 0
        scores, ids, missing = (np.concatenate([old, new[good]]) for old, new in zip(self.held[item], (scores, ids, missing), strict=True))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.held[item] = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.least[item] = scores[order[-1]]


def _search(part: Slice, ids: np.ndarray, missing: np.ndarray, items: Items, weights: np.ndarray, best: Best) -> None:
    """Score the documents whose bounds reach an item's k-th best, the highest bounds first."""
    bounds = part.bounds(items, weights)
    for item in np.flatnonzero(bounds.max(axis=0, initial=0) >= best.least).tolist():
        rows = np.flatnonzero(bounds[:, item] >= best.least[item])
        rows = rows[np.argsort(-bounds[rows, item], kind="stable")]
        at, step = 0, best.k
        while at < len(rows) and bounds[rows[at], item] >= best.least[item]:
            some = rows[at : at + step]
            best.add(item, part.scores(some, items, weights, item), ids[some], missing[some])
            at, step = at + step, 2 * step


def _winners(docs: DataFrame, read_items, weights: list[int], documents: int, words: int, k: int) -> DataFrame:
    """(item, doc, score): each task's k best documents of each item; doc is NULL where the id is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, reader, weight = read_items(), Reader(), np.array(weights, np.int64)
        best = Best(items.count, k)
        for ids, data, bounds in _texts(batches):
            part = Slice(reader, data, bounds, documents, words)
            if len(part.keys):
                _search(part, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), items, weight, best)
        for item, (scores, ids, missing) in enumerate(best.held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=missing), pa.array(scores)], names=["item", "doc", "score"])

    return docs.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        # the driver sees one bounded block of items at a time
        own: dict[int | None, dict[bytes, None]] = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").toLocalIterator():
            own.setdefault(row.item_id, {}).update(dict.fromkeys(terms_of(row.text)))
        own = {item: terms for item, terms in own.items() if terms}
        if not own:
            continue
        read_items = broadcast(spark, Items([list(terms) for terms in own.values()]))
        counts = {row.term: row.n for row in counted(given, read_items).collect()}
        documents, words = counts.get(-1, 0), counts.get(-2, 0)
        if not documents:
            break
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(read_items().hashes))]
        names = spark.createDataFrame(list(enumerate(own)), "item long, item_id long")
        winners = _winners(given, read_items, weights, documents, words, k)
        found = found.union(winners.join(F.broadcast(names), "item").select("item_id", F.col("doc").alias("doc_id"), "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
