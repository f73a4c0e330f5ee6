"""Near-duplicate documents by BagMinHash signatures, banding and an exact check.

A document is the multiset of its five-word shingles (words: runs of letters and digits, in
lower case; a shorter document is one shingle of all its words). Two documents are linked
where the weighted Jaccard similarity of the multisets, sum of minima over sum of maxima, is
``threshold`` or more; a class is what links connect, and its smallest doc_id stays.

Signatures: each shingle drives Poisson processes over the levels of its weight (how often it
occurs). The levels are split into blocks [0,1), [1,2), [2,4), [4,8), ...; a block's process
has the block's width as its rate, and each of its points has a time, a signature place and
a level in the block, halved bit by bit. Points above the weight are dropped, and every place
keeps its earliest point, so two signatures agree in a place with the probability of the
weighted Jaccard similarity. Points later than any that can still win are never made.

Candidates: documents with equal word sequences fold into one first. The others meet in
buckets by bands of the signature. Each bucket chooses a centre by a hash, and its members are
checked against the centre, exactly, on the texts: as many pairs as members, and most of what belongs
together meets. The members of buckets that still hold several classes are compared in blocks: first
by signatures, to find who has a candidate in another class at all, then those by their
texts. A task unites classes as it finds links and returns only links that united two, so no pair of
members of one class is listed, and no list grows with the product of two classes' sizes.
A pair that shares several buckets is compared in the one of its first band.

NULL and empty texts, and texts without a word, are linked with nothing. Rows with a NULL
doc_id are linked with nothing and stay. Rows with one doc_id are one document; of several
texts under one that hold a word, the one with the smallest digest counts throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm import chars
from textscore.llm.common import SLICE, free_worker, slices
from textscore.llm.components import components
from textscore.operators.joins import fits
from textscore.session import store

SHINGLE = 5
BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Documents, and bytes of their texts, of one block; two blocks of a bucket meet in a task.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Signatures, and pairs of them, compared at once.
TILE, PAIRS = 64, 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(texts: Iterable[str | None], n: int, alphabet: chars.Alphabet) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for rows, parts in chars.chunks(texts):
        points, kinds, ends = alphabet.read(parts)
        starts, stops = chars.runs(kinds, (chars.LETTER, chars.DIGIT))
        hashes = alphabet.hashes(alphabet.lower[points], starts, stops)
        for row, own in zip(rows, np.split(hashes, np.cumsum(chars.counts_per_part(starts, ends))[:-1]), strict=True):
            found[row].append(own)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint64), *x]) for x in found]


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, how often each occurs)."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(SHINGLE, len(words))
    line = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        line += words[i : len(words) - size + 1 + i] * _FACTORS[i]
    return np.unique(chars.mix(line), return_counts=True)


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if one is empty."""
    total = int(one[1].sum() + two[1].sum())
    places = np.searchsorted(two[0], one[0])
    places[places == len(two[0])] = 0
    if not len(one[0]) or not len(two[0]):
        return 0.0
    shared = int(np.minimum(one[1], two[1][places])[two[0][places] == one[0]].sum())
    return shared / (total - shared)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """One row of ``places`` 32-bit values per multiset (zeros for an empty one)."""
    out = np.zeros((len(bags), places), np.uint32)
    open_ = np.array([i for i, b in enumerate(bags) if len(b[0])], np.int64)
    factor = np.log(places) + 3
    while len(open_):
        hashes, weights = np.concatenate([bags[i][0] for i in open_]), np.concatenate([bags[i][1] for i in open_])
        doc = np.repeat(np.arange(len(open_)), [len(bags[i][0]) for i in open_])
        latest = places * factor / np.bincount(doc, weights, len(open_))
        # one process for each block that the weight reaches into
        blocks = 1 + np.ceil(np.log2(weights)).astype(np.int64)
        of = np.repeat(np.arange(len(doc)), blocks)
        block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        base = np.where(block, 1 << np.maximum(block - 1, 0), 0)
        width = np.maximum(base, 1)
        doc, room, limit = doc[of], weights[of] - base, latest[doc[of]]
        state = chars.mix(hashes[of] + block.astype(np.uint64) * _STEP)
        time = np.zeros(len(of))
        first = np.full(len(open_) * places, np.inf)
        while len(state):
            state = chars.mix(state + _STEP)
            time = time - np.log1p((state >> np.uint64(11)) * -(2.0**-53)) / width
            on = time < limit
            if not on.all():
                state, time, doc, room, width, limit = state[on], time[on], doc[on], room[on], width[on], limit[on]
            draw = chars.mix(state ^ _FACTORS[1])
            level = (draw >> np.uint64(32)).astype(np.int64) & (width - 1)
            good = level < room
            place = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) * places >> 32
            np.minimum.at(first, doc[good] * places + place[good], time[good])
        first = first.reshape(-1, places)
        full = np.isfinite(first).all(axis=1)
        out[open_[full]] = (chars.mix(first[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        open_, factor = open_[~full], factor * 2
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(id, mark, one, two, signature) of the documents (id, mark, text) that hold a word; one and two digest the word sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        alphabet = chars.Alphabet()
        for batch in slices(batches, SLICE // 2):
            words = word_hashes(batch.column(2).to_pylist(), batch.num_rows, alphabet)
            kept = [i for i, w in enumerate(words) if len(w)]
            found = signatures([shingles(words[i]) for i in kept])
            digests = []
            for i in kept:
                place = np.arange(1, len(words[i]) + 1, dtype=np.uint64)
                digests.append([int(chars.mix(chars.mix(words[i] + place * f) * f).sum(dtype=np.uint64).astype(np.int64)) for f in _FACTORS[:2]])
            chosen = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=["id", "mark", "one", "two", "signature"],
            )

    return docs.mapInArrow(run, "id long, mark binary, one long, two long, signature binary")


def bands(signed: DataFrame) -> DataFrame:
    """(bucket, band, id): one row per document and band."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.arange(BANDS, dtype=np.uint64)[None, :] * _STEP + np.zeros((len(found), 1), np.uint64)
            for i in range(ROWS):
                keys = chars.mix(keys ^ (found[:, :, i] * _FACTORS[i]))
            numbers = np.tile(np.arange(BANDS, dtype=np.int32), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(numbers), batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), BANDS)))], names=["bucket", "band", "id"])

    return signed.select("id", "signature").mapInArrow(run, "bucket long, band int, id long")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose texts' similarity reaches ``threshold``; both texts meet by joins on their id."""
    texts = docs.select("id", "text")

    @F.arrow_udf("double")
    def similarity(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        free_worker()
        alphabet = chars.Alphabet()
        for ones, twos in columns:
            out = []
            for at in range(0, len(ones), SLICE):
                left, right = ones.slice(at, SLICE).to_pylist(), twos.slice(at, SLICE).to_pylist()
                known = list(dict.fromkeys([*left, *right]))
                bags = dict(zip(known, map(shingles, word_hashes(known, len(known), alphabet)), strict=True))
                out += [overlap(bags[x], bags[y]) for x, y in zip(left, right, strict=True)]
            yield pa.array(out, pa.float64())

    with_one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.where(similarity("text_a", "text_b") >= threshold).select("a", "b")


def _named(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """``crowded`` with each document's class, the document itself where it has none."""
    return crowded.join(classes.withColumnRenamed("node", "id"), "id", "left").select(*crowded.columns, F.coalesce("component", "id").alias("class"))


def _to_centres(crowded: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket and the bucket's centre."""
    centres = crowded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("centre"))).alias("c"))
    met = crowded.join(centres.select("bucket", "c.centre"), "bucket").where("id != centre")
    return met.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()


def _blocks(crowded: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """(bucket, band, low, high, part, class, and the columns of ``held``): the members of mixed buckets, dealt to pairs of blocks."""
    size = F.octet_length("text") if "text" in held.columns else F.lit(0)
    named = _named(crowded.select("bucket", "band", "id"), classes).join(held.select("id", size.alias("size")), "id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts")
    mixed = named.groupBy("bucket", "band").agg(F.min("class").alias("_low"), F.max("class").alias("_high"), parts).where("_low < _high")
    members = named.drop("size").join(mixed.select("bucket", "band", "parts"), ["bucket", "band"])
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = spread.select("bucket", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "id")
    whole = keys.join(held, "id").select(*(c for c in keys.columns if c != "id"), *held.columns)
    return whole.repartition("bucket", "band", "low", "high").sortWithinPartitions("bucket", "band", "low", "high")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, band, low, high), which come one after the other; two blocks at a time are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _near(group: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) of members of different classes that agree in ``least`` places, the group's bucket being their first in common.

    Each pair once; where one class fills a block, each of its rows meets the few others.
    """
    low, high, part, classes = (group.column(n).to_numpy() for n in ("low", "high", "part", "class"))
    band = int(group.column("band")[0].as_py())
    signed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(part), -1)
    same, one, two = low[0] == high[0], np.flatnonzero(part == low[0]), np.flatnonzero(part == high[0])
    for class_ in np.unique(classes[one]).tolist():
        rows = one[classes[one] == class_]
        others = two[classes[two] > class_] if same else two[classes[two] != class_]
        for at in range(0, len(rows) if len(others) else 0, TILE):
            some = rows[at : at + TILE]
            step = max(1, PAIRS // len(some))
            for to in range(0, len(others), step):
                agree = signed[some][:, None] == signed[others[to : to + step]][None]
                left, right = np.nonzero(np.count_nonzero(agree, axis=2) >= least)
                if len(left):
                    first = agree[left, right].reshape(len(left), -1, ROWS).all(axis=2).argmax(axis=1) == band
                    yield some[left[first]], others[to + right[first]]


def _flagged(blocks: DataFrame, least: int) -> DataFrame:
    """(id): the members with a candidate in another class, by signatures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for group in _groups(batches):
            flags = np.zeros(group.num_rows, bool)
            for left, right in _near(group, least):
                flags[left] = flags[right] = True
            yield pa.RecordBatch.from_arrays([pa.array(group.column("id").to_numpy()[flags])], names=["id"])

    return blocks.mapInArrow(run, "id long").distinct()


def _uniting(blocks: DataFrame, least: int, threshold: float) -> DataFrame:
    """(a, b): links that unite classes, as many in each block as classes go together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        alphabet = chars.Alphabet()
        for group in _groups(batches):
            ids, classes, texts = group.column("id").to_numpy(), group.column("class").to_pylist(), group.column("text")
            parent: dict[int, int] = {}
            bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            def bag(row: int) -> tuple[np.ndarray, np.ndarray]:
                if row not in bags:
                    bags[row] = shingles(word_hashes([texts[row].as_py()], 1, alphabet)[0])
                return bags[row]

            links = []
            for left, right in _near(group, least):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    x, y = root(classes[i]), root(classes[j])
                    if x != y and overlap(bag(i), bag(j)) >= threshold:
                        parent[x] = y
                        links.append((int(ids[i]), int(ids[j])))
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _texts_of(given: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, text) of the chosen (id, mark), stored; these are broadcast if their counted size allows."""
    side = chosen.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    side = F.broadcast(side) if fits(side, 48) else side
    return store(given.join(side, (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi").select("id", "text").dropDuplicates(["id"]), "texts")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, component_id, kept): the class of every row of ``docs``, and whether it is the row that stays."""
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    given = given.where("id is not null and text is not null").select("id", F.unhex(F.md5("text")).alias("mark"), "text")
    signed = store(sign(given), "signatures")

    # one text per id; equal word sequences fold into the smallest id
    ids = store(signed.groupBy("id").agg(F.min(F.struct("mark", "one", "two")).alias("it")).select("id", "it.*"), "ids")
    first = store(ids.groupBy("one", "two").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    copies = store(ids.join(first, ["one", "two"], "left").select("id", "mark", F.coalesce("first", "id").alias("first")), "copies")
    alone = signed.select("id", "mark", "signature").join(copies.where("id = first").select("id", "mark"), ["id", "mark"], "left_semi")
    unique = store(alone.dropDuplicates(["id"]), "unique")

    # only documents that share a bucket go on
    banded = store(bands(unique), "bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = store(banded.join(shared.select("bucket"), "bucket"), "crowded")
    marked = store(unique.select("id", "mark").join(crowded.select("id").distinct(), "id", "left_semi"), "marked")
    texts = _texts_of(given, marked)

    links = store(verified(_to_centres(crowded), texts, threshold), "links")
    classes = store(components(links), "classes")

    # what is left is compared in blocks: signatures first, then the texts of those with a candidate
    least = int(PLACES * (threshold - 4 * np.sqrt(threshold * (1 - threshold) / PLACES)))
    signs = unique.select("id", "signature")
    flagged = store(_flagged(_blocks(crowded, classes, signs), least), "flagged")
    chosen = signs.join(flagged, "id", "left_semi").join(texts, "id")
    found = store(_uniting(_blocks(crowded, classes, chosen), least, threshold), "links")
    if not found.isEmpty():
        classes = store(components(links.union(found)), "classes")

    joined = copies.join(classes.withColumnRenamed("node", "first"), "first", "left").select(F.col("id").alias("_id"), F.coalesce("component", "first").alias("_class"))
    whole = docs.select(F.col(key)).join(joined, F.col(key).cast("long") == F.col("_id"), "left")
    component = F.coalesce(F.col("_class"), F.col(key).cast("long"))
    return whole.select(key, component.alias("component_id"), F.coalesce(component == F.col(key).cast("long"), F.lit(True)).alias("kept"))
