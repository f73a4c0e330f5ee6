"""Packing of token pieces into sequences by linear grouping.

Only the number of pieces of each length reaches the driver: a table of at most ``capacity``
rows, however many documents there are. On it the plan is made:

1. large lengths (over a sixteenth of the capacity) are sorted and dealt into groups of
   equal cardinality; within a group every length counts as the group's largest;
2. the few sizes left make configurations, and a linear program by column generation finds
   how often to use each; the counts are rounded down;
3. actual lengths take the places of their group, largest first, as runs of equal lengths;
4. all other pieces, small ones and the rest of the rounding, go by best fit in descending
   order into the room left, or open new sequences.

The plan lists for each length which sequences and offsets its 1st, 2nd, ... piece takes,
in runs; its size depends on the capacity, not on the data. Pieces are numbered within
their length by counting in parts (no task sees a whole length) and look their place up.

NULL or empty text is one piece of one token, the closing id. A document of more than
``capacity`` tokens is cut into full pieces, the first of which may be shorter; no other
document is cut. Repeated rows are packed as often as they occur. An empty table gives no row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm import chars, pretokens
from textscore.llm.bpe import Ragged
from textscore.llm.common import broadcast, slices, worker_cache
from textscore.session import store

CAPACITY = 2048
#: Distinct pre-tokens a worker remembers.
MEMO = 400_000
#: Groups of large lengths.
GROUPS = 48


# ---- tokens ----------------------------------------------------------------


def vocabulary(path: str) -> dict[bytes, int]:
    """Rank of each token of a byte-level BPE file of the ``tokenizers`` library.

    Checks that merge number k makes the token with the k-th id after the single bytes:
    then merging by rank gives the ids that the library gives.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    written = {chr(b): b for b in plain}
    written |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    raw = lambda token: bytes(written[c] for c in token)
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in written for c in t)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [ids[raw(a + b)] for a, b in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return {t: i for t, i in ids.items() if i < 256 + len(merges)}


class Encoder:
    """Token ids of texts; every distinct pre-token is encoded once and remembered."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        # the pattern is never used: pieces are pre-tokens already
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.alphabet = chars.Alphabet()
        self._start()

    def _start(self) -> None:
        self.memo, self.ids = chars.Memo(MEMO), Ragged(np.int32)

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) in order; a very long text gives several in a row."""
        for rows, parts in chars.chunks(texts):
            if self.memo.full():
                self._start()
            points, kinds, ends = self.alphabet.read(parts)
            starts, stops = pretokens.split(points, kinds)
            numbers, new = self.memo.numbers(self.alphabet.hashes(points, starts, stops))
            if len(new):
                self.ids.extend([self.core._encode_single_piece(x) for x in pretokens.strings(points, starts[new], stops[new])])
            ids, id_ends = self.ids.take(numbers)
            borders = np.concatenate([[0], id_ends])[np.cumsum(chars.counts_per_part(starts, ends))]
            yield from zip(rows, np.split(ids, borders[:-1]), strict=True)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32 [, ids]): every document's ids and the closing id, cut where too long."""
    ranks = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache("packing", path, lambda: Encoder(shared.value))
        for batch in slices(batches):
            whole: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for row, ids in encoder.encode(batch.column(1).to_pylist()):
                whole[row].append(ids)
            out: list[tuple] = []
            for row, parts in enumerate(whole):
                ids = np.concatenate([*parts, [closing]]).astype("<u4")
                borders = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    own = ids[a:b]
                    out.append((row, number, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            rows, *columns, own = zip(*out, strict=True) if out else ([],) * 6
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(list(own), pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


# ---- plan ------------------------------------------------------------------


@dataclass
class Kind:
    """``count`` sequences with the same lengths in them: (length, how many) in order."""

    count: int
    slots: list[tuple[int, int]] = field(default_factory=list)
    room: int = 0


def group_lengths(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs, descending, dealt into ``groups`` groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    out: list[list[tuple[int, int]]] = []
    filled = 0
    for length, n in sorted(lengths, reverse=True):
        while n:
            if len(out) < 1 or filled >= round(total * len(out) / groups):
                out.append([])
            border = max(filled + 1, round(total * len(out) / groups))
            take = min(n, border - filled)
            out[-1].append((length, take))
            filled, n = filled + take, n - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, tolerance: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how often to use it): the cutting-stock program by column generation.

    Starts from one configuration a size; a knapsack over the dual prices finds the
    configuration that improves most, until none does.
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ np.array(demand, float)
    for _ in range(60 * n):
        prices = np.ones(n) @ inverse
        worth = np.zeros(capacity + 1)
        chosen = np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            if prices[i] <= 1e-12:
                continue
            for at in range(size, capacity + 1, size):
                # another piece of this size on top of what fits below it
                stop = min(at + size, capacity + 1)
                better = worth[at - size : stop - size] + prices[i]
                take = better > worth[at:stop] + 1e-12
                worth[at:stop][take] = better[take]
                chosen[at:stop][take] = i
        # a larger room is worth at least what a smaller one is
        at = int(worth.argmax())
        if worth[at] <= 1 + tolerance:
            break
        column = np.zeros(n)
        while at > 0 and chosen[at] >= 0:
            column[chosen[at]] += 1
            at -= sizes[chosen[at]]
        step = inverse @ column
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratios.argmin())
        if not np.isfinite(ratios[leaves]):
            break
        moved = ratios[leaves]
        used = used - moved * step
        used[leaves] = moved
        basis[:, leaves] = column
        inverse[leaves] /= step[leaves]
        others = np.arange(n) != leaves
        inverse[others] -= np.outer(step[others], inverse[leaves])
    return [(basis[:, i], max(0.0, used[i])) for i in range(n)]


def substitute(groups: list[list[tuple[int, int]]], chosen: list[tuple[np.ndarray, float]], capacity: int) -> tuple[list[Kind], dict[int, int]]:
    """Sequences with actual lengths in the configurations' places, and {length: count} of what is left.

    Each place takes the longest piece left in its group; the configuration's last, smallest
    place takes the longest piece of all that fits, so that little of the rounding is lost.
    Sequences that take the same lengths are of one kind.
    """
    held = np.zeros(capacity + 1, np.int64)
    for group in groups:
        for length, n in group:
            held[length] += n
    spans = [(g[-1][0], g[0][0]) for g in groups]
    kinds = []
    for config, often in sorted(chosen, key=lambda c: -c[1]):
        todo = int(often + 1e-6)
        places = [spans[g] for g, n in enumerate(config) for _ in range(round(n))]
        if places:
            places[-1] = (1, capacity)
        while todo and places:
            slots: dict[int, int] = {}
            room = capacity
            for low, high in places:
                high = min(high, room)
                open_ = np.flatnonzero(held[low : high + 1]) + low
                while len(open_) and slots.get(int(open_[-1]), 0) >= held[open_[-1]]:
                    open_ = open_[:-1]
                if not len(open_):
                    break
                length = int(open_[-1])
                slots[length] = slots.get(length, 0) + 1
                room -= length
            if not slots:
                break
            run = min([todo, *(int(held[k]) // n for k, n in slots.items())])
            for k, n in slots.items():
                held[k] -= run * n
            kinds.append(Kind(run, list(slots.items()), room))
            todo -= run
    return kinds, {int(k): int(held[k]) for k in np.flatnonzero(held)}


def best_fit(kinds: list[Kind], rest: dict[int, int], capacity: int) -> list[Kind]:
    """``kinds`` with the rest put in: longest first, each into the fullest sequence that has room."""
    by_room: list[list[Kind]] = [[] for _ in range(capacity + 1)]
    for kind in kinds:
        by_room[kind.room].append(kind)
    rooms = np.array([bool(x) for x in by_room])
    for length, n in sorted(rest.items(), reverse=True):
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                kind = by_room[room].pop()
                rooms[room] = bool(by_room[room])
                if kind.count > n:
                    by_room[room].append(Kind(kind.count - n, list(kind.slots), room))
                    rooms[room] = True
                    kind.count = n
            else:
                each = min(n, capacity // length)
                # as many as fill up; the last one takes what remains
                kind = Kind(max(1, n // each), [], capacity)
                kind.slots, kind.room = [(length, each)], capacity - each * length
                n -= each * kind.count
                by_room[kind.room].append(kind)
                rooms[kind.room] = True
                continue
            n -= kind.count
            kind.slots = [*kind.slots, (length, 1)] if not kind.slots or kind.slots[-1][0] != length else [*kind.slots[:-1], (length, kind.slots[-1][1] + 1)]
            kind.room -= length
            by_room[kind.room].append(kind)
            rooms[kind.room] = True
    return [kind for own in by_room for kind in own]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Kind]:
    """Sequences for ``histogram`` ({length: pieces}); every piece has its place."""
    large = [(k, n) for k, n in histogram.items() if capacity // 16 < k < capacity]
    kinds = [Kind(histogram[capacity], [(capacity, 1)], 0)] if histogram.get(capacity) else []
    rest = {k: n for k, n in histogram.items() if k <= capacity // 16}
    if large:
        dealt = group_lengths(large, min(groups, sum(n for _, n in large)))
        sizes, demand = [g[0][0] for g in dealt], [sum(n for _, n in g) for g in dealt]
        placed, left = substitute(dealt, configurations(sizes, demand, capacity), capacity)
        kinds += placed
        for k, n in left.items():
            rest[k] = rest.get(k, 0) + n
    return best_fit(kinds, {k: n for k, n in rest.items() if n}, capacity)


@dataclass
class Places:
    """The plan by length: the pieces numbered ``first`` and up go to ``sequence`` and up, ``each`` a sequence, from ``offset`` on."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @staticmethod
    def of(kinds: list[Kind]) -> Places:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        number = 0
        for kind in kinds:
            at = 0
            for length, each in kind.slots:
                own = rows.setdefault(length, [])
                own.append((own[-1][4] if own else 0, number, each, at, (own[-1][4] if own else 0) + each * kind.count))
                at += length * each
            number += kind.count
        columns = ({k: np.array([r[i] for r in v], np.int64) for k, v in rows.items()} for i in range(4))
        return Places(*columns)

    def look_up(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of one length with these numbers."""
        run = np.searchsorted(self.first[length], numbers, side="right") - 1
        within = numbers - self.first[length][run]
        each = self.each[length][run]
        return self.sequence[length][run] + within // each, self.offset[length][run] + within % each * length


# ---- on Spark --------------------------------------------------------------


def numbered(rows: DataFrame, length: str, key: list[str], counts: dict[int, int]) -> DataFrame:
    """``rows`` with ``_number``: 0, 1, ... within each length.

    Rows are dealt into parts by the hash of their key, numbered within (length, part), and
    moved up by what the earlier parts of the length hold. The number of parts grows with the rows.
    """
    total = sum(counts.values())
    parts = max(16, min(total // 1000, 512), total // 1_000_000)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    before = (
        dealt.groupBy(length, "_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(length).orderBy("_part")) - F.col("_n"))
        .select(F.col(length).alias("_length"), F.col("_part").alias("_of"), "_before")
    )
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(length, "_part").orderBy(*key)) - 1)
    joined = own.join(before, (F.col(length) == F.col("_length")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_number", F.col("_own") + F.col("_before")).drop("_part", "_own", "_length", "_of", "_before")


def pack(rows: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with sequence_id and offset, packed into sequences of at most ``capacity``.

    ``rows`` must read the same twice (a stored table): counted first, placed after. Lengths
    from 1 to ``capacity`` are allowed; others raise. ``key`` orders equal lengths.
    """
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(length).count().collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    read = broadcast(rows.sparkSession, Places.of(plan(counts, capacity)))
    schema = rows.schema

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = read()
        for batch in batches:
            lengths, numbers = batch.column(length).to_numpy(zero_copy_only=False), batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for one in np.unique(lengths).tolist():
                at = lengths == one
                sequence[at], offset[at] = places.look_up(one, numbers[at])
            columns = [*(batch.column(f.name) for f in schema), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    out = StructType([*schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return numbered(rows, length, key, counts).select(*schema.names, "_number").mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every document's pieces."""
    stored = store(pieces(docs, path, key, text, capacity), "pieces")
    return pack(stored, [key, "piece", "start", "ids_crc32"], "length", capacity)
