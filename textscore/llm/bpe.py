"""Byte-level BPE by a two-tier lookup.

Pre-tokens are found with array operations (``pretokens``); each distinct one is encoded
once per worker and remembered in a bounded memo. A pre-token that is itself a token is
resolved by a minimal perfect hash over the vocabulary; any other goes through a heap of
adjacent pairs over a linked list of its bytes.

NULL text counts as empty; an empty text has no ids and decodes to no bytes. Texts of any
length are worked on in chunks. Repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm import chars, pretokens
from textscore.llm.common import broadcast, slices, worker_cache

#: Distinct pre-tokens a worker remembers.
MEMO = 600_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n places, by hash and displace.

    Keys fall into buckets; the fullest bucket first, each bucket takes the smallest
    displacement that sends all its keys to free places. A bucket of one key names its
    place directly. ``find`` is right for keys of the set and arbitrary for others, so
    the caller compares the key found there.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        self.seed = 0
        while not self._build(keys):
            self.seed += 1

    def _build(self, keys: list[bytes]) -> bool:
        hashes = self._hashes(keys)
        homes = hashes[:, 0] % self.buckets
        order = np.argsort(homes, kind="stable")
        sizes = np.bincount(homes, minlength=self.buckets)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        self.shift, self.key_at = np.zeros(self.buckets, np.int64), np.zeros(self.n, np.int64)
        free = np.ones(self.n, bool)
        step = 64
        for bucket in np.argsort(-sizes, kind="stable").tolist():
            own = order[borders[bucket] : borders[bucket + 1]]
            if len(own) < 2:
                break
            a, b = hashes[own, 1], hashes[own, 2]
            for first in range(0, self.n + step, step):
                places = (a + np.arange(first, first + step)[:, None] * b) % self.n
                fits = free[places].all(axis=1)
                good = next((i for i in np.flatnonzero(fits).tolist() if len(set(places[i].tolist())) == len(own)), None)
                if good is not None:
                    break
            else:
                return False
            free[places[good]] = False
            self.shift[bucket] = first + good
            self.key_at[places[good]] = own
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)[: len(single)]
        self.shift[single] = -1 - left
        self.key_at[left] = order[borders[single]]
        return True

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        """Three 31-bit hashes a key."""
        whole = [xxhash.xxh3_128_digest(k, self.seed) for k in keys]
        return (np.frombuffer(b"".join(whole), np.uint32).reshape(-1, 4)[:, :3] & 0x7FFFFFFF).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key, the number of the one key of the set that it may be."""
        h = self._hashes(keys)
        shift = self.shift[h[:, 0] % self.buckets]
        return self.key_at[np.where(shift < 0, -1 - shift, (h[:, 1] + shift * h[:, 2]) % self.n)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the lowest-ranked adjacent pair is merged first, then the leftmost.

    A linked list holds the parts' borders; the heap holds candidate pairs, and pairs that
    an earlier merge has changed are recognised by their borders when they come up.
    """
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n))  # where the part that ends here begins
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if after[a] != b or b >= n or after[b] != c:
            continue
        after[a], after[b], before[c] = c, -1, a
        if c < n:
            rank = ranks.get(piece[a : after[c]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, c, after[c]))
        if a:
            left = before[a]
            rank = ranks.get(piece[left:c])
            if rank is not None:
                heapq.heappush(heap, (rank, left, a, c))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Ragged:
    """Many short arrays in one flat array; grows at the end."""

    def __init__(self, dtype: type) -> None:
        self.flat, self.at, self.length = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = self.rows = 0

    def extend(self, rows: list) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(rows) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.flat[self.used : self.used + total] = [x for row in rows for x in row]
        self.length[self.rows : self.rows + len(rows)] = lengths
        self.at[self.rows : self.rows + len(rows)] = self.used + np.cumsum(lengths) - lengths
        self.used, self.rows = self.used + total, self.rows + len(rows)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the chosen rows one after the other, where each ends)."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[rows] - ends + lengths, lengths) + np.arange(total)], ends


class Codec:
    """Encodes texts to ids and ids to bytes for one vocabulary."""

    def __init__(self, tokens: list[bytes], hashed: PerfectHash, memo: int = MEMO) -> None:
        self.tokens, self.hashed, self.limit = tokens, hashed, memo
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.alphabet = chars.Alphabet()
        self.bytes_of, self.digits_of = Ragged(np.uint8), Ragged(np.uint8)
        self.bytes_of.extend(tokens)
        self.digits_of.extend([b"%d," % i for i in range(len(tokens))])
        self._start()

    def _start(self) -> None:
        self.memo, self.ids = chars.Memo(self.limit), Ragged(np.int32)

    def _learn(self, pieces: list[bytes]) -> None:
        found = self.hashed.find(pieces).tolist()
        tokens, ranks = self.tokens, self.ranks
        self.ids.extend([[i] if tokens[i] == p else merge(p, ranks) for p, i in zip(pieces, found, strict=True)])

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) in order; a very long text gives several in a row."""
        for rows, parts in chars.chunks(texts):
            if self.memo.full():
                self._start()
            points, kinds, ends = self.alphabet.read(parts)
            starts, stops = pretokens.split(points, kinds)
            numbers, new = self.memo.numbers(self.alphabet.hashes(points, starts, stops))
            if len(new):
                self._learn([x.encode() for x in pretokens.strings(points, starts[new], stops[new])])
            ids, id_ends = self.ids.take(numbers)
            borders = np.concatenate([[0], id_ends])[np.cumsum(chars.counts_per_part(starts, ends))]
            yield from zip(rows, np.split(ids, borders[:-1]), strict=True)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.take(ids)[0].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        return self.digits_of.take(ids)[0].tobytes()


class Vocabulary:
    """Tokens and their perfect hash, built once by the driver and broadcast (bounded by the vocabulary)."""

    def __init__(self, df: DataFrame, path: str) -> None:
        tokens = read_ranks(path)
        self.key = path
        self.read = broadcast(df.sparkSession, (tokens, PerfectHash(tokens)))

    def codec(self) -> Codec:
        return worker_cache("bpe", self.key, lambda: Codec(*self.read()))


def _whole(pairs: Iterable[tuple[int, np.ndarray]], n: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    for row, ids in pairs:
        out[row].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row of ``df``."""
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in slices(batches):
            ids = _whole(codec.encode(batch.column(1).to_pylist()), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary): the bytes that the ids stand for; NULL ids count as none."""
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in slices(batches):
            out = [codec.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "bytes"])

    source = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded, digests only.

    One pass for both directions; ids and bytes of a text never leave the worker.
    """
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in slices(batches):
            n = batch.num_rows
            counts, last = [0] * n, [b""] * n
            listed, decoded = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for row, ids in codec.encode(batch.column(1).to_pylist()):
                if len(ids):
                    digits = codec.decimals(ids)
                    listed[row].update(last[row])
                    listed[row].update(memoryview(digits)[:-1])
                    last[row] = b","
                    decoded[row].update(codec.decode(ids))
                    counts[row] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in listed]), pa.array([x.hexdigest() for x in decoded])],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
