"""Token surprisal under a bigram model trained on a corpus.

Declared rule: tokens of the whole text (or its first ``max_tokens``), add-one
smoothing over V distinct corpus tokens, p(b|a) = (c(a,b) + 1) / (c(a,.) + V),
surprisal -ln p in nats; the first token of a text has no score.

Texts are scored in blocks. A block is stored as the codes of its tokens and the tokens themselves, compressed.
Its distinct bigrams, as pairs of 56-bit hashes that are checked to tell all tokens apart, meet those of the
other blocks in one shuffle, each first token once for its bigrams, and only what the other blocks add to a
count comes back, in the order in which the block dealt its bigrams.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import store

#: Most texts whose bigrams are counted together in a task.
TEXTS = 1024
#: Most slices of texts in a block.
SLICES = 64
#: Tokens of blocks whose bigrams a task counts together; they are dealt to 2^BUCKET_BITS buckets at most.
ROWS, BUCKET_BITS = 1 << 20, 12
#: Bytes that a token takes while its block is counted, and those of a block's tokens together.
TOKEN_BYTES, BLOCK_BYTES = 64, 128 * 1024 * 1024
#: Rounds in which the buckets are dealt, so that not all of them are on the disks at once.
ROUNDS = 2
#: The bigrams of a token that is more than one in so many tokens are dealt to several buckets.
SHARE = 1024


class _Bigrams:
    """The distinct bigrams of each of some token lists (or of all together), as codes into ``names``, and how often each occurs."""

    def __init__(self, lists: pa.ListArray, each: bool = True) -> None:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        width, text = len(self.names), np.repeat(np.arange(len(sizes)), sizes)
        inner = text[1:] == text[:-1]
        keys = codes[:-1][inner] * width + codes[1:][inner]
        if each:
            keys += text[:-1][inner] * (width * width)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        self.b, keys = keys % max(1, width), keys // max(1, width)
        self.a, self.text = keys % max(1, width), keys // max(1, width)
        self.without = np.setdiff1d(np.arange(len(sizes)), self.text)


def _mapped(df: DataFrame, columns: list[Column], schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                yield make(batch.slice(at, TEXTS))

    return df.select(*columns).mapInArrow(run, schema)


def _tokens(text: str, max_tokens: int | None) -> Column:
    toks = tokens(F.col(text))
    return (toks if max_tokens is None else F.slice(toks, 1, max_tokens)).alias("t")


def text_bigrams(df: DataFrame, id_col: str, text: str, max_tokens: int | None = None) -> DataFrame:
    """(id, a, b, n): how often each bigram occurs in each text; a text without one has a row of NULLs and n = 0."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _Bigrams(batch.column(1))
        rows = np.concatenate([found.text, found.without])
        none = np.zeros(len(rows), bool)
        none[len(found.text) :] = True
        pad = np.zeros(len(found.without), np.int64)
        sides = [found.names.take(pa.array(np.concatenate([x, pad]), mask=none)) for x in (found.a, found.b)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *sides, pa.array(np.concatenate([found.n, pad]))], names=[id_col, "a", "b", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    return _mapped(df, [F.col(id_col), _tokens(text, max_tokens)], f"`{id_col}` {kind}, a string, b string, n long", make)


def bigram_counts(df: DataFrame, text: str, max_tokens: int | None = None) -> DataFrame:
    """(a, b, n, texts) of every bigram of the corpus, and (a, NULL, n, 0) of every token with its n successors.

    Counted per slice of texts before the shuffle; ``texts`` is how many texts hold the bigram.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _Bigrams(batch.column(0))
        width = max(1, len(found.names))
        keys, place = np.unique(found.a * width + found.b, return_inverse=True)
        n = np.bincount(place, found.n, len(keys)).astype(np.int64)
        follow = np.bincount(found.a, found.n, len(found.names)).astype(np.int64)
        none = pa.nulls(len(found.names), pa.string())
        a, b = found.names.take(pa.array(keys // width)), found.names.take(pa.array(keys % width))
        columns = [
            pa.concat_arrays([a, found.names]),
            pa.concat_arrays([b, none]),
            pa.array(np.concatenate([n, follow])),
            pa.array(np.concatenate([np.bincount(place, minlength=len(keys)), np.zeros(len(found.names), np.int64)])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "texts"])

    slices = _mapped(df, [_tokens(text, max_tokens)], "a string, b string, n long, texts long", make)
    return slices.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


#: What a row of a block holds: a text, the first token of each of its bigrams, bigrams of a bucket, tokens of a bucket.
TEXT, FIRST, BIGRAM, CONTEXT = range(4)
BLOCK = ["block", "kind", "bucket", "__id", "places", "counts", "a", "b", "tokens"]


def _hashes(names: pa.Array, seed: int) -> np.ndarray:
    """A hash of each token, of 56 bits or, after a first try, of 64."""
    key = f"{seed:016d}"
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)
    return (hashes if seed else hashes >> np.uint64(8)).view(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on in few bytes: no wider than needed, first bytes, second bytes and so on together, compressed."""
    arrays = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
    head = np.array([len(arrays), *(v for x in arrays for v in (x.itemsize, len(x)))], np.int32)
    planes = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return head.tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`_pack`, of unsigned integers."""
    n = int(np.frombuffer(data, np.int32, 1)[0])
    shapes = np.frombuffer(data, np.int32, 2 * n, 4).reshape(n, 2).astype(np.int64)
    planes = pa.decompress(data[4 + 8 * n :], int(shapes.prod(axis=1).sum()), "zstd", asbytes=True)
    out, at = [], 0
    for width, length in shapes.tolist():
        part = np.frombuffer(planes, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(part.T).view(f"u{width}").ravel())
        at += width * length
    return out


def _letters(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Strings as their lengths and their bytes."""
    return pc.binary_length(names).to_numpy(zero_copy_only=False), np.frombuffer("".join(names.to_pylist()).encode(), np.uint8)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _names(lengths: np.ndarray, letters: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(_ends(lengths).astype(np.int32)), pa.py_buffer(letters))


def _block_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``TEXTS`` texts, of about ``most`` tokens or of one text."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        after = min(start + TEXTS, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, after - start)
        start = after


def _block_texts(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The texts of a block: slices put together up to ``most`` tokens."""
    held, size = [], 0
    for batch in batches:
        for part in _block_slices(batch, most):
            n = pc.sum(pc.list_value_length(part.column(1))).as_py() or 0
            if held and (size + n > most or len(held) == SLICES):
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _block(
    batch: pa.RecordBatch, seed: int, scored: bool, trains: bool, block: int = 0, buckets: int = 1 << BUCKET_BITS, parts: dict[str, int] | None = None
) -> Iterator[pa.RecordBatch]:
    """By bucket, a block's distinct bigrams (those of a first token together) and its tokens, with their places and, if
    it trains, how often each occurs or is followed; before them, if it is to be scored, each text's bigrams.

    Bigrams go by their first token; those of a token in ``parts`` to so many buckets, by the second.
    """
    found = _Bigrams(batch.column(1), scored)
    width = max(1, len(found.names))
    keys = found.a * width + found.b
    keys, place = np.unique(keys, return_inverse=True) if scored else (keys, np.arange(len(keys)))
    first, second = keys // width, keys % width
    hashes = _hashes(found.names, seed)

    def rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
        columns = {"block": pa.array(np.full(n, block)), "kind": pa.array(np.full(n, kind, np.int32)), **columns}
        types = [pa.int64(), pa.int32(), pa.int32(), batch.column(0).type, *[pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())]]
        return pa.RecordBatch.from_arrays([columns[x].cast(t) if x in columns else pa.nulls(n, t) for x, t in zip(BLOCK, types, strict=True)], names=BLOCK)

    if scored:
        ends = np.searchsorted(found.text, np.arange(batch.num_rows + 1))
        lists = {x: _lists(ends, pa.array(v, pa.int32())) for x, v in (("places", place), ("counts", found.n))}
        yield rows(TEXT, batch.num_rows, __id=batch.column(0), **lists)
        yield rows(FIRST, 1, places=_lists(np.array([0, len(first)]), pa.array(first, pa.int32())))
    spots, shares = hashes.view(np.uint64), np.ones(len(hashes), np.uint64)
    if parts:
        known = pc.index_in(found.names, pa.array(list(parts), pa.string()))
        shares = pc.fill_null(pa.array(list(parts.values()), pa.uint64()).take(known), 1).to_numpy()
    for kind, spot, n, values in (
        (BIGRAM, spots[first] + spots[second] % shares[first], np.bincount(place, found.n, len(keys)), {"a": hashes[first], "b": hashes[second]}),
        (CONTEXT, spots, np.bincount(found.a, found.n, len(found.names)), {"tokens": found.names}),
    ):
        bucket = (spot * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16) % np.uint16(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts, len(order))
        values = values | {"places": np.arange(len(order)), "counts": n if trains else np.zeros(len(n))}
        lists = {x: _lists(ends, v.take(pa.array(order)) if isinstance(v, pa.Array) else pa.array(v[order].astype(np.int64))) for x, v in values.items()}
        yield rows(kind, len(starts), bucket=pa.array(bucket[starts]), **lists)


def _blocks(df: DataFrame, id_col: str, text: str, max_tokens: int | None, most: int, scored: bool) -> DataFrame:
    """Texts in blocks, stored: their ids, and packed each text's size, the codes of its tokens and the block's distinct
    tokens; also which tokens are frequent in the block. Texts that are not to be scored are of block -1.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _block_texts(batches, most):
            sizes = pc.fill_null(pc.list_value_length(texts.column(1)), 0).to_numpy()
            coded = texts.column(1).flatten().dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary
            n = np.bincount(codes, minlength=len(names))
            often = np.flatnonzero(n * SHARE >= len(codes))
            columns = [
                pa.array([uuid.uuid4().int >> 65 if scored else -1], pa.int64()),
                _lists(np.array([0, texts.num_rows]), texts.column(0)),
                pa.array([_pack(sizes, codes, *_letters(names))], pa.binary()),
                pa.array([len(codes)], pa.int64()),
                _lists(np.array([0, len(often)]), names.take(pa.array(often))),
                _lists(np.array([0, len(often)]), pa.array(n[often], pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "data", "size", "often", "n"])

    schema = f"block long, ids array<{kind}>, data binary, size long, often array<string>, n array<long>"
    return store(df.select(F.col(id_col), _tokens(text, max_tokens)).mapInArrow(run, schema), "bigram-blocks")


def _texts(data: bytes, ids: pa.Array | None = None) -> pa.RecordBatch:
    """The ids and the tokens of a stored block's texts."""
    sizes, codes, *names = _unpack(data)
    coded = pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), _names(*names))
    return pa.RecordBatch.from_arrays([pa.nulls(len(sizes)) if ids is None else ids, _lists(_ends(sizes), coded)], names=["__id", "t"])


PACKED = ["block", "kind", "bucket", "data"]


def _packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of buckets, packed: of bigrams each run of one first token, the second tokens and the counts; of tokens the letters and the counts."""
    ends = rows["counts"].offsets.to_numpy()
    counts, out = rows["counts"].values.to_numpy(), []
    bigrams = len(rows) > 0 and rows["kind"][0].as_py() == BIGRAM
    if bigrams:
        a, b = (rows[x].values.to_numpy().view(np.uint64) for x in ("a", "b"))
    else:
        names = rows["tokens"].values
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if bigrams:
            starts = lo + np.flatnonzero(np.append(True, a[lo + 1 : hi] != a[lo : hi - 1]))
            held = (a[starts], np.diff(np.append(starts, hi)), b[lo:hi])
        else:
            held = _letters(names.slice(lo, hi - lo))
        out.append(_pack(counts[lo:hi], *held))
    return pa.RecordBatch.from_arrays([*[rows[x] for x in PACKED[:3]], pa.array(out, pa.binary())], names=PACKED)


def _unpacked(group: pa.Table, kind: int) -> pa.Table:
    """The rows of :func:`_packed` of one kind as they were, but for the places."""
    group = group.filter(pc.equal(group["kind"], kind)).combine_chunks()
    found = [_unpack(x) for x in group["data"].to_pylist()]
    ends = _ends([len(x[0]) for x in found])

    def whole(arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)

    columns = {"counts": whole([x[0] for x in found])}
    if kind == BIGRAM:
        columns |= {"a": whole([np.repeat(x[1], x[2]) for x in found]), "b": whole([x[3] for x in found])}
    else:
        columns |= {"tokens": pa.concat_arrays([pa.nulls(0, pa.string()), *[_names(*x[1:]) for x in found]])}
    return pa.table([*[group[x] for x in PACKED[:3]], *[_lists(ends, x if isinstance(x, pa.Array) else pa.array(x)) for x in columns.values()]], names=[*PACKED[:3], *columns])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks().flatten()


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    mixed = a * np.int64(-7046029254386353131) + b
    order = np.argsort(mixed)
    for again in (False, True):
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        if again or not (new[1:] & (np.diff(mixed[order]) == 0)).any():
            break
        order = np.lexsort((b, a))  # pairs that mix to the same value may not stand together
    key = np.empty(len(a), np.int64)
    key[order] = np.cumsum(new) - 1
    return key


def _totals(group: pa.Table, kind: int, own: bool, seed: int = 0) -> tuple[pa.Table, int, int]:
    """What the other blocks add to the counts that a bucket's rows hold, row by row; of tokens also how many
    distinct ones the corpus has, and how many hashes stand for several."""
    part = group.filter(pc.equal(group["kind"], kind)).combine_chunks()
    rows, n = part["block"].to_numpy(), _flat(part["counts"]).to_numpy()
    sizes = pc.list_value_length(part["counts"]).to_numpy()
    distinct = shared = 0
    if kind == BIGRAM:
        key = _same(*(_flat(part[x]).to_numpy() for x in ("a", "b")))
    else:
        coded = _flat(part["tokens"]).dictionary_encode()
        key, names = coded.indices.to_numpy(), coded.dictionary
        shared = len(names) - len(np.unique(_hashes(names, seed)))
        distinct = len(names if own else np.unique(key[np.repeat(rows < 0, sizes)]))
    others = np.bincount(key, n).astype(np.int64)[key] - n
    lists = _lists(_ends(sizes), pa.array(others, pa.int64()))
    out = pa.table([part["block"], part["kind"], part["bucket"], lists], names=[*PACKED[:3], "counts"])
    return out.filter(pc.greater_equal(out["block"], 0)), distinct, shared


def _counted(rows: DataFrame, own: bool, seed: int, buckets: int, parts: dict[str, int]) -> DataFrame:
    """(block, kind, bucket, data) of scored blocks, and a row per bucket with its distinct tokens and shared hashes."""
    rounds = min(ROUNDS, buckets)

    def dealer(turn: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                    for dealt in _block(_texts(data.as_py()), seed, False, own or block < 0, block, buckets, parts):
                        yield _packed(dealt.filter(pa.array(dealt["bucket"].to_numpy() % rounds == turn)))

        return deal

    def run(group: pa.Table) -> pa.Table:
        found = [_totals(_unpacked(group, kind), kind, own, seed) for kind in (BIGRAM, CONTEXT)]
        out = pa.concat_tables([x for x, *_ in found])
        data = [_pack(x.values.to_numpy()) for x in out["counts"]]
        told = {x: pa.nulls(len(out), pa.int64()) for x in ("v", "shared")}
        out = pa.table({x: out[x] for x in PACKED[:3]} | {"data": pa.array(data, pa.binary())} | told)
        return pa.concat_tables([out, pa.Table.from_pylist([{"v": found[1][1], "shared": found[1][2]}], out.schema)])

    tables = []
    for turn in range(rounds):
        dealt = rows.select("block", "data").mapInArrow(dealer(turn), "block long, kind int, bucket int, data binary")
        schema = "block long, kind int, bucket int, data binary, v long, shared long"
        tables.append(store(dealt.groupBy("bucket").applyInArrow(run, schema), "bigram-counts", once=True))
    return reduce(DataFrame.unionByName, tables)


def _frequent(rows: DataFrame, total: int) -> dict[str, int]:
    """Tokens that are more than one in ``SHARE``, and to how many buckets the bigrams of each go. A token
    that no block has so often is not among them, nor are there more than ``SHARE``."""
    found = rows.select(F.explode(F.arrays_zip("often", "n")).alias("x")).groupBy("x.often").agg(F.sum("x.n").alias("n"))
    return {r["often"]: 1 + r["n"] * SHARE // total for r in found.where(F.col("n") * SHARE > total).orderBy("often").collect()}


def text_surprisal(
    df: DataFrame,
    id_col: str,
    text: str,
    train: DataFrame | None = None,
    train_text: str | None = None,
    max_tokens: int | None = None,
    budget: int = BLOCK_BYTES,
) -> DataFrame:
    """Mean and population deviation of token surprisal per text; NULL under 2 tokens.

    The model is trained on ``train``, or on ``df`` itself. A bigram the training
    table never saw scores as a zero count in its context. Every text is read once: its block
    is stored in the shared folder. A bigram travels once for each block that holds it, so no
    key has more rows than there are blocks; ``budget`` is the memory that a block's tokens
    may take (or one text's). Buckets are counted in rounds, and what a round shuffled leaves
    the disks at its end. Mean and deviation come from weighted sums.
    """
    own, most, seed = train is None, budget // TOKEN_BYTES, 0
    blocks = rows = _blocks(df, id_col, text, max_tokens, most, True)
    if not own:
        corpus = train.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), F.col(train_text or text).alias(text))
        rows = blocks.unionByName(_blocks(corpus, id_col, text, max_tokens, most, False))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets, parts = max(1, min(1 << BUCKET_BITS, total // ROWS)), _frequent(rows, total)
    while True:
        counted = _counted(rows, own, seed, buckets, parts)
        seen = counted.agg(F.sum("v").alias("v"), F.sum("shared").alias("shared")).first()
        if not seen["shared"]:
            break
        seed += 1  # two tokens of one hash: all are hashed anew
    vocabulary = seen["v"] or 0

    def score(block: pa.Table, counted: pa.Table) -> pa.Table:
        found = pa.Table.from_batches(_block(_texts(block["data"][0].as_py(), _flat(block["ids"])), seed, True, own, 0, buckets, parts))

        def of(table: pa.Table, kind: int) -> pa.Table:
            return table.filter(pc.equal(table["kind"], kind)).combine_chunks()

        texts, firsts, sums = of(found, TEXT), _flat(of(found, FIRST)["places"]).to_numpy(), {}
        for kind in (BIGRAM, CONTEXT):
            held, others = of(found, kind), of(counted, kind)
            place, n = (_flat(held[x]).to_numpy() for x in ("places", "counts"))
            ends, row = _ends(pc.list_value_length(held["places"]).to_numpy()), {x: i for i, x in enumerate(held["bucket"].to_pylist())}
            n = n.astype(np.int64)
            for bucket, data in zip(others["bucket"].to_pylist(), others["data"], strict=True):
                i = row[bucket]
                n[ends[i] : ends[i + 1]] += _unpack(data.as_py())[0].astype(np.int64)
            sums[kind] = np.zeros(len(n), np.int64)
            sums[kind][place] = n
        # less the surprisal of an unknown bigram, so that the squares stay small
        s = np.log((sums[CONTEXT][firsts] + vocabulary) / ((sums[BIGRAM] + 1) * max(vocabulary, 1)))
        places, n = (_flat(texts[x]).to_numpy() for x in ("places", "counts"))
        sizes = pc.list_value_length(texts["places"]).to_numpy()
        row, s, n = np.repeat(np.arange(len(sizes)), sizes), s[places], n.astype(np.int64)
        sums = [np.bincount(row, x, len(sizes)) for x in (n, n * s, n * s * s)]
        columns = [texts["__id"], pa.array(sums[0].astype(np.int64)), *[pa.array(x.astype(np.float64), mask=sizes == 0) for x in sums[1:]]]
        return pa.table(columns, names=["__id", "n", "s", "q"])

    texts = blocks.select("block", "ids", "data")
    counted = counted.where(F.col("block").isNotNull()).select("block", "kind", "bucket", "data")
    schema = f"__id {df.schema[id_col].dataType.simpleString()}, n long, s double, q double"
    scored = texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, schema)
    sums = scored.groupBy("__id").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
    mean, square = F.try_divide(F.col("s"), F.col("n").cast("double")), F.try_divide(F.col("q"), F.col("n").cast("double"))
    spread = square - mean * mean
    return sums.select(
        F.col("__id").alias(id_col),
        (mean + F.ln(F.lit(max(vocabulary, 1)))).alias("surprisal_mean"),
        # what is below the rounding of the sums is no deviation
        F.sqrt(F.when(spread > square * 1e-14, spread).otherwise(spread * 0)).alias("surprisal_std"),
        F.col("n").alias("n_scored"),
    )
