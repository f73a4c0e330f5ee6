"""Greedy token matching between a candidate and a reference text (precision, recall, F1)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, tokens
from ..session import store

# Vectors are broadcast only up to this counted size.
VECTOR_BYTES = 128 * 1024 * 1024

#: Pairs of texts whose tokens are counted together.
ROWS = 1024

_BLOCK = 2048  # candidate tokens compared at once, bounds memory per text


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each pair of token lists: tokens of the first, repeats included, that the second holds, all of the first; the reverse."""
    for pair in batches:
        for at in range(0, len(pair[0]), ROWS):
            sides = [x.slice(at, ROWS) for x in pair]
            n = len(sides[0])
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in sides]
            coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
            rows = [np.repeat(np.arange(n), size) for size in sizes]
            keys = np.concatenate(rows) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            left, right = keys[: len(rows[0])], keys[len(rows[0]) :]
            found = [np.bincount(row, np.isin(own, np.unique(other)), n) for row, own, other in zip(rows, (left, right), (right, left), strict=True)]
            values = np.stack([found[0], sizes[0], found[1], sizes[1]], axis=1).astype(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), pa.array(values.ravel()))


def token_overlap(candidate: Column, reference: Column) -> Column:
    """Struct of P, R and F1 with one-hot token vectors.

    P is the share of candidate tokens, repeats included, that occur in the
    reference; R the reverse. A side without tokens scores 0. The tokens of a batch of texts
    are coded once and counted together. NULL where either text is NULL.
    """

    def scores(found: Column) -> Column:
        p, r = (F.coalesce(F.try_divide(found[i].cast("double"), found[i + 1]), F.lit(0.0)) for i in (0, 2))
        return let(
            F.struct(p.alias("p"), r.alias("r")),
            lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), _f1(x["p"], x["r"]).alias("f1")),
        )

    return F.when(candidate.isNotNull() & reference.isNotNull(), let(_hits(tokens(candidate), tokens(reference)), scores))


def _best_cosines(left: np.ndarray, right: np.ndarray, left_rough: np.ndarray, right_rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine per row of each side; rows are unit vectors; blocks bound the memory.

    Products in single precision tell which pairs can be best; those alone are taken in double
    precision. Where vectors are so alike that these are many, the whole block is.
    """
    near = np.float32((left.shape[1] + 2) * 2.0**-22)
    best_left = np.full(len(left), -np.inf)
    best_right = np.full(len(right), -np.inf)
    for start in range(0, len(left), _BLOCK):
        own = slice(start, start + _BLOCK)
        part = left_rough[own] @ right_rough.T
        wanted = part >= (part.max(axis=1) - near)[:, None]
        wanted |= part >= part.max(axis=0) - near
        i, j = np.nonzero(wanted)
        if len(i) > 4 * sum(part.shape):
            part = left[own] @ right.T
            best_left[own] = part.max(axis=1)
            np.maximum(best_right, part.max(axis=0), out=best_right)
        else:
            exact = np.einsum("ij,ij->i", left[own][i], right[j])
            np.maximum.at(best_left[own], i, exact)
            np.maximum.at(best_right, j, exact)
    return best_left, best_right


def _pair_scores(cand: np.ndarray, cand_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, rough: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float]:
    if len(cand) == 0 or len(ref) == 0:
        return 0.0, 0.0, 0.0
    best_c, best_r = _best_cosines(cand, ref, *(rough or (cand.astype(np.float32), ref.astype(np.float32))))
    p = float(np.average(best_c, weights=cand_n))
    r = float(np.average(best_r, weights=ref_n))
    return p, r, (2 * p * r / (p + r) if p + r > 0 else 0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length and without NULLs."""
    if len(vectors) == 0:
        return np.zeros((0, 1))
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(token, vector array<double>): what both ways of :func:`greedy_similarity` work on.

    A NULL vector, and one that holds a NULL or non-finite component, is left out; of several vectors of one token
    the smallest in array order counts.
    """
    whole = vectors.select("token", F.col("vector").cast("array<double>").alias("vector")).filter(
        F.col("token").isNotNull() & F.col("vector").isNotNull()
    )
    whole = whole.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if whole.groupBy("token").count().filter("count > 1").isEmpty():
        return whole  # nothing to choose from, so the vectors need not be shuffled
    return whole.groupBy("token").agg(F.min("vector").alias("vector"))


def _scored_table(id_col: str, ids, scores: list[tuple[float, float, float]]) -> dict:
    values = np.array(scores, dtype=np.float64).reshape(-1, 3)
    return {id_col: ids, "precision": values[:, 0], "recall": values[:, 1], "f1": values[:, 2]}


def _with_broadcast_vectors(pairs: DataFrame, id_col: str, vectors: DataFrame, out_schema: str) -> DataFrame:
    table = vectors.toArrow()
    vocabulary = table["token"].combine_chunks()
    # made unit vectors once, not for every text
    shared = pairs.sparkSession.sparkContext.broadcast((vocabulary, _unit(_matrix(table["vector"]))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        rough = matrix.astype(np.float32)
        for batch in batches:
            words = [batch.column(name) for name in ("c", "r")]
            # one look-up for both sides: it hashes the whole vocabulary
            both = pa.concat_arrays([w.flatten() for w in words])
            places = pc.fill_null(pc.index_in(both, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = [pc.list_value_length(w).to_numpy(zero_copy_only=False) for w in words]
            # the distinct tokens of all texts of the batch at once, the second sides after the first
            texts = np.repeat(np.arange(2 * batch.num_rows), np.concatenate(lengths).astype(np.int64))
            keys, counts = np.unique((texts * len(matrix) + places)[places >= 0], return_counts=True)
            rows = keys % max(1, len(matrix))
            ends = np.searchsorted(keys, np.arange(2 * batch.num_rows + 1) * len(matrix))
            scores = []
            for row in range(batch.num_rows):
                c, r = (slice(ends[i], ends[i + 1]) for i in (row, row + batch.num_rows))
                scores.append(_pair_scores(matrix[rows[c]], counts[c], matrix[rows[r]], counts[r], (rough[rows[c]], rough[rows[r]])))
            yield pa.RecordBatch.from_pydict(_scored_table(id_col, batch.column(id_col), scores))

    rows = pairs.select(id_col, tokens(F.col("c")).alias("c"), tokens(F.col("r")).alias("r"))
    return rows.mapInArrow(score, out_schema)


#: Bytes that the vectors of a block of texts take in double precision, and the most texts of a block.
BLOCK_BYTES, TEXTS = 64 * 1024 * 1024, 4096


def _block_parts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, pa.ListArray, pa.ListArray, np.ndarray, pa.Array]]:
    """Blocks of the rows (id, tokens, tokens): ids, places of each text's distinct tokens, how often
    each occurs, how many are of the first side, and the block's distinct tokens, about ``most`` or one text's."""
    sides = [batch.column(1), batch.column(2)]
    coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
    width = max(1, len(coded.dictionary))
    owners = [np.repeat(2 * np.arange(batch.num_rows) + i, pc.list_value_length(x).to_numpy(zero_copy_only=False)) for i, x in enumerate(sides)]
    keys, counts = np.unique(np.concatenate(owners) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    codes = keys % width
    ends = np.searchsorted(keys, np.arange(2 * batch.num_rows + 1) * width)
    start = 0
    while start < batch.num_rows:
        begin = ends[2 * start]
        first = np.sort(np.unique(codes[begin:], return_index=True)[1])
        until = begin + first[most] if len(first) > most else len(codes)
        after = max(start + 1, int(np.searchsorted(ends[2::2], until, "right")))
        own = slice(begin, ends[2 * after])
        known, places = np.unique(codes[own], return_inverse=True)
        offsets = pa.array(ends[2 * start : 2 * after + 1 : 2] - begin, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (places, counts[own])]
        of_first = ends[2 * start + 1 : 2 * after : 2] - ends[2 * start : 2 * after : 2]
        yield batch.column(0).slice(start, after - start), *lists, of_first, coded.dictionary.take(pa.array(known))
        start = after


def _blocks(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """Texts in blocks, stored: a row per text with its tokens' places, and a row per distinct token of a block."""
    schema = f"block long, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, places array<int>, counts array<int>, of_first int, token string, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                for ids, places, counts, of_first, known in _block_parts(batch.slice(at, TEXTS), most):
                    n, m, block = len(ids), len(known), uuid.uuid4().int >> 65
                    columns = [
                        pa.array(np.full(n + m, block)),
                        *[pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in (ids, places, counts, pa.array(of_first, pa.int32()))],
                        pa.concat_arrays([pa.nulls(n, known.type), known]),
                        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m), pa.int32())]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", id_col, "places", "counts", "of_first", "token", "place"])

    return store(rows.mapInArrow(run, schema), "text-blocks")


def _with_joined_vectors(pairs: DataFrame, id_col: str, vectors: DataFrame, width: int, out_schema: str) -> DataFrame:
    """A vector travels once for each block of texts that holds its token, not for each text."""
    rows = pairs.select(id_col, tokens(F.col("c")).alias("c"), tokens(F.col("r")).alias("r"))
    if not pairs.groupBy(id_col).count().filter("count > 1").isEmpty():
        rows = rows.groupBy(id_col).agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("c", "r")])  # one id is one pair
    blocks = _blocks(rows, id_col, max(1, BLOCK_BYTES // (8 * max(1, width))))
    texts = blocks.where("token IS NULL").select("block", id_col, "places", "counts", "of_first")
    met = blocks.where("token IS NOT NULL").select(F.col("block").alias("of_block"), "token", "place")
    placed = met.join(vectors, "token").select("of_block", "place", "vector")

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        matrix = _unit(_matrix(own["vector"]))
        rough = matrix.astype(np.float32)
        places, counts = (texts[x].combine_chunks().flatten().to_numpy() for x in ("places", "counts"))
        row_of = np.full(places.max(initial=-1) + 1, -1)
        row_of[own["place"].to_numpy()] = np.arange(len(matrix))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(texts["places"]).to_numpy())])
        scores = []
        for start, n, end in zip(ends, texts["of_first"].to_numpy(), ends[1:]):
            pair = []
            for side in (slice(start, start + n), slice(start + n, end)):
                at = row_of[places[side]]
                pair.append((at[at >= 0], counts[side][at >= 0]))
            (c, c_n), (r, r_n) = pair
            scores.append(_pair_scores(matrix[c], c_n, matrix[r], r_n, (rough[c], rough[r])))
        return pa.table(_scored_table(id_col, texts[id_col], scores))

    return texts.groupBy("block").cogroup(placed.groupBy("of_block")).applyInArrow(score, out_schema)


def greedy_similarity(
    df: DataFrame,
    id_col: str,
    candidate: str,
    reference: str,
    vectors: DataFrame,
    budget: int = VECTOR_BYTES,
) -> DataFrame:
    """P, R and F1 per text pair from a table of token vectors (token, vector).

    P is the mean, over candidate tokens, of the best cosine with a reference token;
    R the reverse; tokens without a vector are left out, and a side without any
    scores 0. ``id_col`` must be unique: one group is one text pair. Cosines are
    taken block by block inside a task, so no pair of tokens becomes a row.

    A vector table whose counted size fits ``budget`` is broadcast and no shuffle
    happens; a larger one is joined by token to blocks of texts, of whose vectors a task holds about
    ``BLOCK_BYTES`` (or one text's). Both work on the same prepared vectors and give double precision, so the budget never changes a result.
    Vectors of different widths raise.
    """
    pairs = df.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(
        id_col, F.col(candidate).alias("c"), F.col(reference).alias("r")
    )
    out_schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, precision double, recall double, f1 double"
    ready = store(usable_vectors(vectors), "unit-vectors")
    size = F.array_size("vector")
    seen = ready.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.max(F.length("token")).alias("chars")).first()
    if seen["low"] != seen["high"]:
        raise ValueError(f"vectors are from {seen['low']} to {seen['high']} wide")
    counted = seen["n"] * (8 * (seen["high"] or 0) + 4 * (seen["chars"] or 0) + 16)
    if counted <= budget:
        return _with_broadcast_vectors(pairs, id_col, ready, out_schema)
    return _with_joined_vectors(pairs, id_col, ready, seen["high"] or 1, out_schema)
