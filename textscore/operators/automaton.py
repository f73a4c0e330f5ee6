"""Terms of a table found in texts by a trie over tokens, walked for all positions of many texts at once.

A term is a run of tokens. The terms' distinct tokens become codes, the terms paths of a trie, whose edges
are one sorted array of (state, code); a state's number is its edge's place. Every position of
every text starts at the root and goes on while a term begins as the text does, so a term of
thirty tokens costs no more than one of two where the text has neither, and no run of tokens is
ever built as a string. A table of any size is cut into shards of a bounded size, each a
trie of its own that is broadcast; every term is in one shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..session import ship
from .joins import BROADCAST_BYTES

#: Texts walked together in a task.
TEXTS = 512
#: Bytes that a term takes in a trie besides its text.
TERM_BYTES = 64


def normal_term(term: Column) -> Column:
    """A term as its lower-cased tokens joined by a space; empty if it has none."""
    return F.array_join(F.regexp_extract_all(F.lower(term), F.lit(TOKEN), 0), " ")


class TokenTrie:
    """Distinct terms, tokens joined by one space, as a trie in arrays."""

    def __init__(self, terms: pa.Array) -> None:
        self.terms = terms
        lists = pc.split_pattern(terms, " ")
        coded = lists.flatten().dictionary_encode()
        codes, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
        state, alive, depth, edges, states = np.zeros(len(terms), np.int64), np.arange(len(terms)), 0, [], 0
        while len(alive):
            keys, place = np.unique(state[alive] * len(self.words) + codes[starts[alive] + depth], return_inverse=True)
            edges.append(keys)
            state[alive] = states + 1 + place
            states, depth = states + len(keys), depth + 1
            alive = alive[sizes[alive] > depth]
        # states are numbered level by level, so the edges come in order
        self.edges = np.concatenate([np.zeros(0, np.int64), *edges])
        self.term_of = np.full(states + 1, -1)
        self.term_of[state] = np.arange(len(terms))

    def find(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of every occurrence of a term in the token lists."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        codes = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        end = np.cumsum(sizes)
        at = np.flatnonzero(codes >= 0)
        begun, state = text[at], np.zeros(len(at), np.int64)
        rows, terms = [], []
        while len(at) and len(self.edges):
            keys = state * len(self.words) + codes[at]
            place = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            on = self.edges[place] == keys
            at, begun, state = at[on] + 1, begun[on], place[on] + 1
            found = self.term_of[state]
            rows.append(begun[found >= 0])
            terms.append(found[found >= 0])
            on = at < end[begun]
            on[on] = codes[at[on]] >= 0
            at, begun, state = at[on], begun[on], state[on]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, terms))


def tries(terms: DataFrame, budget: int = BROADCAST_BYTES) -> Iterator[TokenTrie]:
    """The tries of the shards of ``terms``, a table of distinct normal terms in its only column; each holds about ``budget`` bytes."""
    (name,) = terms.columns
    count, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    shards = max(1, min(count, -(-(size + TERM_BYTES * count) // max(1, budget))))
    for shard in range(shards):
        # the driver sees one shard of bounded size at a time
        held = terms.where(F.pmod(F.xxhash64(name), F.lit(shards)) == shard).toArrow().column(name).combine_chunks()
        if len(held):
            yield TokenTrie(held.take(pc.sort_indices(held)))


def distinct_terms(df: DataFrame, terms: DataFrame, token_list: str, besides: str, result: str, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` less ``token_list`` and ``besides`` with ``result``: how many of the distinct ``terms`` occur in a row's token list.

    Terms that the row's array ``besides`` lists are not counted. A table within the budget
    is one shard and nothing is shuffled; the counts of several are added up by all other columns, which
    must tell the rows apart.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in (token_list, besides)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{result}` long"

    def counted(trie: TokenTrie) -> DataFrame:
        read = ship(spark, trie)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = read()
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    rows, found = own.find(part.column(len(kept)))
                    pairs = np.unique(rows * len(own.terms) + found)
                    listed = part.column(len(kept) + 1)
                    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
                    also = pc.fill_null(pc.index_in(listed.flatten(), value_set=own.terms), -1).to_numpy().astype(np.int64)
                    outside = np.repeat(np.arange(len(sizes)), sizes)[also >= 0] * len(own.terms) + also[also >= 0]
                    pairs = pairs[~np.isin(pairs, outside)]
                    counts = np.bincount(pairs // max(1, len(own.terms)), minlength=part.num_rows)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(counts)], names=[*kept, result])

        return df.select(*kept, token_list, besides).mapInArrow(run, schema)

    parts = [counted(trie) for trie in tries(terms, budget)]
    if len(parts) > 1:
        return reduce(DataFrame.union, parts).groupBy(*kept).agg(F.sum(result).alias(result))
    return parts[0] if parts else df.select(*kept, F.lit(0).cast("long").alias(result))


def term_occurrences(df: DataFrame, id_col: str, text: str, terms: DataFrame, term: str = "term", budget: int = BROADCAST_BYTES) -> DataFrame:
    """(id, term, n): how often each term of a table occurs in each text, overlapping ones included.

    Terms are given back as their lower-cased tokens joined by a space. Texts without a term have no row.
    """
    spark = df.sparkSession
    normal = terms.select(normal_term(F.col(term)).alias("term")).where("term <> ''").distinct()
    kind = df.schema[id_col].dataType.simpleString()

    def listed(trie: TokenTrie) -> DataFrame:
        read = ship(spark, trie)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = read()
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    rows, found = own.find(part.column(1))
                    pairs, n = np.unique(rows * len(own.terms) + found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pairs // len(own.terms))), own.terms.take(pa.array(pairs % len(own.terms))), pa.array(n)], names=[id_col, "term", "n"])

        return df.select(id_col, tokens(F.col(text)).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, term string, n long")

    parts = [listed(trie) for trie in tries(normal, budget)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"`{id_col}` {kind}, term string, n long")
