"""Claim support: score each claim against premises, label it by threshold, summarise.

A text's claims and premises stay in their row: the pairs are scored inside it and
only the best premise per claim leaves, so no pair table is built or shuffled. Under the
default support the tokens of a row's premises form an inverted index; one pass over a
claim's tokens counts what it shares with every premise, so premises that share nothing cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import ALIGN_THRESHOLDS
from ..functions.text import let, tokens

PairScorer = Callable[[list[str], list[str]], Sequence[float]]

VERDICT = T.StructType(
    [
        T.StructField("claim", T.StringType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
    ]
)

_VERDICT = pa.struct([("claim", pa.string()), ("p", pa.float64()), ("evidence", pa.string())])


def token_support(claim_tokens: Column, premise_tokens: Column) -> Column:
    """Share of the claim's distinct tokens found in the premise; 0 for a claim without tokens.

    Both arguments are lists of distinct tokens.
    """
    shared = F.array_size(F.array_intersect(claim_tokens, premise_tokens)).cast("double")
    return shared / F.greatest(F.array_size(claim_tokens), F.lit(1))


def _distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


#: Rows indexed together, and shared tokens counted at once.
ROWS, SHARED = 256, 1 << 21


class _Lists:
    """Lists of token lists, flat: each inner list's row and size (-1 where it is NULL), each token's inner list."""

    def __init__(self, outer: pa.ListArray) -> None:
        sizes = pc.fill_null(pc.list_value_length(outer), 0).to_numpy()
        inner = outer.flatten()
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.size = pc.fill_null(pc.list_value_length(inner), -1).to_numpy().astype(np.int64)
        self.words = inner.flatten()
        self.owner = np.repeat(np.arange(len(self.size)), np.maximum(self.size, 0))


def _supported(claims: pa.ListArray, premises: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """For each claim in order (its best support, the place of its first best premise in the row); -1 where none counts.

    Both hold lists of distinct tokens, one for each claim and premise of a row.
    """
    left, right = _Lists(claims), _Lists(premises)
    begin = np.searchsorted(right.row, np.arange(len(claims)))
    # without a shared token the first premise that is not NULL is best, with no support
    known = np.append(np.flatnonzero(right.size >= 0), len(right.size))
    first = known[np.searchsorted(known, begin)[left.row]] if len(left.row) else np.zeros(0, np.int64)
    some = (left.size >= 0) & (first < np.append(begin, len(right.row))[left.row + 1])
    best, place = np.where(some, 0.0, -1.0), np.where(some, first - begin[left.row], -1)
    if not len(left.owner) or not len(right.owner):
        return best, place
    # the index: the row's premises that hold a token, in order, under (row, token)
    coded = pa.concat_arrays([left.words, right.words]).dictionary_encode()
    codes, width = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    keys = right.row[right.owner] * width + codes[len(left.owner) :]
    order = np.argsort(keys, kind="stable")
    keys, holder = keys[order], right.owner[order]
    wanted = left.row[left.owner] * width + codes[: len(left.owner)]
    low, n = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
    n -= low
    # claims in order, as many at a time as share about SHARED tokens with premises
    ends = np.searchsorted(left.owner, np.arange(1, len(left.size) + 1))
    total = np.concatenate([[0], np.cumsum(n)])
    claim = 0
    while claim < len(left.size):
        start = ends[claim - 1] if claim else 0
        after = max(claim + 1, int(np.searchsorted(total[ends], total[start] + SHARED, "right")))
        end = ends[after - 1]
        own = n[start:end]
        spots = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[start:end], own)
        pairs = np.repeat(left.owner[start:end], own) * len(right.size) + holder[spots]
        pairs, shared = np.unique(pairs, return_counts=True)
        # of each claim's premises the one with most shared tokens, the earliest of several
        of, premise = pairs // len(right.size), pairs % len(right.size)
        order = np.lexsort((premise, -shared, of))
        top = order[np.diff(of[order], prepend=-1) > 0]
        best[of[top]] = shared[top] / left.size[of[top]]
        place[of[top]] = premise[top] - begin[left.row[of[top]]]
        claim = after
    return best, place


_FOUND = T.ArrayType(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("at", T.IntegerType())]))


@F.arrow_udf(_FOUND)
def _index_support(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for claims, premises in batches:
        # given back slice by slice, so that no batch's result is held whole
        for at in range(0, len(claims), ROWS):
            own = claims.slice(at, ROWS)
            best, place = _supported(own, premises.slice(at, ROWS))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy())])
            found = pa.StructArray.from_arrays([pa.array(best), pa.array(place + 1, pa.int32())], ["p", "at"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def claim_verdicts(claims: Column, premises: Column, k: int | None = None) -> Column:
    """One verdict (claim, p, evidence) per claim under the default token support.

    The first of the premises with the highest support is the evidence; -1 and "" where no
    premise counts. ``k`` is the number of leading premises tried; ``None`` tries all. NULL
    where either list is missing; an empty list of premises supports nothing. Only distinct tokens
    cross to Python, in Arrow batches; the cost is linear in them and in the tokens shared.
    """
    pool = F.slice(premises, 1, k) if k is not None else premises
    empty = F.array().cast("array<array<string>>")
    sets = [F.coalesce(F.transform(x, _distinct_tokens), empty) for x in (claims, pool)]

    def name(given: Column) -> Column:
        def verdict(claim: Column, i: Column) -> Column:
            own = F.get(given["found"], i)
            evidence = F.when(own["at"] > 0, F.get(given["texts"], own["at"] - 1)).otherwise("")
            return F.struct(claim.alias("claim"), own["p"].alias("p"), evidence.alias("evidence"))

        return F.transform(given["claims"], verdict)

    # bound once: a lambda would evaluate the lists for every claim
    given = F.struct(claims.alias("claims"), pool.alias("texts"), _index_support(*sets).alias("found"))
    return F.when(premises.isNotNull(), let(given, name))


#: Pairs that a user's scorer sees at once, and rows whose texts and verdicts are Python objects at once.
PAIRS, SCORED_ROWS = 4096, 64


def _score_slices(score: PairScorer, pairs: Iterator[tuple[str, str]]) -> Iterator[float]:
    while part := list(islice(pairs, PAIRS)):
        yield from score([c for c, _ in part], [p for _, p in part])


def _judge(score: PairScorer, lists: list[list[tuple[list[str], list[str]]]]) -> list[list[list[dict]]]:
    """Verdicts of every (claims, premises) of every row; the pairs reach the scorer in slices."""
    values = _score_slices(score, ((c, p) for row in lists for claims, premises in row for c in claims for p in premises))
    out = []
    for row in lists:
        verdicts = []
        for claims, premises in row:
            own = []
            for claim in claims:
                best, evidence = -1.0, ""
                for premise in premises:
                    value = next(values)
                    if value is not None and value > best:
                        best, evidence = float(value), premise
                own.append({"claim": claim, "p": best, "evidence": evidence})
            verdicts.append(own)
        out.append(verdicts)
    return out


def _judge_batches(score: PairScorer, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Verdicts of the batches' rows, given back ``SCORED_ROWS`` rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), SCORED_ROWS):
            rows = [[(x["claims"], x["premises"]) for x in row] for row in batch.slice(at, SCORED_ROWS).to_pylist()]
            yield pa.array(_judge(score, rows), pa.list_(pa.list_(_VERDICT)))


def scored_verdicts(lists: Sequence[tuple[Column, Column]], make: Callable[[], PairScorer], k: int | None = None) -> Column:
    """array of verdict lists, one per (claims, premises), by a user's scorer.

    One Arrow UDF for all lists: only claims and premises cross to Python, a bounded number of rows
    is held as Python objects, and the scorer is made once per task. A list is NULL where its claims or premises are.
    """
    pools = [(c, F.slice(p, 1, k) if k is not None else p) for c, p in lists]
    empty = F.array().cast("array<string>")
    given = F.array(*[F.struct(F.coalesce(c, empty).alias("claims"), F.coalesce(p, empty).alias("premises")) for c, p in pools])

    @F.arrow_udf(T.ArrayType(T.ArrayType(VERDICT)))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _judge_batches(make(), batches)

    found = run(given)
    return let(found, lambda v: F.array(*[F.when(c.isNotNull() & p.isNotNull(), v[i]) for i, (c, p) in enumerate(pools)]))


def add_verdicts(
    df: DataFrame,
    claims: str,
    premises: str,
    out: str = "verdicts",
    k: int | None = None,
    scorer: Callable[[], PairScorer] | None = None,
) -> DataFrame:
    """``df`` with a column of verdicts.

    ``scorer`` is a factory of a batch scorer ``(claims, premises) -> scores in
    [0, 1]``; it is called once per task, and its scorer on slices of pairs.
    Without one the default token support is used.
    """
    if scorer is None:
        return df.withColumn(out, claim_verdicts(F.col(claims), F.col(premises), k))
    return df.withColumn(out, scored_verdicts([(F.col(claims), F.col(premises))], scorer, k)[0])


def label_name(threshold: float) -> str:
    return f"label_{round(threshold * 100)}"


def per_claim(df: DataFrame, id_col: str, verdicts: str = "verdicts", thresholds: Sequence[float] = ALIGN_THRESHOLDS) -> DataFrame:
    """One row per claim: its position, p to 3 digits, evidence and one label per threshold."""
    rows = df.select(id_col, F.posexplode(verdicts).alias("claim_pos", "v"))
    labels = [
        F.when(F.col("v.p") >= t, "ALIGN").otherwise("NOT_ALIGN").alias(label_name(t)) for t in thresholds
    ]
    return rows.select(
        id_col,
        F.col("claim_pos").cast("long").alias("claim_pos"),
        F.col("v.claim").alias("claim"),
        *labels,
        F.bround("v.p", 3).alias("p"),
        F.col("v.evidence").alias("evidence"),
    )


def align_count(verdicts: Column, threshold: float) -> Column:
    return F.array_size(F.filter(verdicts, lambda v: v["p"] >= threshold)).cast("long")


def claim_summary(
    df: DataFrame, id_col: str, prefix: str, verdicts: str = "verdicts", thresholds: Sequence[float] = ALIGN_THRESHOLDS
) -> DataFrame:
    """Long form: one row per text, threshold and label seen, with its count and the total."""
    cells = []
    for t in thresholds:
        aligned = align_count(F.col(verdicts), t)
        for label, n in (("ALIGN", aligned), ("NOT_ALIGN", F.array_size(verdicts) - aligned)):
            cells.append(
                F.struct(
                    F.lit(f"{prefix}_{round(t * 100)}_summary").alias("summary"),
                    F.lit(label).alias("label"),
                    n.cast("long").alias("n"),
                    F.array_size(verdicts).cast("long").alias("total"),
                )
            )
    return df.select(id_col, F.explode(F.array(*cells)).alias("c")).select(id_col, "c.*").filter("n > 0")


def support_precision(verdicts: Column, threshold: float = 0.50) -> Column:
    """Share of claims supported at ``threshold``; NULL for an empty or missing claim list."""
    return F.try_divide(align_count(verdicts, threshold).cast("double"), F.array_size(verdicts))


def supported_share(claims: Column, reference: Column, threshold: float = 0.50) -> Column:
    """Precision of ``claims`` against one reference text, the factuality and actionability measure.

    Equal to :func:`support_precision` over a pool of one, without building evidence.
    NULL where the claims or the reference are missing.
    """

    def share(reference_tokens: Column) -> Column:
        def supported(claim: Column) -> Column:
            return let(_distinct_tokens(claim), lambda ct: token_support(ct, reference_tokens)) >= threshold

        return F.try_divide(F.array_size(F.filter(claims, supported)).cast("double"), F.array_size(claims))

    return F.when(reference.isNotNull(), let(_distinct_tokens(reference), share))


def evaluate_factuality(facts: Column, reference: Column) -> Column:
    return supported_share(facts, reference)


def evaluate_actionability(recommendations: Column, reference: Column) -> Column:
    return supported_share(recommendations, reference)
