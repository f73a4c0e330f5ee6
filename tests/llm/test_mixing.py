"""The mix: targets, the schedule's evenness, and what is taken of each document."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textscore.llm import mixing
from textscore.llm.common import table


def fill(sizes, weights, budget, most=2):
    """Targets by resharing the excess by weight until none is above."""
    target, full = {}, set()
    while True:
        left = [s for s in sizes if s not in full]
        whole = sum(weights[s] for s in left)
        rest = budget - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weights[s] / whole for s in sizes}
        above = {s for s in left if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def docs_of(rng, n, sources):
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 40, 700]))), rng.choice(sources), "x") for i in range(n)]


SCHEMA = "doc_id long, text string, source string, size string"


@pytest.mark.parametrize(("n", "border"), [(1, 1 << 63), (1000, 1 << 63), (4321, 12345678901234567890), (70000, 3 << 60), (5, 1 << 64), (9, 0)])
def test_slots_before(n, border):
    assert mixing.slots_before(n, border) == sum(i * mixing._GOLDEN % (1 << 64) < border for i in range(n))


@pytest.mark.parametrize("needed", [[5], [3, 1, 2], [4000, 0, 37, 900, 1, 0], [0, 0, 6], [1, 100000]])
def test_schedule(spark, monkeypatch, needed):
    monkeypatch.setattr(mixing, "SLOTS", 300)
    rows = sorted(map(tuple, mixing.schedule(spark, needed).collect()))
    assert len({slot for slot, _, _ in rows}) == len(rows) == sum(needed)
    seen = Counter()
    for slot, place, rank in rows:  # a source's blocks come in order and evenly
        assert rank == seen[place]
        seen[place] += 1
        assert abs(seen[place] - slot * needed[place] / sum(needed)) < 3 + math.log2(sum(needed) + 1)
    assert [seen[i] for i in range(len(needed))] == needed


def test_targets_and_pieces(spark):
    rng = random.Random(2)
    rows = docs_of(rng, 600, ["a", "a", "a", "b", "c", "d", None, "é"]) + [(7000, "w " * 9000, "b", "x"), (7001, None, "c", "x"), (7002, "", "z", "x")]
    rows += [(8000, "one two three", "a", "x")] * 4 + [(None, "one two", "a", "x")] * 3 + [(None, "one two", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, (3.0, 1.0, 2.0), block=64)
    size, order = Counter(), sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    for _, text, source, _ in rows:
        size[source] += len((text or "").split())
    want = fill({s: size[s] for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()))
    taken = [r.asDict() for r in mixed.taken().collect()]
    assert len(taken) == len(rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in taken) == Counter((i, s, len((t or "").split())) for i, t, s, _ in rows)
    sums = Counter()
    for r in taken:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] += r["taken"]
    assert all(abs(sums[s] - want[s]) <= 0.5 + 1e-6 for s in order)

    pieces = mixed.pieces.collect()
    blocks, lines = defaultdict(list), defaultdict(list)
    for p in pieces:
        blocks[p.slot].append((p.offset, p.length, p.source))
        lines[p.unit, p.epoch].append((p.start, p.length))
    last = Counter()
    for held in blocks.values():  # a block is full, without gaps, of one source; only a source's last may be short
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at and length > 0
            at += length
        assert len({s for *_, s in held}) == 1
        last[held[0][2]] += at < 64
    assert max(last.values()) <= 1
    for held in lines.values():  # a document's pieces of one epoch do not overlap
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length


def test_reruns_agree(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    shuffled = docs.repartition(7, F.rand(3))
    one, two = (sorted(map(str, mixing.mix(d, (3.0, 1.0, 2.0), block=100).pieces.collect())) for d in (docs, shuffled))
    assert one == two and len(one) > 200


def test_own_weights_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", ""), (2, "a b", "y", ""), (3, "a", "z", "")], SCHEMA)
    weights = spark.createDataFrame([("x", 1.0), ("y", 0.0), ("q", 9.0)], "source string, weight double")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(docs, weights, 0.5, 2).taken().collect()}
    assert got == {1: (3.5, 4), 2: (0.0, 0), 3: (0.0, 0)}
    assert mixing.mix(docs.limit(0), (1.0,)).taken().collect() == []
    assert mixing.mix(docs.where("false"), weights).pieces.collect() == []
    silent = docs.withColumn("text", F.lit(None).cast("string"))
    assert [r.taken for r in mixing.mix(silent, (1.0,)).taken().collect()] == [0, 0, 0]


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "RANGES", 5)
    rows = spark.range(900).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"), F.md5(F.col("id").cast("string")).alias("turn"), (F.col("id") % 11).alias("n"))
    got = {r.id: r.at for r in mixing.running_total(rows, ["g"], "turn", "n", "at", 900).collect()}
    seen = Counter()
    for r in sorted(rows.collect(), key=lambda r: r.turn):
        assert got[r.id] == seen[r.g]
        seen[r.g] += r.n
