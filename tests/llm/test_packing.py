"""Packing: ids against the public library, plans and places against their rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textscore.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_and_wastes_little(seed):
    rnd = random.Random(seed)
    lengths = [min(2048, max(1, int(rnd.lognormvariate(6, 1.2)))) for _ in range(rnd.choice([1, 7, 300, 4000]))]
    histogram = dict(Counter(lengths))
    kinds = packing.plan(histogram)
    placed = Counter()
    for kind in kinds:
        assert kind.count > 0 and kind.room >= 0 and sum(k * n for k, n in kind.slots) + kind.room == 2048
        for length, n in kind.slots:
            placed[length] += n * kind.count
    assert placed == Counter(histogram)
    used, least = sum(k.count for k in kinds), -(-sum(lengths) // 2048)
    alone = sum(n for k, n in histogram.items() if k > 1024)
    assert used <= max(least, alone) * 1.02 + 2


def test_plan_of_equal_pieces():
    assert sum(k.count for k in packing.plan({1000: 9})) == 5
    assert sum(k.count for k in packing.plan({2048: 3, 1: 2048})) == 4
    assert packing.plan({}) == []


def test_configurations_reach_the_known_optimum():
    # two of 7 and one of 6, or three of 6, fill 20: 6 + 2 sequences
    chosen = packing.configurations([7, 6], [12, 12], 20, 1e-9)
    assert sum(n for _, n in chosen) == pytest.approx(8.0)


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_packed(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "Haus", "éà", "x1!", "<|endoftext|>"]) for _ in range(rnd.choice([1, 5, 60, 700, 4000]))) for _ in range(120)]
    texts += [None, "", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)] + [(0, texts[0], 5, "z")], "doc_id long, text string, length int, piece string")
    rows = packing.pack_documents(docs, PATH).collect()
    check_places(rows, 2048)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert len(by_doc) == len(texts)
    for doc, own in by_doc.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own = sorted(own, key=lambda r: (r.piece, r.sequence_id))
        if doc == 0:  # the repeated row
            own = own[:: 2]
        borders = [r.start for r in own] + [len(ids)]
        assert borders[0] == 0 and [r.piece for r in own] == list(range(len(own)))
        assert [r.length for r in own] == [b - a for a, b in zip(borders, borders[1:])]
        assert all(r.length == 2048 for r in own[1:])
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(borders, borders[1:])]


def test_pack_any_rows_and_refuse_wrong_lengths(spark):
    rows = spark.createDataFrame([(i, 1 + i % 9) for i in range(500)] + [(None, 4)], "id long, length long")
    packed = packing.pack(rows, ["id"], capacity=16).collect()
    assert len(packed) == 501
    assert check_places(packed, 16) <= 1.05 * sum(r.length for r in packed) / 16 + 1
    assert packing.pack(rows.limit(0), ["id"], capacity=16).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(rows, ["id"], capacity=8)


def test_encoder_knows_every_token_of_the_file():
    library = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(packing.vocabulary(PATH))
    texts = [t.decode() for t in packing.vocabulary(PATH) if not t.decode("utf-8", "ignore").encode() != t][::40]
    got = [np.concatenate(x).tolist() for x in ([ids for row, ids in encoder.encode([t])] for t in texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
