"""Pre-tokens and byte-level BPE against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from textscore.llm import bpe, chars, pretokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab'strvelmdSé1² ٣ \n\t   !?_-'''  \x1c\x85😀́<|>"


def random_texts(n, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.mark.parametrize("size", [16, chars.CHUNK])
def test_pretokens_equal_the_pattern(size):
    # the rank files' library counts Unicode's white space only
    spaced = public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    texts = random_texts(3000, 60, 1)
    found = [[] for _ in texts]
    alphabet = chars.Alphabet()
    for rows, parts in chars.chunks(texts, size):
        points, kinds, ends = alphabet.read(parts)
        starts, stops = pretokens.split(points, kinds)
        pieces, at = pretokens.strings(points, starts, stops), 0
        for row, n in zip(rows, chars.counts_per_part(starts, ends), strict=True):
            found[row] += pieces[at : at + n]
            at += n
    assert found == [regex.findall(spaced, t) for t in texts]


def test_equal_spans_have_equal_hashes_and_one_number():
    alphabet, memo = chars.Alphabet(), chars.Memo(10)
    points, kinds, _ = alphabet.read(["ab cd ab", "cd"])
    starts, stops = chars.runs(kinds, (chars.LETTER,))
    numbers, new = memo.numbers(alphabet.hashes(points, starts, stops))
    assert numbers[0] == numbers[2] and numbers[1] == numbers[3] and len(new) == 2


def test_index_keeps_its_numbers_as_it_grows():
    index = chars.HashIndex(3)
    keys = chars.mix(np.arange(1, 5000, dtype=np.uint64))
    for part in np.array_split(keys, 7):
        index.add(part)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(chars.mix(keys)) == -1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_perfect_hash_is_minimal(n):
    keys = [b"key %d" % i for i in range(n)]
    found = bpe.PerfectHash(keys)
    assert found.find(keys).tolist() == list(range(n))
    assert sorted(found.key_at.tolist()) == list(range(n))


def test_encoding_equals_the_library(spark, reference):
    texts = [*random_texts(500, 80, 2), None, "", " ", "word" * 3000, "<|endoftext|>", "a\u0000b"]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids double")
    coded = bpe.encode(rows, PATH)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, PATH).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip(rows, PATH).collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_text_longer_than_a_chunk(spark, reference, monkeypatch):
    text = " ".join(random_texts(400, 40, 3))
    tokens = bpe.read_ranks(PATH)
    codec = bpe.Codec(tokens, bpe.PerfectHash(tokens), memo=50)
    pieces = chars.chunks
    monkeypatch.setattr(chars, "chunks", lambda texts: pieces(texts, 300))
    assert np.concatenate([ids for _, ids in codec.encode([text])]).tolist() == reference.encode_ordinary(text)


def test_repeated_rows_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.n_tokens for r in bpe.round_trip(rows, PATH).collect()] == [2, 2, 2]
    assert bpe.round_trip(rows.limit(0), PATH).collect() == []
