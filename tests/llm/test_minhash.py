"""BagMinHash: the estimate against the exact similarity, classes against brute force."""

import random
from collections import defaultdict

import numpy as np

from textscore.llm import chars, minhash
from textscore.llm.common import table


def bags_of(texts):
    return [minhash.shingles(w) for w in minhash.word_hashes(texts, len(texts), chars.Alphabet())]


def classes(texts, threshold=0.8):
    """{row: smallest row reachable by links}, comparing every pair."""
    bags, parent = bags_of(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if minhash.overlap(bags[i], bags[j]) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    for _ in range(3):
        hashes = np.sort(rng.integers(1, 2**63, 150).astype(np.uint64))
        one = rng.integers(1, 40, 150)
        two = np.where(rng.random(150) < 0.6, one, rng.integers(1, 40, 150))
        agree = []
        for salt in range(60):
            salted = chars.mix(hashes + np.uint64(salt))
            order = np.argsort(salted)
            signed = minhash.signatures([(salted[order], one[order]), (salted[order], two[order])])
            agree.append((signed[0] == signed[1]).mean())
        assert abs(np.mean(agree) - minhash.overlap((hashes, one), (hashes, two))) < 4 * np.std(agree) / 60**0.5 + 0.005


def test_overlap_counts_repeats():
    one, two = bags_of(["a b c d e a b c d e", "a b c d e"])
    assert minhash.overlap(one, two) == 1 / 6
    assert minhash.overlap(one, one) == 1
    assert minhash.overlap(*bags_of(["", "a"])) == 0


def test_classes_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    assert found == {ids[i]: ids[c] for i, c in classes(texts).items()}


def edited(words, rnd, share):
    return [w if rnd.random() > share else f"n{rnd.randint(0, 10**6)}" for w in words]


def test_large_group_whose_members_differ(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)]
    texts = [" ".join(edited(base, rnd, rnd.choice([0.005, 0.02, 0.04]))) for _ in range(120)]
    chain = base
    for _ in range(25):
        chain = edited(chain, rnd, 0.02)
        texts.append(" ".join(chain))
    texts += [" ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == classes(texts)


def test_edge_cases(spark):
    texts = ["One two, THREE!", "one two three", "", None, "!?", "one two three four five six", "one two three four five six", "", "one two three"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "one two three", "x", 0), (5, texts[5], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, component_id int")
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by == {0: {(0, True)}, 1: {(0, False)}, 2: {(2, True)}, 3: {(3, True)}, 4: {(4, True)}, 5: {(5, True)}, 6: {(5, False)}, 7: {(7, True)}, 8: {(0, False)}, None: {(None, True)}}
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_very_long_text(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_repeated_ids_of_different_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    # 5 counts with one of its texts; neither text is lost
    assert found in ([(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)], [(3, 3, True), (5, 5, True), (5, 5, True), (9, 5, False)])


def test_two_large_classes_in_blocks(spark, monkeypatch):
    """Two groups of near copies that share half their shingles: no link between them but one, in whichever block it falls."""
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    other = base[:95] + [f"v{i}" for i in range(25)]
    texts = [" ".join(edited(x, rnd, 0.008)) for x in (base, other) for _ in range(110)]
    texts.append(" ".join(base[:95] + base[95:107] + other[107:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == classes(texts)


def test_every_pair_of_blocks_meets_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    ids = range(10)
    crowded = spark.createDataFrame([(7, 2, i) for i in ids] + [(8, 0, 1)], "bucket long, band int, id long")
    classes = spark.createDataFrame([(i, i // 4) for i in ids], "node long, component long")
    signs = spark.createDataFrame([(i, np.full(minhash.PLACES, 0, np.uint32).tobytes()) for i in ids], "id long, signature binary")
    met = []
    for group in minhash._groups(minhash._blocks(crowded, classes, signs).toArrow().to_batches(max_chunksize=4)):
        own, at = group.column("id").to_pylist(), group.column("band")[0].as_py()
        assert at == 2
        met += [frozenset((own[i], own[j])) for i, j in zip(*map(np.concatenate, zip(*minhash._near(_banded(group, at), 5), strict=True)), strict=True)] if own else []
    assert sorted(map(sorted, met)) == sorted([a, b] for a in ids for b in ids if a < b and a // 4 != b // 4)


def _banded(group, band):
    """The group with signatures that agree from ``band`` on."""
    values = np.arange(minhash.PLACES, dtype=np.uint32)
    signed = [np.where(values < band * minhash.ROWS, i * 1000 + values, 0).astype(np.uint32).tobytes() for i in range(1, group.num_rows + 1)]
    return group.set_column(group.schema.get_field_index("signature"), "signature", [signed])
