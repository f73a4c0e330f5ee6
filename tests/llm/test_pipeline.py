"""The pipeline's stages one by one against plain Python, and the registered queries."""

import inspect
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from textscore.llm import minhash, queries
from textscore.llm.common import table
from textscore.session import release, shared_dir

from .test_minhash import classes

SMALL = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert set(queries.SQL) <= set(names) and set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents with columns of clashing names, NULLs, copies and texts without words."""
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rnd = random.Random(1)
    long = max((r for r in rows), key=lambda r: len(r[1]))
    words = long[1].split()
    near = " ".join(w for i, w in enumerate(words) if i != len(words) // 2)
    rows += [(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, "12 !!", "en", "x", 5), (9004, long[1], long[2], "x", 1), (9005, near, long[2], "x", 1), (None, long[1], None, None, None)]
    rnd.shuffle(rows)
    return spark.createDataFrame([(*r, "kept", 1.5, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, language string, score double, _language int")


def test_each_stage_keeps_columns_and_decides(spark, docs):
    ids = lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=str)
    language = corpus_pipeline.keep_languages(spark, docs, SMALL)
    assert language.schema == docs.schema
    assert {9001, 9002, 9003} & set(ids(language)) == set() and {9004, 9005, None} <= set(ids(language))
    assert len(ids(language)) >= 0.99 * (docs.count() - 3)

    clean = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert clean.schema == docs.schema
    scored = {r.doc_id: r.s for r in queries.toxicity.score(docs, queries.toxicity_model(docs, table(spark, SMALL, "labels")), result="s").select("doc_id", "s").collect()}
    assert set(ids(clean)) == {i for i, s in scored.items() if s < 0.5}

    one = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert one.schema == docs.schema
    known = sorted((r for r in docs.where("doc_id is not null").collect()), key=lambda r: r.doc_id)
    want = {known[i].doc_id for i, c in classes([r.text for r in known]).items() if i == c}
    assert {i for i in ids(one) if i is not None} == want and None in ids(one)

    packed = corpus_pipeline.pack(spark, docs, SMALL)
    assert sorted({r.doc_id for r in packed.collect()}, key=str) == sorted(set(ids(docs)), key=str)


def test_run_equals_its_stages(spark):
    docs = table(spark, SMALL, "documents")
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, SMALL).collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} <= kept
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SMALL)
    theirs = con.execute(queries.SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)


def test_stored_tables_go(spark):
    # other sessions may keep tables in the same folder
    held = lambda: {n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if "-" in n}
    release(spark)
    before = held()
    minhash.near_duplicates(table(spark, SMALL, "documents").limit(20)).collect()
    assert len(held() - before) > 5
    release(spark)
    assert held() <= before
