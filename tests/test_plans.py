"""Wide tables, sources, sinks, streams, and the shape of physical plans."""

import pytest
from pyspark.sql import functions as F

from textscore import functions as ts
from textscore.operators import normalize
from textscore.plans import main_metrics as main_plan
from textscore.plans import reference_free as free_plan
from textscore.session import CHECKPOINT_KEY, shared_dir
from textscore.sources import tables
from textscore.streaming import stream

from .test_text import random_texts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def answers(spark):
    values = random_texts(80, seed=11)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(values, reversed(values)))], "id long, answer string, human_answer string")


def test_reference_free_equals_single_functions(answers):
    wide = free_plan.reference_free_metrics(answers)
    assert wide.columns[0] == "id" and len(wide.columns) == 23
    rows = {r["id"]: r for r in wide.collect()}
    for side in free_plan.SIDES:
        t = F.col(side)
        single = answers.select(
            "id",
            ts.quantification_density(t).alias("q"),
            ts.causal_connective_density(t).alias("c"),
            ts.hedging_calibration(t).alias("h"),
            ts.modal_verb_profile(t).alias("m"),
        ).collect()
        for s in single:
            row = rows[s["id"]]
            assert row[f"{side}_quantification_density"] == s["q"]
            assert row[f"{side}_causal_density"] == s["c"]
            for field in ("hedge_to_booster_ratio", "hedge_density", "booster_density"):
                assert row[f"{side}_{field}"] == (s["h"][field] if s["h"] else None)
            for field in ("should", "must", "could", "will", "may", "might"):
                assert row[f"{side}_modal_{field}_freq"] == (s["m"][f"modal_{field}_freq"] if s["m"] else None)


def test_text_measures_need_no_shuffle_and_no_python(spark, answers, tmp_path):
    answers.write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    plan = plan_of(free_plan.reference_free_metrics(stored))
    for word in ("Exchange", "Python", "Cartesian"):
        assert word not in plan
    # the scan of each text happens once: the lower projection holds it, the upper reads it
    assert plan.count("regexp_extract_all(answer") == 4
    one = plan_of(stored.select("id", ts.hedging_calibration(F.col("answer"))))
    assert "human_answer" not in one.split("ReadSchema")[1]


def test_transform_is_map_only(spark, answers, tmp_path):
    scores = free_plan.reference_free_metrics(answers)
    scores.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    model = normalize.MetricNormalizer().fit(stored)
    assert "Exchange" not in plan_of(model.transform(stored))


def judged_input(spark):
    reply = '```json [{"observations": ["sales fell"], "hypotheses": ["price"], "recommendations": ["cut cost", "hire"], "is_reasoning_valid": true}] ```'
    human = "## Observations\nSales fell.\n## Interpretations\nPrice rose\n## Recommendations\nCut cost"
    return spark.createDataFrame([(1, "Sales fell.", human, reply), (2, None, "", "no json")], "id long, answer string, human_answer string, reply string")


def test_main_metrics_chain(spark):
    df = judged_input(spark)
    joined = df.select("id", "answer", "human_answer").join(main_plan.claims_from_sources(df), "id")
    rows = {r["id"]: r for r in main_plan.main_metrics(joined).collect()}
    assert list(rows[1].asDict()) == ["id", *main_plan.COLUMNS]
    assert (rows[1]["factuality_precision_50"], rows[1]["recommendations_precision_50"], rows[1]["reasoning_percentage"]) == (1.0, 0.5, 1.0)
    assert rows[1]["precision_bert"] == 1.0
    assert set(rows[2].asDict().values()) == {2, None}

    def factory():
        return lambda claims, premises: [1.0 if c == "hire" else 0.0 for c in claims]

    vectors = spark.createDataFrame([("sales", [1.0, 0.0]), ("fell", [0.0, 1.0])], "token string, vector array<float>")
    own = {r["id"]: r for r in main_plan.main_metrics(joined, vectors=vectors, scorer=factory).collect()}
    assert (own[1]["factuality_precision_50"], own[1]["recommendations_precision_50"], own[1]["f1_bert"]) == (0.0, 0.5, 1.0)


def test_missing_table_is_one_clear_error(spark, tmp_path):
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [("1", ' lead "quoted" \n line ', "x"), ("2", None, "y"), ("3", "", "x")]
    df = spark.createDataFrame(rows, tables.ANSWER)
    tables.write_table(df, str(tmp_path / fmt), fmt)
    back = tables.read_table(spark, str(tmp_path / fmt), tables.ANSWER, fmt)
    if fmt == "csv":
        rows[2] = ("3", None, "x")  # CSV has one sign for empty and missing
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


def test_csv_holds_a_row_per_line_and_is_split(spark, tmp_path):
    texts = ["a\nb", "a\r\nb\r", "\\n", "\\\n", "\\", "\\\\n\n", "\n\n\n", 'q"\n"q', " x ", "\\r\\", "plain", None, "é,\u2028東\n"]
    rows = [(i, texts[i % len(texts)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    tables.write_table(df, str(tmp_path / "c"), "csv")
    (file,) = (tmp_path / "c").glob("part-*.csv")
    assert len(file.read_bytes().split(b"\n")) == len(rows) + 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        back = tables.read_table(spark, str(tmp_path / "c"), "id long, t string", "csv")
        assert back.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, back.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # files of other writers: line breaks inside quotes on request, backslashes as they are
    (tmp_path / "f.csv").write_text('id,t\n1,"a\nb"\n2,c\\nd\n')
    read = lambda **o: [tuple(r) for r in tables.read_table(spark, str(tmp_path / "f.csv"), "id long, t string", "csv", **o).orderBy("id").collect()]
    assert read(multiLine=True) == [(1, "a\nb"), (2, "c\\nd")]
    (tmp_path / "f.csv").write_text("id,t\n2,c\\nd\n")
    assert read(escaped=False) == [(2, "c\\nd")] and read() == [(2, "c\nd")]


def test_nested_columns_become_json_in_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", 'b"c'])], "id string, claims array<string>")
    tables.write_table(df, str(tmp_path / "n"), "csv")
    assert tables.read_table(spark, str(tmp_path / "n"), "id string, claims string", "csv").first()["claims"] == '["a","b\\"c"]'


def test_nan_is_read_as_missing_and_dimensions_stay(spark, tmp_path):
    spark.createDataFrame([("1", float("nan")), ("2", 1.5)], "id string, f1_bert double").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([("1", "cot", "sales", "a"), ("9", "cot", "sales", "a")], tables.BASIC_INFO).write.parquet(str(tmp_path / "b"))
    rows = tables.load_analysis(spark, str(tmp_path / "b"), str(tmp_path / "m")).collect()
    assert {(r["id"], r["f1_bert"]) for r in rows} == {("1", None), ("9", None)}


def test_four_tables_join(spark, tmp_path):
    spark.createDataFrame([("1", "cot", "sales", "a")], tables.BASIC_INFO).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([("1", "x", "y")], tables.ANSWER).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("1", ["f"], "F", ["r"], "R")], tables.NLI_INFO).write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([("1", "[]")], tables.REASONING_INFO).write.parquet(str(tmp_path / "r"))
    paths = {n: str(tmp_path / n[0]) for n in ("basic_info", "answer", "nli_info", "reasoning_info")}
    loaded = tables.load_evaluation(spark, paths)
    assert main_plan.main_metrics(main_plan.evaluation_input(*loaded.values())).count() == 1


def test_streamed_scores_equal_batch_scores(spark, answers, tmp_path):
    answers.write.parquet(str(tmp_path / "in"))
    model = normalize.MetricNormalizer().fit(free_plan.reference_free_metrics(answers))
    arriving = stream.read_stream(spark, str(tmp_path / "in"), answers.schema)
    scored = stream.score_stream(arriving, model)
    stream.run_available(scored, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = model.transform(free_plan.reference_free_metrics(answers))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_rolling_index_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, strategy string, q double"
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(rows):
        spark.createDataFrame(rows, "t string, strategy string, q double").select(F.to_timestamp("t").alias("ts"), "strategy", "q").coalesce(1).write.mode("append").parquet(source)
        rolled = stream.rolling_index(stream.read_stream(spark, source, schema), "ts", "q", "strategy", "1 hour", lateness="10 minutes")
        stream.run_available(rolled, out, cp)

    arrive([("2024-01-01 10:05:00", "cot", 1.0), ("2024-01-01 10:30:00", "cot", 3.0), ("2024-01-01 12:00:00", "cot", 5.0)])
    arrive([("2024-01-01 10:40:00", "cot", 100.0), ("2024-01-01 14:00:00", "cot", 7.0)])
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r["n"], r["mean_value"]) for r in rows] == [(2, 2.0), (1, 5.0)]


def test_shared_folder_is_read_from_the_session(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    assert folder == named.rstrip("/")


def test_stored_tables_are_deleted(spark):
    from textscore.session import _hadoop_path, store, stored_tables

    with stored_tables(spark):
        kept = store(spark.range(5), "kept")
        path, files = _hadoop_path(spark, kept.inputFiles()[0].rsplit("/", 1)[0])
        assert kept.count() == 5 and files.exists(path)
    assert not files.exists(path)


def test_worker_helpers_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from textscore.operators import reports, similarity

    (tmp_path / "f").write_bytes(cloudpickle.dumps((similarity._pair_scores, reports._comoments(["a"], [0.0]))))
    load = "import pickle, sys; f, g = pickle.load(open(sys.argv[1], 'rb')); import numpy as np; print(f(np.eye(2), np.ones(2), np.eye(2), np.ones(2)))"
    done = subprocess.run([sys.executable, "-c", load, str(tmp_path / "f")], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "(1.0, 1.0, 1.0)", done.stderr
