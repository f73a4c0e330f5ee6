import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from textscore.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="textscore-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """(id, text) from a list of texts."""

    def build(values):
        return spark.createDataFrame(list(enumerate(values)), "id long, text string")

    return build


@pytest.fixture(scope="session")
def evaluate(texts):
    """Values of a text function over a list of texts, in order."""

    def run(fn, values):
        rows = texts(values).select("id", fn("text").alias("v")).orderBy("id").collect()
        return [r["v"].asDict() if hasattr(r["v"], "asDict") else r["v"] for r in rows]

    return run
