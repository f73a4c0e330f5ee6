"""Every registered query against its SQL, and proof that the planted cues are hit."""

import pytest

from checks.compare import connect, difference
from checks.oracle import SQL
from checks.queries import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, SMALL, name) is None


def test_planted_cues_are_hit(spark):
    rows = QUERIES["reference_free"](spark, SMALL).toPandas()
    for column in rows.columns[1:]:
        if not column.startswith("human_answer_modal") or column.endswith(("should_freq", "must_freq", "could_freq", "will_freq")):
            assert (rows[column] > 0).any(), column
    assert rows["answer_hedge_density"].isna().any()
    evidence = QUERIES["evidentiality"](spark, SMALL).toPandas()
    assert (evidence["answer_grounded_count"] > 0).any() and (evidence["answer_ungrounded_count"] > 0).any()
    assert QUERIES["quantity_labels"](spark, SMALL).count() >= 4


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.queries()) >= set(entry.oracle_sql())
