"""Run queries and their SQL side by side: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import SQL
from checks.queries import QUERIES
from textscore.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0) if v is not None else (True, "", 0) for v in row)


def difference(spark, con, folder: str, name: str) -> str | None:
    """None where both agree on columns, row count and every value."""
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    if name not in SQL:
        return None if ours else "no rows"
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, folder, name)
        except Exception as error:  # keep going: the report names every failure
            found = f"{type(error).__name__}: {str(error)[:400]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {(found or '')[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree; without SQL: {sorted(set(names) - set(SQL))}")


if __name__ == "__main__":
    main()
