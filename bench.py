"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (comma-separated) an optional choice of queries. Every query is
planned and run in full, without collecting its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from textscore.session import local_session  # noqa: E402

HEADLINE = (
    "reference_free",
    "main_metrics",
    "strategy_hedging",
    "readability",
    "quantification",
    "entity_density_table",
    "formality",
    "token_frequencies",
    "token_surprisal",
    "token_similarity",
    "vector_similarity",
    "claim_labels",
    "factuality",
    "reasoning_validity",
    "skew_report",
    "normalise",
    "strategy_boxes",
    "quality_hierarchy",
    "correlations",
    "human_gap",
    "scorecard",
    "stream_rolling_index",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # start the executor threads and the code paths every query shares
    QUERIES["blank_texts"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
