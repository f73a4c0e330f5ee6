"""Executors need not have the package: every query runs from a foreign folder without a Python path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.append(sys.argv[1])
import __spark_entry__
from textscore.session import local_session, release
spark = local_session(4, 4)
spark.sparkContext.setLogLevel("ERROR")
def known(rows):
    try:
        import textscore
    except ModuleNotFoundError:
        return iter([])
    return iter(["found"])
assert not spark.sparkContext.parallelize([1], 1).mapPartitions(known).collect()
for name, query in __spark_entry__.LLM.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    release(spark)
    print("ran", name)
"""


def test_every_query_runs_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 14
