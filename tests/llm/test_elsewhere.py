"""Learned models reach workers that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})  # the driver's own path; workers do not get it
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from codeloom.llm.queries import QUERIES
for name in ("op2_neighbour_quality", "op3_hierarchical_language", "op7_lstm_crf_pii"):
    QUERIES[name].plan(spark, {data!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_models_travel_by_value(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=str(REPO), data=DATA)],
                         cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
