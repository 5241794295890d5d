"""A write whose tasks fail and are retried still leaves every row exactly once."""

import json
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import json, sys
sys.path.insert(0, sys.argv[1])
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from tidemark.session import scratch_path
from tidemark.sources.writes import replace_periods

spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").getOrCreate())
if not spark.sparkContext.getCheckpointDir():
    spark.sparkContext.setCheckpointDir(sys.argv[2])

def fail_first_attempt(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("task lost")
    for pdf in batches:
        yield pdf

n = 50_000
df = (spark.range(n).repartition(8)
      .mapInPandas(fail_first_attempt, "id long")
      .select("id", F.lit(2020).alias("year"), (F.col("id") % 3 + 1).cast("int").alias("month")))
root = scratch_path(spark, "retried")
replace_periods(df, root)
back = spark.read.parquet(root)
print(json.dumps({"rows": back.count(), "ids": back.select("id").distinct().count(),
                  "months": sorted(r["month"] for r in back.select("month").distinct().collect())}))
"""


def test_retried_tasks_write_each_row_once():
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, tempfile.mkdtemp(prefix="tidemark-retry-")],
        capture_output=True, text=True, timeout=600,
    )
    assert out.returncode == 0, out.stderr[-3000:]
    result = json.loads(out.stdout.strip().splitlines()[-1])
    assert result == {"rows": 50_000, "ids": 50_000, "months": [1, 2, 3]}
    assert "task lost" in out.stderr  # the failures did happen
