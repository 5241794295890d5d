"""Hot months and hot keys: split over tasks, never multiplied."""

import time

from pyspark.sql import functions as F

from tidemark.operators.compare import DUPLICATE_KEYS, ROWS, compare_frames
from tidemark.sources import fs
from tidemark.sources.writes import replace_periods


def test_hot_month_is_written_by_several_tasks(spark, scratch):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "512k")
    try:
        n = 240_000
        df = spark.range(n).select(
            "id",
            F.sha2(F.col("id").cast("string"), 256).alias("s"),
            F.lit(2020).alias("year"),
            # a third of all rows in January, the rest over eleven months
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 11 + 2).cast("int").alias("month"),
        ).repartition(8)
        root = scratch("hot-month")
        replace_periods(df, root)
    finally:
        spark.conf.set(key, old)
    hot = len(fs.glob(spark, f"{root}/year=2020/month=1/*.parquet"))
    cold = len(fs.glob(spark, f"{root}/year=2020/month=5/*.parquet"))
    assert hot > 1
    assert hot >= cold
    assert spark.read.parquet(root).count() == n


def test_hot_duplicated_key_does_not_multiply_rows(spark):
    # 20,000 rows on each side share one key: a join would make 400 million pairs.
    e = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.lit("a").alias("s"))
    g = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), F.lit("a").alias("s"))
    t0 = time.time()
    got = {r["column_name"]: r["n_diff"] for r in compare_frames(e, g, "k", report_duplicates=True).collect()}
    assert got == {ROWS: 0, "s": 0, DUPLICATE_KEYS: 1}
    assert time.time() - t0 < 60
