"""The README's quick start, run on the driver's events."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidemark as tm
from tests.conftest import SF_SMALL


def test_quickstart(spark, scratch):
    events = tm.external("events", f"{SF_SMALL}/events.parquet")
    root = scratch("purchases")

    # --- as in the README -------------------------------------------------------
    schema = T.StructType([
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("count", T.LongType()),
    ])

    def per_user(period, events_df):
        month = events_df.where(tm.in_period(events_df, "ts", period))
        return tm.group_count(tm.allow_list(month, "event_type", ["purchase", "view"]), ["user_id", "event_type"])

    purchases = tm.table("purchases", per_user, [events.at(tm.current())], root=root, schema=schema)
    tm.run(spark, purchases, "2024-01", rebalance=False)
    tm.backfill_table(spark, purchases, tm.period_range("2024-02", "2024-03"))
    january = tm.read_offset(spark, root, "2024-02", tm.previous(), schema=schema)
    inventory = tm.partition_inventory(spark, root)
    # ------------------------------------------------------------------------------

    raw = spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("event_type").isin("purchase", "view") & (F.date_format("ts", "yyyy-MM") == "2024-01"))
    expected = raw.groupBy("user_id", "event_type").count()
    tm.assert_frames_equal(expected, january, keys=["user_id", "event_type"])
    assert january.count() > 0
    assert [(r["month"], r["complete"]) for r in inventory.orderBy("month").collect()] == [(1, True), (2, True), (3, True)]
