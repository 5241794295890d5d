import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import month_start, period_index
from tidemark.operators.aggregates import group_count, row_count
from tidemark.plans.joins import lagged_join, multi_lag, wide_table


def test_lagged_join_suffixes_the_lagged_side(spark):
    now = spark.createDataFrame([(1, 5), (2, 6)], "k long, n long")
    lag = spark.createDataFrame([(1, 3)], "k long, n long")
    out = lagged_join(now, lag, "k")
    assert out.columns == ["k", "n", "n_lag"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, 3), (2, 6, None)]


def test_wide_table_keeps_the_spine_and_rejects_repeated_columns(spark):
    spine = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, s string")
    f1 = spark.createDataFrame([(1, 10.0), (3, 30.0)], "id long, x double")
    f2 = spark.createDataFrame([(2, 7)], "id long, y long")
    out = wide_table(spine, "id", [f1, f2])
    assert out.count() == 3
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10.0, None), (2, "b", None, 7), (3, "c", 30.0, None)]
    with pytest.raises(ValueError):
        wide_table(spine, "id", [spine])
    with pytest.raises(ValueError):
        wide_table(spine, "id", [f1.withColumnRenamed("id", "other")])


def test_wide_table_rejects_a_second_row_for_an_id(spark):
    spine = spark.createDataFrame([(1, "a"), (None, "b")], "id long, s string")
    twice = spark.createDataFrame([(1, 10.0), (1, 20.0)], "id long, x double")
    with pytest.raises(Exception, match="feature frame 0 has several rows for id 1"):
        wide_table(spine, "id", [twice]).collect()
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, None)], "id long, x double")
    assert sorted(map(tuple, wide_table(spine, "id", [nulls]).collect()), key=str) == [(1, "a", None), (None, "b", None)]


def test_wide_table_check_needs_no_other_shuffle(spark):
    spine = spark.range(100).select("id")
    feature = spark.range(1000).groupBy((F.col("id") % 100).alias("id")).agg(F.count("*").alias("n"))
    plan = wide_table(spine, "id", [feature])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_wide_table_shuffles_do_not_grow_with_the_features(spark):
    """Features that are keyed by the id keep their partitioning through the fold; plain frames share one shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spine = spark.range(100).select("id")

        def shuffles(features):
            return wide_table(spine, "id", features)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        keyed = [spark.range(1000).groupBy((F.col("id") % (60 + i)).alias("id")).agg(F.count("*").alias(f"n{i}")) for i in range(6)]
        assert [shuffles(keyed[:n]) for n in (1, 2, 6)] == [2, 3, 7]  # the features' own aggregates and the spine
        plain = [spark.range(100).select("id", F.lit(i).alias(f"x{i}")) for i in range(6)]
        assert shuffles(plain[:1]) == shuffles(plain) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_table_of_odd_features(spark):
    spine = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id long, s string")
    lists = spark.createDataFrame([(1, [1, 2], None), (3, [3], {"k": 1})], "id long, l array<int>, m map<string,int>")
    bare = spark.createDataFrame([(1,), (2,)], "id long")
    odd = spark.createDataFrame([(2, None, 5)], "id int, `a.b` string, `c d` int").withColumn("id", F.col("id").cast("long"))
    out = wide_table(spine, "id", [lists, bare, odd])
    assert out.columns == ["id", "s", "l", "m", "a.b", "c d"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "a", [1, 2], None, None, None), (2, "b", None, None, None, 5), (2, "c", None, None, None, 5), (None, "d", None, None, None, None)], key=str)
    with pytest.raises(Exception, match="feature frame 1 has several rows for id 1"):
        wide_table(spine, "id", [lists, bare.union(bare)]).collect()
    with pytest.raises(Exception, match="feature frame 2 has several rows for id 2"):
        wide_table(spine, "id", [lists, bare, odd.union(odd)]).collect()
    assert wide_table(spine, "id", []).columns == ["id", "s"]


def _months(spark):
    rows = [("a", 2020, 11, 5.0), ("a", 2020, 11, 7.0), ("a", 2021, 1, 1.0), ("b", 2020, 12, 2.0), ("b", 2021, 2, None), (None, 2021, 1, 3.0), (None, 2020, 12, 4.0), ("c", 2019, 1, 9.0)]
    return spark.createDataFrame(rows, "k string, year int, month int, x double")


def test_multi_lag(spark):
    values = {"n": (F.count, F.lit(1)), "x": (F.max, F.col("x"))}
    out = multi_lag(_months(spark), "k", [1, 2], values, [(2021, 1), (2021, 2)])
    assert out.columns == ["k", "year", "month", "n", "x", "n_lag1", "x_lag1", "n_lag2", "x_lag2"]
    want = [("a", 2021, 1, 1, 1.0, 0, None, 2, 7.0), (None, 2021, 1, 1, 3.0, 1, 4.0, 0, None), ("b", 2021, 2, 1, None, 0, None, 1, 2.0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    full = multi_lag(_months(spark), ["k"], [1, 2], {"n": (F.count, F.lit(1))}, [(2021, 1), (2021, 2)], how="full")
    assert ("b", 2021, 1, 0, 1, 0) in set(map(tuple, full.collect())) and full.count() == 6
    for bad in ([0], [-1], [1, 1]):
        with pytest.raises(ValueError):
            multi_lag(_months(spark), "k", bad, values, [(2021, 1)])


def test_multi_lag_shuffles_once(spark):
    for lags in ([1], [1, 2, 3, 4, 5, 6]):
        plan = multi_lag(_months(spark), "k", lags, {"n": (F.count, F.lit(1))}, [(2021, 1), (2021, 2)])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_count" in plan


def test_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, name string")
    got = {(r["id"], r["name"]): r["count"] for r in group_count(df, ["id", "name"]).collect()}
    assert got == {(1, "a"): 2, (None, "b"): 1}
    assert row_count(df).first()["n_rows"] == 3
    with pytest.raises(ValueError):
        group_count(df, [])


def test_month_start_and_index(spark):
    row = spark.createDataFrame([(dt.date(2020, 2, 29), 2020, 2)], "d date, year int, month int").select(
        month_start("d").alias("m"), period_index().alias("p"), F.lit(1).alias("one")
    ).first()
    assert row["m"] == dt.date(2020, 2, 1)
    assert row["p"] == 2020 * 12 + 1
