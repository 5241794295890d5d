"""Monthly reads, writes, clears, backfills and the partition inventory."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import Period
from tidemark.sources import fs
from tidemark.sources.inventory import completed_periods, partition_inventory
from tidemark.sources.notes import store_schema
from tidemark.sources.tables import (
    month_path,
    read_external,
    read_latest_available,
    read_most_recent,
    read_offset,
    read_period,
    read_periods,
    read_table,
    read_trailing,
    read_upto,
    trailing_periods,
)
from tidemark.sources.writes import backfill, clear_period, clear_staging, replace_period, replace_periods

MONTHS = [(2020, 1), (2020, 8), (2020, 9), (2020, 10), (2020, 11), (2020, 12)]


def _rows(spark, months, per_month=3):
    data = [(y * 100 + m, i, f"v{y}-{m}-{i}", y, m) for (y, m) in months for i in range(per_month)]
    return spark.createDataFrame(data, "k long, i long, v string, year int, month int")


@pytest.fixture
def table(spark, scratch):
    root = scratch("months")
    replace_periods(_rows(spark, MONTHS), root)
    return root


def _month_counts(spark, root):
    return {(r["year"], r["month"]): r["n"] for r in
            read_table(spark, root).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_layout_and_markers(spark, table):
    for y, m in MONTHS:
        assert fs.exists(spark, f"{table}/year={y}/month={m}/_SUCCESS")
    assert not fs.glob(spark, f"{table}/_staging-*")
    assert _month_counts(spark, table) == {p: 3 for p in MONTHS}


def test_month_read_has_no_period_columns(spark, table):
    df = read_period(spark, table, (2020, 9))
    assert df.columns == ["k", "i", "v"]
    assert {r["k"] for r in df.collect()} == {202009}
    withp = read_period(spark, table, (2020, 9), with_period=True)
    assert {(r["year"], r["month"]) for r in withp.collect()} == {(2020, 9)}


def test_missing_month_is_an_error(spark, table):
    with pytest.raises(FileNotFoundError):
        read_period(spark, table, (2020, 5))


def test_offset_across_year_end(spark, table):
    df = read_offset(spark, table, (2021, 2), 4)
    assert {r["k"] for r in df.collect()} == {202010}
    with pytest.raises(ValueError):
        read_offset(spark, table, (2021, 2), -1)


def test_replace_january_leaves_october_to_december(spark, table):
    new = spark.createDataFrame([(7, 7, "new")], "k long, i long, v string")
    replace_period(new, table, (2020, 1))
    counts = _month_counts(spark, table)
    assert counts[(2020, 1)] == 1
    assert counts[(2020, 10)] == counts[(2020, 11)] == counts[(2020, 12)] == 3
    assert [r["v"] for r in read_period(spark, table, (2020, 1)).collect()] == ["new"]


def test_clear_january_leaves_october_to_december(spark, table):
    assert clear_period(spark, table, (2020, 1))
    counts = _month_counts(spark, table)
    assert (2020, 1) not in counts
    assert counts[(2020, 10)] == counts[(2020, 11)] == counts[(2020, 12)] == 3
    assert not clear_period(spark, table, (2020, 1))  # missing month: no-op


def test_first_run_on_a_new_table(spark, scratch):
    root = scratch("fresh")
    replace_period(spark.createDataFrame([(1, 1, "a")], "k long, i long, v string"), root, (1998, 2))
    assert read_table(spark, root).select("year", "month").distinct().collect()[0].asDict() == {"year": 1998, "month": 2}


def test_empty_result_empties_the_month(spark, table):
    empty = spark.createDataFrame([], "k long, i long, v string")
    replace_period(empty, table, (2020, 9))
    assert read_period(spark, table, (2020, 9)).count() == 0
    inv = {(r["year"], r["month"]): r for r in partition_inventory(spark, table, rows=True).collect()}
    assert inv[(2020, 9)]["n_rows"] == 0 and inv[(2020, 9)]["complete"]
    assert inv[(2020, 8)]["n_rows"] == 3


def test_rerun_is_idempotent(spark, scratch):
    root = scratch("rerun")
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k long, i long, v string")
    replace_period(df, root, (1998, 2))
    replace_period(df, root, (1998, 2))
    assert read_table(spark, root).count() == 2


def test_read_and_replace_the_same_month(spark, table):
    same = read_period(spark, table, (2020, 8)).where(F.col("i") < 2)
    replace_period(same, table, (2020, 8))
    assert read_period(spark, table, (2020, 8)).count() == 2


def test_inventory_flags(spark, table):
    fs.delete(spark, f"{table}/year=2020/month=10/_SUCCESS")
    inv = {(r["year"], r["month"]): r for r in partition_inventory(spark, table, rows=True).collect()}
    assert set(inv) == set(MONTHS)
    assert not inv[(2020, 10)]["complete"]
    assert all(inv[p]["complete"] for p in MONTHS if p != (2020, 10))
    assert all(inv[p]["n_rows"] == 3 and inv[p]["n_files"] >= 1 for p in MONTHS)
    assert Period(2020, 10) not in completed_periods(spark, table)


def test_backfill_marks_every_requested_month(spark, scratch, table):
    root = scratch("backfill")

    def job(p):
        return read_period(spark, table, p).where(F.col("i") == 0) if p != Period(2020, 10) else \
            spark.createDataFrame([], "k long, i long, v string")

    done = backfill(spark, root, job, [(2020, 8), (2020, 9), (2020, 10)])
    assert done == [Period(2020, 8), Period(2020, 9), Period(2020, 10)]
    inv = {(r["year"], r["month"]): r for r in partition_inventory(spark, root, rows=True).collect()}
    assert inv[(2020, 8)]["n_rows"] == 1 and inv[(2020, 9)]["n_rows"] == 1
    assert inv[(2020, 10)]["n_rows"] == 0
    assert all(r["complete"] for r in inv.values())


def test_replace_periods_empties_requested_months_without_rows(spark, scratch):
    root = scratch("subset")
    replace_periods(_rows(spark, [(2020, 8)]), root, [(2020, 8), (2020, 2)])
    counts = _month_counts(spark, root)
    assert counts == {(2020, 8): 3}
    assert fs.exists(spark, month_path(root, (2020, 2)) + "/_SUCCESS")


def test_availability_reads(spark, table):
    # months present: 2020-01, 08..12
    assert trailing_periods(spark, table, (2020, 9), 2) == [Period(2020, 1), Period(2020, 8), Period(2020, 9)]
    trailing = read_trailing(spark, table, (2020, 7), 5)
    assert {r["k"] for r in trailing.collect()} == {202001}
    latest = read_latest_available(spark, table, (2020, 7))
    assert {r["k"] for r in latest.collect()} == {202001}
    with pytest.raises(FileNotFoundError):
        read_latest_available(spark, table, (2019, 12))
    assert {r["k"] for r in read_most_recent(spark, table).collect()} == {202012}
    assert {r["month"] for r in read_upto(spark, table, (2020, 9)).collect()} == {1, 8, 9}


def test_trailing_read_scans_only_its_months(spark, table):
    files = read_trailing(spark, table, (2020, 12), 1).inputFiles()
    assert files and all("/year=2020/month=11/" in f or "/year=2020/month=12/" in f for f in files)


def test_month_range_read_prunes_partitions(spark, table):
    plan = read_upto(spark, table, (2020, 9))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_external_read(spark, table, scratch):
    df = read_external(spark, table)
    assert df.count() == 3 * len(MONTHS)
    assert df.select("k", "i").distinct().count() == 3 * len(MONTHS)
    with pytest.raises(FileNotFoundError):
        read_external(spark, scratch("nothing-here"))


def test_read_periods_with_an_empty_month(spark, table):
    replace_period(spark.createDataFrame([], "k long, i long, v string"), table, (2020, 9))
    df = read_periods(spark, table, [(2020, 8), (2020, 9), (2020, 5)])
    assert {(r["year"], r["month"]) for r in df.collect()} == {(2020, 8)}
    only_empty = read_periods(spark, table, [(2020, 9)])
    assert only_empty.count() == 0
    assert set(only_empty.columns) == {"k", "i", "v", "year", "month"}


def test_a_rerun_after_a_lost_driver_replaces_every_month(spark, table, monkeypatch):
    import tidemark.sources.writes as writes

    real_parallel = writes.fs.parallel

    def stop_after_first(fn, items):
        fn(list(items)[0])
        raise RuntimeError("driver lost")

    old = _rows(spark, [(2020, 8), (2020, 9)], per_month=1)
    monkeypatch.setattr(writes.fs, "parallel", stop_after_first)
    with pytest.raises(RuntimeError):
        replace_periods(old, table, [(2020, 8), (2020, 9), (2020, 10)])
    monkeypatch.setattr(writes.fs, "parallel", real_parallel)
    # the run is repeated with newer rows; a month the lost run had emptied gets rows
    replace_periods(_rows(spark, [(2020, 8), (2020, 9), (2020, 10)], per_month=2), table)
    assert clear_staging(spark, table) == []  # the job itself had succeeded, so nothing was left behind
    counts = _month_counts(spark, table)
    assert counts == {(2020, 1): 3, (2020, 8): 2, (2020, 9): 2, (2020, 10): 2, (2020, 11): 3, (2020, 12): 3}
    assert all(fs.exists(spark, f"{table}/year=2020/month={m}/_SUCCESS") for m in (8, 9, 10))
    assert not fs.glob(spark, f"{table}/_staging-*")


@pytest.mark.parametrize("bad", [(None, 8), (2020, None), (None, None)])
def test_rows_without_a_month_fail_the_write(spark, table, bad):
    df = _rows(spark, [(2020, 8)]).unionByName(spark.createDataFrame([(1, 1, "x", *bad)], "k long, i long, v string, year int, month int"))
    for periods in (None, [(2020, 8)]):
        with pytest.raises(Exception, match="no year or month|not requested"):
            replace_periods(df.withColumn("v", F.lit("new")), table, periods)
    assert _month_counts(spark, table) == {p: 3 for p in MONTHS}
    assert read_table(spark, table).where("v = 'new'").count() == 0 and not fs.glob(spark, f"{table}/_staging-*")


def test_rows_of_another_month_fail_the_write(spark, table):
    with pytest.raises(Exception, match="not requested: 2020-9"):
        replace_periods(_rows(spark, [(2020, 8), (2020, 9)], per_month=1), table, [(2020, 8)])
    assert _month_counts(spark, table) == {p: 3 for p in MONTHS}


def test_one_month_is_written_without_a_rename(spark, table):
    assert not hasattr(fs.FileStore, "rename")
    replace_period(spark.createDataFrame([(7, 7, "new")], "k long, i long, v string"), table, (2020, 1))
    assert _month_counts(spark, table)[(2020, 1)] == 1 and fs.exists(spark, f"{table}/year=2020/month=1/_SUCCESS")


def test_reads_from(spark, table, scratch):
    assert fs.reads_from(read_period(spark, table, (2020, 8)).where("i > 0").groupBy("k").count(), table)
    assert fs.reads_from(spark.range(3).join(read_table(spark, table), F.lit(True), "left_semi"), table)
    other = scratch("other")
    replace_periods(_rows(spark, MONTHS), other)
    assert not fs.reads_from(read_table(spark, other), table) and not fs.reads_from(spark.range(3), table)


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("i", T.LongType()), T.StructField("v", T.StringType())])


def test_the_first_month_of_a_table_can_be_empty(spark, scratch):
    root = scratch("first-empty")
    replace_period(spark.createDataFrame([], SCHEMA), root, (2020, 9))
    assert read_period(spark, root, (2020, 9), schema=SCHEMA).columns == ["k", "i", "v"]
    assert read_period(spark, root, (2020, 9), schema=SCHEMA).count() == read_table(spark, root, schema=SCHEMA).count() == 0
    assert read_periods(spark, root, [(2020, 9)], schema=SCHEMA).count() == 0
    with pytest.raises(ValueError, match="schema"):
        read_period(spark, root, (2020, 9))


def test_columns_of_later_months_are_kept(spark, scratch):
    root = scratch("drift")
    replace_period(spark.createDataFrame([(1,)], "a long"), root, (2020, 1))
    replace_period(spark.createDataFrame([(2, "x")], "a long, b string"), root, (2020, 2))
    for df in (read_table(spark, root), read_external(spark, root), read_periods(spark, root, [(2020, 1), (2020, 2)]), read_upto(spark, root, (2020, 2))):
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, None), (2, "x")]
    declared = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    assert sorted(map(tuple, read_period(spark, root, (2020, 1), schema=declared).collect()), key=str) == [(None, 1)]


def test_an_emptied_month_is_not_available(spark, table):
    replace_period(spark.createDataFrame([], SCHEMA), table, (2020, 12))
    assert {r["k"] for r in read_latest_available(spark, table, (2021, 3)).collect()} == {202011}
    assert {r["k"] for r in read_most_recent(spark, table).collect()} == {202011}
    assert trailing_periods(spark, table, (2020, 12), 1) == [Period(2020, 10), Period(2020, 11)]


def test_stray_directories_are_skipped(spark, table):
    from tidemark.sources.inventory import month_directories

    for stray in ("year=2020/month=abc", "year=x/month=1", "year=2020/month=13"):
        fs.mkdirs(spark, f"{table}/{stray}")
        fs.touch(spark, f"{table}/{stray}/_SUCCESS")
    assert len(month_directories(spark, table)) == len(completed_periods(spark, table)) == len(MONTHS)
    assert partition_inventory(spark, table).count() == len(MONTHS)
    replace_periods(_rows(spark, [(2020, 8)], per_month=1), table)
    assert read_period(spark, table, (2020, 8)).count() == 1


def test_month_directories_two_complete_one_not(spark, scratch):
    from tidemark.sources.inventory import month_directories

    root = scratch("layout")
    replace_periods(_rows(spark, [(2020, 8), (2020, 9), (2020, 10)]), root)
    fs.delete(spark, f"{root}/year=2020/month=10/_SUCCESS")
    found = month_directories(spark, root)
    assert [(path.rsplit("/", 2)[-2:], done) for path, done in found] == [
        (["year=2020", "month=8"], True), (["year=2020", "month=9"], True), (["year=2020", "month=10"], False)
    ]
    # clearing the incomplete month leaves the two complete ones
    for path, done in found:
        if not done:
            clear_period(spark, root, Period(2020, 10))
    assert [done for _, done in month_directories(spark, root)] == [True, True]


def test_replace_without_rebalance(spark, table):
    agg = read_period(spark, table, (2020, 8)).groupBy("k").agg(F.count(F.lit(1)).alias("i")).withColumn("v", F.lit("agg"))
    plan_rows = agg.select("k", "i", "v")
    replace_period(plan_rows, table, (2020, 8), rebalance=False)
    assert [tuple(r) for r in read_period(spark, table, (2020, 8)).collect()] == [(202008, 3, "agg")]


def test_months_of_a_lost_job_stay_as_they_were(spark, table):
    """A job that fails after it wrote some files leaves every month as it was, and what it staged can be cleared."""
    late = F.when(F.col("i") == 2, F.raise_error(F.lit("task lost")).cast("string")).otherwise("new")
    with pytest.raises(Exception, match="task lost"):
        replace_periods(_rows(spark, MONTHS).withColumn("v", late), table)
    assert _month_counts(spark, table) == {p: 3 for p in MONTHS}
    assert read_table(spark, table).where("v = 'new'").count() == 0 and len(completed_periods(spark, table)) == len(MONTHS)
    fs.mkdirs(spark, f"{table}/.spark-staging-1")
    assert len(clear_staging(spark, table)) == 1


def test_several_months_that_read_their_own_table(spark, table):
    replace_periods(read_periods(spark, table, [(2020, 8), (2020, 9)]).where("i = 0"), table, [(2020, 8), (2020, 9)])
    assert _month_counts(spark, table) == {p: 1 if p in ((2020, 8), (2020, 9)) else 3 for p in MONTHS}


def test_only_written_months_are_returned(spark, table):
    fs.delete(spark, f"{table}/year=2020/month=11/_SUCCESS")  # left by another run
    assert replace_periods(_rows(spark, [(2020, 8), (2021, 1)]), table) == [Period(2020, 8), Period(2021, 1)]
    assert Period(2020, 11) not in completed_periods(spark, table)
    assert replace_periods(_rows(spark, []), table) == []


def _jobs(spark, group, action):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        action()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_stored_schema_spares_the_job_over_footers(spark, scratch):
    root = scratch("noted")
    months = [(y, m) for y in (2019, 2020) for m in range(1, 13)]
    replace_periods(_rows(spark, months, per_month=1), root)
    replace_period(spark.createDataFrame([(1, "w")], "k long, w string"), root, (2021, 1))
    declared = T.StructType([*SCHEMA.fields, T.StructField("w", T.StringType())])
    for i, read in enumerate((lambda **s: read_table(spark, root, **s), lambda **s: read_period(spark, root, (2020, 5), **s), lambda **s: read_trailing(spark, root, (2021, 3), 30, **s))):
        assert _jobs(spark, f"noted{i}", read) == _jobs(spark, f"declared{i}", lambda: read(schema=declared)) == 0
        assert [c for c in read().columns if c not in ("year", "month")] == ["k", "i", "v", "w"]
    assert read_table(spark, root).where("w = 'w'").count() == 1 and read_table(spark, root).count() == 25
    # Columns of unlike types take the note away; the readers look at the files again.
    replace_period(spark.createDataFrame([(1.5,)], "k double"), root, (2021, 2))
    assert not fs.exists(spark, f"{root}/_schema")
    assert read_period(spark, root, (2021, 2)).columns == ["k"]


def test_a_table_with_data_gets_no_guessed_schema(spark, scratch):
    root = scratch("foreign")
    spark.createDataFrame([(1, 2)], "a long, b long").write.parquet(f"{root}/year=2020/month=1")
    replace_period(spark.createDataFrame([(1,)], "a long"), root, (2020, 2))
    assert not fs.exists(spark, f"{root}/_schema")
    assert read_table(spark, root).columns == ["a", "b", "year", "month"]
    store_schema(spark, root, T.StructType([T.StructField("b", T.LongType(), False)]))
    assert sorted(r["b"] for r in read_table(spark, root).select("b").collect() if r["b"]) == [2]


def test_inventory_rows_come_from_the_notes(spark, table):
    replace_periods(_rows(spark, [(2020, 8)], per_month=5), table, [(2020, 8), (2020, 9)])
    replace_period(_rows(spark, [(2020, 10)], per_month=4).drop("year", "month"), table, (2020, 10))
    store = fs.FileStore(spark, table)
    replace_periods(_rows(spark, MONTHS), table)  # months that were not named are not counted
    assert store.read_text(f"{table}/year=2020/month=8/_rows") is None
    replace_periods(_rows(spark, MONTHS), table, MONTHS)
    noted = partition_inventory(spark, table, rows=True)
    assert "parquet" not in noted._jdf.queryExecution().executedPlan().toString().lower()
    assert {r["n_rows"] for r in noted.collect()} == {3}
    # A note that does not fit the files counts for nothing.
    spark.createDataFrame([(1, 1, "x")], "k long, i long, v string").write.mode("append").parquet(month_path(table, (2020, 8)))
    counted = {(r["year"], r["month"]): r["n_rows"] for r in partition_inventory(spark, table, rows=True).collect()}
    assert counted == {p: 4 if p == (2020, 8) else 3 for p in MONTHS}
