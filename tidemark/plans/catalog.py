"""The registered queries: one per operator of the inventory, on the driver's tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame. Queries that
need a monthly table read ``orders`` stored by month (``monthly_orders``);
queries that change a table write their own copy first. ``ORACLE_SQL`` holds
the same result as DuckDB SQL over the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import Period, in_period, month_end, month_end_date, period_columns, period_key, period_range, previous, shift_months
from tidemark.functions.types import cast_columns
from tidemark.operators.aggregates import row_count
from tidemark.operators.compare import compare_frames
from tidemark.operators.filters import allow_from, allow_list
from tidemark.operators.lineage import cut_lineage
from tidemark.operators.schema import conform, id_report, stamp_period
from tidemark.plans.chains import Table, backfill_table, external, frame, run, run_chain, source, table
from tidemark.plans.jobs import NAME_COUNTS_SCHEMA, name_counts
from tidemark.plans.joins import lagged_join, multi_lag, wide_table
from tidemark.plans.monthly_orders import orders_schema, orders_table
from tidemark.session import scratch_path
from tidemark.sources import fs
from tidemark.sources.config import config_frame, join_config
from tidemark.sources.inventory import partition_inventory
from tidemark.sources.tables import (
    read_external,
    read_latest_available,
    read_most_recent,
    read_offset,
    read_period,
    read_periods,
    read_table,
    read_trailing,
    read_upto,
)
from tidemark.sources.writes import backfill, backfill_range, clear_period, replace_period, replace_periods

# Fixed values of the queries (run month, allow-list, configuration).
RUN = Period(1998, 2)
EVENTS_RUN = Period(2024, 1)
ALLOWED_EVENT_TYPES = ["click", "purchase", "view"]
SEGMENT_TIERS = {
    "BUILDING": {"tier": "gold", "discount": 3},
    "MACHINERY": {"tier": "silver", "discount": 2},
}
URGENT_PRIORITIES = ["1-URGENT", "2-HIGH"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _counts_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_rows"))


def _orders_per_customer(month: DataFrame) -> DataFrame:
    return month.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))


# --- flagship: allow-list filter + group count + conformed schema -------------

def q_allowlist_count(spark, sf_dir):
    events = read_external(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    names = events.select(F.col("user_id").alias("id"), F.col("event_type").alias("name"))
    return name_counts(names, ALLOWED_EVENT_TYPES)


# --- reads ----------------------------------------------------------------------

def q_month_read(spark, sf_dir):
    root = orders_table(spark, sf_dir)
    return read_period(spark, root, RUN, schema=orders_schema(spark, sf_dir)).select("o_orderkey", "o_custkey", "o_totalprice")


def q_month_read_offset(spark, sf_dir):
    root = orders_table(spark, sf_dir)
    return read_offset(spark, root, RUN, previous(3), schema=orders_schema(spark, sf_dir)).select("o_orderkey", "o_custkey", "o_totalprice")


def q_external_read(spark, sf_dir):
    root = orders_table(spark, sf_dir)
    return (
        read_external(spark, root, schema=orders_schema(spark, sf_dir))
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"))
    )


def q_partition_inventory(spark, sf_dir):
    """S4: months, their files and completeness from listings; one month's marker is gone."""
    root = orders_table(spark, sf_dir, copy="inventory")
    fs.delete(spark, f"{root}/year=1998/month=1/_SUCCESS")
    return partition_inventory(spark, root).select("year", "month", (F.col("n_files") > 0).cast("int").alias("has_files"), "complete")


def q_inventory_files(spark, sf_dir):
    """S4: the number of files and rows of three months, one of them emptied; months this small are one file each."""
    root = scratch_path(spark, "inventory")
    months = orders_table(spark, sf_dir)
    schema = orders_schema(spark, sf_dir)
    for month in (9, 10, 11):
        rows = read_period(spark, months, (1997, month), schema=schema)
        replace_period(rows.where(F.lit(month != 10)), root, (1997, month))
    return partition_inventory(spark, root, rows=True)


def q_schema_drift_read(spark, sf_dir):
    """S1-S7: a column that only later months have is kept, null before; once merged, once declared."""
    root = scratch_path(spark, "drift")
    months, schema = orders_table(spark, sf_dir), orders_schema(spark, sf_dir)
    old = read_period(spark, months, (1997, 11), schema=schema).select("o_orderkey", "o_totalprice")
    new = read_period(spark, months, (1997, 12), schema=schema).select("o_orderkey", "o_totalprice", "o_orderstatus")
    replace_period(old, root, (1997, 11))
    replace_period(new, root, (1997, 12))
    declared = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])
    merged = read_upto(spark, root, RUN).select("o_orderkey", "o_orderstatus", "year", "month", F.lit("merged").alias("how"))
    return merged.unionByName(read_periods(spark, root, [(1997, 11), (1997, 12), (1998, 1)], schema=declared).withColumn("how", F.lit("declared")))


def q_stored_schema_read(spark, sf_dir):
    """P4 for S1-S7: columns noted by the writers; a later month has one more. No footer is opened to find them."""
    root = scratch_path(spark, "stored-schema")
    months, schema = orders_table(spark, sf_dir), orders_schema(spark, sf_dir)
    rows = read_upto(spark, months, RUN, schema=schema).select("o_orderkey", "o_totalprice", "year", "month")
    replace_periods(rows.where(F.col("year") < 1998), root, period_range((1995, 1), (1997, 12)))
    for month in (1, 2):
        late = read_period(spark, months, (1998, month), schema=schema)
        replace_period(late.select("o_orderkey", "o_totalprice", "o_orderstatus"), root, (1998, month))
    return read_trailing(spark, root, RUN, 3).groupBy("year", "month", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.max("o_orderkey").alias("max_key"))


def q_bounded_periods(spark, sf_dir):
    root = orders_table(spark, sf_dir, gaps=True)
    return _counts_by_month(read_upto(spark, root, RUN, schema=orders_schema(spark, sf_dir)))


def q_trailing_periods(spark, sf_dir):
    root = orders_table(spark, sf_dir, gaps=True)
    return _counts_by_month(read_trailing(spark, root, RUN, 3, schema=orders_schema(spark, sf_dir)))


def q_latest_available(spark, sf_dir):
    root = orders_table(spark, sf_dir, gaps=True)
    return read_latest_available(spark, root, RUN, schema=orders_schema(spark, sf_dir)).select("o_orderkey", "o_totalprice")


def q_most_recent(spark, sf_dir):
    root = orders_table(spark, sf_dir)
    return read_most_recent(spark, root, schema=orders_schema(spark, sf_dir)).select("o_orderkey", "o_totalprice")


def q_config_table_join(spark, sf_dir):
    cfg = config_frame(spark, SEGMENT_TIERS, "segment", "segment string, tier string, discount int")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return join_config(customer, cfg, "c_mktsegment", "segment").select(
        "c_custkey", "c_mktsegment", "tier", "discount"
    )


# --- schema ---------------------------------------------------------------------

def q_typed_schema_cast(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return cast_columns(orders, {"o_orderkey": "StringType", "o_totalprice": "decimal(18,2)", "o_orderdate": "DateType"})


CONFORM_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)


def q_conform_schema(spark, sf_dir):
    root = orders_table(spark, sf_dir)
    return conform(read_period(spark, root, RUN, schema=orders_schema(spark, sf_dir)), CONFORM_SCHEMA)


def q_stamp_period(spark, sf_dir):
    return stamp_period(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), RUN)


# --- joins ----------------------------------------------------------------------

def q_wide_table(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    spine = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        "c_custkey", "c_mktsegment", "n_name"
    )
    per_customer = (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price"))
    )
    return wide_table(spine, "c_custkey", [per_customer])


def q_wide_table_many(spark, sf_dir):
    """J1 with five features of customers, from four aggregates and a plain frame; one fold, one join."""
    customer = _table(spark, sf_dir, "customer")
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    count = F.count(F.lit(1))
    features = [orders.where(F.col("o_orderstatus") == s).groupBy("c_custkey").agg(count.alias(f"n_{s.lower()}"), F.max("o_orderkey").alias(f"last_{s.lower()}")) for s in "FOP"]
    features.append(orders.groupBy("c_custkey").agg(F.max("o_totalprice").alias("top_price"), F.min("o_orderpriority").alias("top_priority")))
    features.append(customer.where("c_acctbal < 0").select("c_custkey", F.col("c_acctbal").alias("debt")))
    return wide_table(customer.select("c_custkey", "c_mktsegment"), "c_custkey", features)


def q_multi_lag(spark, sf_dir):
    """J2 with three lags for a quarter of run months: one shuffle of the orders, no join."""
    orders = read_table(spark, orders_table(spark, sf_dir), schema=orders_schema(spark, sf_dir))
    values = {"n_orders": (F.count, F.lit(1)), "top_price": (F.max, F.col("o_totalprice"))}
    return multi_lag(orders, "o_custkey", [1, 2, 6], values, period_range((1997, 12), RUN))


def q_lagged_join(spark, sf_dir):
    root, schema = orders_table(spark, sf_dir), orders_schema(spark, sf_dir)
    now, lag = (_orders_per_customer(read_offset(spark, root, RUN, k, schema=schema)) for k in (0, previous(2)))
    return lagged_join(now, lag, "o_custkey").withColumn("n_orders_lag", F.coalesce("n_orders_lag", F.lit(0).cast("long")))


_BY_MONTH = ["o_custkey", "year", "month"]


def customer_chain(spark, sf_dir, stored=False):
    """Customers that lapsed: three months ago they ordered, last month they were not on a streak.

    ``spend`` counts a customer's orders in a month; ``streak`` holds those who
    ordered in a month and in the one before; ``lapsed`` reads ``spend`` three
    months back and ``streak`` one month back, so ``spend`` is reached at lags 1, 2 and 3.
    """
    root = (lambda name: scratch_path(spark, name)) if stored else (lambda name: None)
    orders = source("orders", orders_table(spark, sf_dir), orders_schema(spark, sf_dir))
    count = F.count(F.lit(1)).alias("n_orders")
    spend = table(
        "spend",
        lambda p, month: month.groupBy("o_custkey").agg(count),
        [orders.at(0)],
        root=root("spend"),
        build_range=lambda months: months.groupBy("o_custkey", "year", "month").agg(count),
    )
    streak = table(
        "streak",
        lambda p, now, before: now.join(before.select("o_custkey"), "o_custkey", "left_semi"),
        [spend.at(0), spend.at(1)],
        root=root("streak"),
        build_range=lambda now, before: now.join(before.select(*_BY_MONTH), _BY_MONTH, "left_semi"),
    )
    return table(
        "lapsed",
        lambda p, then, on: then.join(on.select("o_custkey"), "o_custkey", "left_anti").select("o_custkey", "n_orders"),
        [spend.at(3), streak.at(1)],
        root=root("lapsed"),
        build_range=lambda then, on: then.join(on.select(*_BY_MONTH), _BY_MONTH, "left_anti"),
    )


def q_lagged_chain(spark, sf_dir):
    return frame(spark, customer_chain(spark, sf_dir), RUN)


# --- writes ---------------------------------------------------------------------

def q_replace_period(spark, sf_dir):
    root, schema = orders_table(spark, sf_dir, copy="replace"), orders_schema(spark, sf_dir)
    january = Period(1998, 1)
    finished = read_period(spark, root, january, schema=schema).where(F.col("o_orderstatus") == "F")
    replace_period(finished, root, january)
    return read_table(spark, root, schema=schema).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("o_orderkey").alias("max_key")
    )


def q_delete_period(spark, sf_dir):
    root = orders_table(spark, sf_dir, copy="delete")
    clear_period(spark, root, Period(1998, 1))
    return _counts_by_month(read_table(spark, root, schema=orders_schema(spark, sf_dir)))


def q_rerun_period(spark, sf_dir):
    source_root = orders_table(spark, sf_dir)
    root = scratch_path(spark, "rerun")
    for _ in range(2):  # an aggregate of one month: written as it comes out of its shuffle
        month = read_period(spark, source_root, RUN, schema=orders_schema(spark, sf_dir))
        replace_period(_orders_per_customer(month), root, RUN, rebalance=False)
    return read_table(spark, root).select("o_custkey", "n_orders", "year", "month")


def q_backfill_periods(spark, sf_dir):
    source_root = orders_table(spark, sf_dir)
    root = scratch_path(spark, "backfill")
    schema = orders_schema(spark, sf_dir)
    backfill(spark, root, lambda p: _orders_per_customer(read_period(spark, source_root, p, schema=schema)),
             [Period(1997, 10), Period(1997, 11)])
    return read_table(spark, root).select("o_custkey", "n_orders", "year", "month")


# --- functions, comparison, order, lineage --------------------------------------

def q_period_dates(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return orders.select(
        "o_orderkey",
        month_end_date(day).alias("month_end"),
        period_key(F.year("o_orderdate"), F.month("o_orderdate")).alias("period_key"),
        shift_months(day, -1).alias("prev_month_day"),
    )


def q_frame_diff(spark, sf_dir):
    """``orders`` against a copy with known differences, matched on ``o_orderkey``.

    The copy leaves out pending low-priority orders, moves urgent prices by
    1% (others by 1e-7, inside the tolerance) and marks open high-priority
    orders with status ``X``.
    """
    orders = _table(spark, sf_dir, "orders")
    expected = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    generated = orders.where(~((status == "P") & (priority == "5-LOW"))).select(
        "o_orderkey",
        F.when(priority == "1-URGENT", F.col("o_totalprice") * 1.01)
        .otherwise(F.col("o_totalprice") * 1.0000001).alias("o_totalprice"),
        F.when((priority == "2-HIGH") & (status == "O"), F.lit("X")).otherwise(status).alias("o_orderstatus"),
    )
    return compare_frames(expected, generated, keys="o_orderkey")


def q_frame_diff_unkeyed(spark, sf_dir):
    """C1 without keys on two floating columns: noise within the tolerance, which puts rows in another order, and known differences.

    Only priority and status have to be equal, so a group holds thousands of rows. The
    copy leaves out pending low-priority orders and moves urgent prices by 1%.
    """
    orders = _table(spark, sf_dir, "orders")
    expected = orders.select("o_orderpriority", "o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    noise = F.when(priority == "1-URGENT", 1.0).when(F.col("customer") % 2 == 0, 1 + 1e-10).otherwise(1 - 1e-10)
    generated = expected.where(~((status == "P") & (priority == "5-LOW"))).select(
        "o_orderpriority",
        "o_orderstatus",
        (F.when(priority == "1-URGENT", F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice")) * noise).alias("o_totalprice"),
        (F.col("customer") / noise).alias("customer"),
    )
    return compare_frames(expected, generated, rtol=1e-9)


def q_ordered_head(spark, sf_dir):
    return (
        _table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
        .limit(25)
    )


def q_checkpointed_count(spark, sf_dir):
    urgent = allow_list(_table(spark, sf_dir, "orders"), "o_orderpriority", URGENT_PRIORITIES)
    cut = cut_lineage(urgent.select("o_custkey", "o_orderpriority"))
    return cut.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# --- more compositions ----------------------------------------------------------

def name_count_tables(sf_dir: str, root: str) -> Table:
    """The worked job as a chain: an external ``events`` source and a table with a schema."""
    events = external("events", f"{sf_dir.rstrip('/')}/events.parquet")

    def build(p, ev):
        month = ev.where(in_period(ev, "ts", p))
        return name_counts(month.select(F.col("user_id").alias("id"), F.col("event_type").alias("name")),
                           ALLOWED_EVENT_TYPES)

    return table("name_counts", build, [events.at(0)], root=root, schema=NAME_COUNTS_SCHEMA)


def q_allowlist_count_written(spark, sf_dir):
    """The flagship as a monthly job: run for one month, written, read back."""
    job = name_count_tables(sf_dir, scratch_path(spark, "name-counts"))
    run(spark, job, EVENTS_RUN, rebalance=False)  # ends in an aggregate: already sized
    return read_table(spark, job.root)


def q_backfill_periods_range(spark, sf_dir):
    """W4 with a range-aware job: both months from one scan and one aggregate."""
    source_root = orders_table(spark, sf_dir)
    root = scratch_path(spark, "backfill-range")

    def job(periods):
        return read_periods(spark, source_root, periods, schema=orders_schema(spark, sf_dir)).groupBy("o_custkey", "year", "month").agg(
            F.count(F.lit(1)).alias("n_orders")
        )

    backfill_range(spark, root, job, [Period(1997, 10), Period(1997, 11)])
    return read_table(spark, root).select("o_custkey", "n_orders", "year", "month")


def q_lagged_chain_stored(spark, sf_dir):
    """The chain with every (table, month) computed and written once, read back for the next."""
    lapsed = customer_chain(spark, sf_dir, stored=True)
    run_chain(spark, lapsed, RUN)
    return read_period(spark, lapsed.root, RUN)


def q_backfill_table_range(spark, sf_dir):
    """W4: a table of a chain for a whole year from one plan."""
    spend = customer_chain(spark, sf_dir, stored=True).deps[0].table
    backfill_table(spark, spend, period_range((1997, 1), (1997, 12)))
    return read_table(spark, spend.root)


def q_lagged_chain_cut(spark, sf_dir):
    """W5 and K1: nine months of the chain from one plan; ``spend``, which three dependencies read, is computed and stored once."""
    lapsed = customer_chain(spark, sf_dir, stored=True)
    backfill_table(spark, lapsed, period_range((1997, 6), RUN))
    return read_table(spark, lapsed.root)


def q_trailing_backfill(spark, sf_dir):
    """W5 with S6 and S7: ten run months that read by availability, from one plan. January and February are missing."""
    orders = source("orders", orders_table(spark, sf_dir, gaps=True), orders_schema(spark, sf_dir))

    def build(trailing, latest):
        months = trailing.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_orders"), F.min(F.col("own_year") * 100 + F.col("own_month")).alias("since"))
        last = latest.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_latest"), F.max("o_orderkey").alias("max_key"))
        return months.join(last, ["year", "month"])

    recent = table("recent", None, [orders.trailing(2), orders.latest(1)], root=scratch_path(spark, "recent"), build_range=build)
    backfill_table(spark, recent, period_range((1997, 9), (1998, 6)))
    return read_table(spark, recent.root)


def q_allowlist_count_long(spark, sf_dir):
    """a list of 20,000 order keys, given as text keys would be after a config load: as floats, in another case."""
    keys = [float(k) for k in range(1, 40_001, 2)]
    picked = allow_list(_table(spark, sf_dir, "orders"), "O_ORDERKEY", keys)
    return picked.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("max_key"))


def q_allow_from(spark, sf_dir):
    """the allowed values come from a frame; a semi join."""
    building = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return group_count_by_status(allow_from(_table(spark, sf_dir, "orders"), "o_custkey", building, "c_custkey"))


def group_count_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))


def q_row_count(spark, sf_dir):
    return row_count(_table(spark, sf_dir, "lineitem"))


def q_frame_diff_types(spark, sf_dir):
    """C1 on mixed types: decimals exact, whole numbers against floats unrounded, infinities unequal to all else."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    price = F.col("o_totalprice").cast("decimal(18,2)")
    expected = orders.select("o_orderkey", price.alias("price"), "o_custkey", F.col("o_totalprice").alias("total"))
    generated = orders.select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"),
        F.when(urgent, price + F.lit(0.01).cast("decimal(18,2)")).otherwise(price).cast("decimal(20,3)").alias("price"),
        (F.col("o_custkey") + F.when(high, 0.5).otherwise(0.0)).alias("o_custkey"),
        F.when(urgent, float("inf")).otherwise(F.col("o_totalprice")).alias("total"),
    )
    return compare_frames(expected, generated, keys="o_orderkey")


def q_month_end_time(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", month_end("ts").alias("month_end_ts"))


def q_id_report(spark, sf_dir):
    return id_report(_table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")


def q_supplier_months(spark, sf_dir):
    """W4 on the largest table: per supplier and ship month, every month in one job."""
    lineitem = _table(spark, sf_dir, "lineitem").withColumns(period_columns("l_shipdate"))
    per_month = lineitem.groupBy("l_suppkey", "year", "month").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("l_orderkey").alias("n_orders"),
        F.max("l_quantity").alias("max_qty"),
    )
    root = scratch_path(spark, "supplier-months")
    replace_periods(per_month, root)
    return read_table(spark, root)


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Fresh copies for the queries that change their table (the bench builds them outside the timing)."""
    for copy in ("replace", "delete", "inventory"):
        orders_table(spark, sf_dir, copy=copy, fresh=True)


QUERIES = {
    "allowlist_count": q_allowlist_count,
    "month_read": q_month_read,
    "month_read_offset": q_month_read_offset,
    "external_read": q_external_read,
    "partition_inventory": q_partition_inventory,
    "latest_available": q_latest_available,
    "trailing_periods": q_trailing_periods,
    "config_table_join": q_config_table_join,
    "typed_schema_cast": q_typed_schema_cast,
    "conform_schema": q_conform_schema,
    "stamp_period": q_stamp_period,
    "wide_table": q_wide_table,
    "wide_table_many": q_wide_table_many,
    "lagged_join": q_lagged_join,
    "multi_lag": q_multi_lag,
    "replace_period": q_replace_period,
    "delete_period": q_delete_period,
    "rerun_period": q_rerun_period,
    "backfill_periods": q_backfill_periods,
    "lagged_chain": q_lagged_chain,
    "period_dates": q_period_dates,
    "frame_diff": q_frame_diff,
    "frame_diff_unkeyed": q_frame_diff_unkeyed,
    "ordered_head": q_ordered_head,
    "checkpointed_count": q_checkpointed_count,
    "most_recent": q_most_recent,
    "bounded_periods": q_bounded_periods,
    "allowlist_count_written": q_allowlist_count_written,
    "backfill_periods_range": q_backfill_periods_range,
    "lagged_chain_stored": q_lagged_chain_stored,
    "lagged_chain_cut": q_lagged_chain_cut,
    "trailing_backfill": q_trailing_backfill,
    "month_end_time": q_month_end_time,
    "id_report": q_id_report,
    "supplier_months": q_supplier_months,
    "inventory_files": q_inventory_files,
    "schema_drift_read": q_schema_drift_read,
    "stored_schema_read": q_stored_schema_read,
    "allowlist_count_long": q_allowlist_count_long,
    "allow_from": q_allow_from,
    "row_count": q_row_count,
    "frame_diff_types": q_frame_diff_types,
    "backfill_table_range": q_backfill_table_range,
}

_PER_MONTH = (
    "SELECT o_custkey, year(o_orderdate)*12 + month(o_orderdate) - 1 AS m, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2"
)
_FEATURES = " ".join(
    f"LEFT JOIN (SELECT o_custkey, count(*) AS n_{x}, max(o_orderkey) AS last_{x} FROM orders WHERE o_orderstatus = '{x.upper()}' "
    f"GROUP BY 1) {x} ON {x}.o_custkey = c_custkey"
    for x in "fop"
)
_GAPS = "(SELECT * FROM orders WHERE month(o_orderdate) NOT IN (1, 2))"

ORACLE_SQL = {
    "allowlist_count": "SELECT user_id AS id, event_type AS name, count(*) AS count FROM events "
    "WHERE event_type IN ('click','purchase','view') GROUP BY user_id, event_type",
    "month_read": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1998-02-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00'",
    "month_read_offset": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1997-11-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-12-01 00:00:00'",
    "external_read": "SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys "
    "FROM orders GROUP BY o_orderstatus",
    "partition_inventory": "SELECT cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, "
    "1 AS has_files, NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 1) AS complete FROM orders GROUP BY 1, 2, 4",
    "inventory_files": "SELECT 1997 AS year, m AS month, cast(m <> 10 AS bigint) AS n_files, true AS complete, "
    "(SELECT count(*) FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = m AND m <> 10) AS n_rows "
    "FROM (SELECT unnest([9, 10, 11]) AS m)",
    "schema_drift_read": "SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 THEN o_orderstatus END AS o_orderstatus, "
    "1997 AS year, cast(month(o_orderdate) AS int) AS month, how FROM orders, (SELECT unnest(['merged', 'declared']) AS how) "
    "WHERE o_orderdate >= TIMESTAMP '1997-11-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
    "stored_schema_read": "SELECT cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, "
    "CASE WHEN year(o_orderdate) = 1998 THEN o_orderstatus END AS o_orderstatus, count(*) AS n_rows, max(o_orderkey) AS max_key "
    "FROM orders WHERE o_orderdate >= TIMESTAMP '1997-11-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00' GROUP BY 1, 2, 3",
    "allowlist_count_long": "SELECT o_orderstatus, count(*) AS n_orders, max(o_orderkey) AS max_key FROM orders "
    "WHERE o_orderkey BETWEEN 1 AND 40000 AND o_orderkey % 2 = 1 GROUP BY 1",
    "allow_from": "SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "row_count": "SELECT count(*) AS n_rows FROM lineitem",
    "frame_diff_types": "SELECT '<rows>' AS column_name, 0 AS n_diff UNION ALL "
    "SELECT 'price', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL "
    "SELECT 'o_custkey', count(*) FROM orders WHERE o_orderpriority = '2-HIGH' AND abs(0.5) > 1e-8 + 1e-5 * abs(o_custkey + 0.5) UNION ALL "
    "SELECT 'total', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'",
    "backfill_table_range": "SELECT o_custkey, count(*) AS n_orders, 1997 AS year, cast(month(o_orderdate) AS int) AS month "
    "FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 4",
    "latest_available": f"SELECT o_orderkey, o_totalprice FROM {_GAPS} g WHERE date_trunc('month', o_orderdate) = "
    f"(SELECT max(date_trunc('month', o_orderdate)) FROM {_GAPS} h WHERE o_orderdate < TIMESTAMP '1998-03-01 00:00:00')",
    "trailing_periods": f"WITH g AS {_GAPS}, p AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM g "
    "WHERE o_orderdate < TIMESTAMP '1998-03-01 00:00:00'), k AS (SELECT m FROM p ORDER BY m DESC LIMIT 4) "
    "SELECT cast(year(m) AS int) AS year, cast(month(m) AS int) AS month, count(*) AS n_rows "
    "FROM g JOIN k ON date_trunc('month', g.o_orderdate) = k.m GROUP BY 1, 2",
    "config_table_join": "SELECT c_custkey, c_mktsegment, tier, discount FROM customer JOIN "
    "(SELECT 'BUILDING' AS segment, 'gold' AS tier, 3 AS discount UNION ALL SELECT 'MACHINERY', 'silver', 2) cfg "
    "ON c_mktsegment = cfg.segment",
    "typed_schema_cast": "SELECT cast(o_orderkey AS string) AS o_orderkey, cast(o_totalprice AS decimal(18,2)) AS o_totalprice, "
    "cast(o_orderdate AS date) AS o_orderdate FROM orders",
    "conform_schema": "SELECT o_orderkey, o_orderstatus, cast(NULL AS string) AS channel FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1998-02-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00'",
    "stamp_period": "SELECT c_custkey, c_mktsegment, 1998 AS year, 2 AS month FROM customer",
    "wide_table": "SELECT c.c_custkey, c.c_mktsegment, n.n_name, a.n_orders, a.max_price FROM customer c "
    "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, "
    "max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey",
    "wide_table_many": f"SELECT c_custkey, c_mktsegment, n_f, last_f, n_o, last_o, n_p, last_p, top_price, top_priority, "
    f"CASE WHEN c_acctbal < 0 THEN c_acctbal END AS debt FROM customer {_FEATURES} "
    "LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top_price, min(o_orderpriority) AS top_priority FROM orders GROUP BY 1) t ON t.o_custkey = c_custkey",
    "multi_lag": f"WITH s AS ({_PER_MONTH}) SELECT s.o_custkey, cast(s.m // 12 AS int) AS year, cast(s.m % 12 + 1 AS int) AS month, "
    "s.n AS n_orders, s.top AS top_price, "
    + ", ".join(f"coalesce(l{k}.n, 0) AS n_orders_lag{k}, l{k}.top AS top_price_lag{k}" for k in (1, 2, 6))
    + " FROM s "
    + " ".join(f"LEFT JOIN s l{k} ON l{k}.o_custkey = s.o_custkey AND l{k}.m = s.m - {k}" for k in (1, 2, 6))
    + " WHERE s.m BETWEEN 1997*12 + 11 AND 1998*12 + 1",
    "lagged_chain_cut": f"WITH s AS ({_PER_MONTH}), r AS (SELECT unnest(range(1997*12 + 5, 1998*12 + 2)) AS m) "
    "SELECT s.o_custkey, s.n AS n_orders, cast(r.m // 12 AS int) AS year, cast(r.m % 12 + 1 AS int) AS month FROM r JOIN s ON s.m = r.m - 3 "
    "WHERE NOT (EXISTS (SELECT 1 FROM s a WHERE a.o_custkey = s.o_custkey AND a.m = r.m - 1) "
    "AND EXISTS (SELECT 1 FROM s b WHERE b.o_custkey = s.o_custkey AND b.m = r.m - 2))",
    "trailing_backfill": "WITH g AS (SELECT year(o_orderdate)*12 + month(o_orderdate) - 1 AS m, count(*) AS n, max(o_orderkey) AS k FROM orders "
    "WHERE month(o_orderdate) NOT IN (1, 2) GROUP BY 1), r AS (SELECT unnest(range(1997*12 + 8, 1998*12 + 6)) AS m), "
    "t AS (SELECT r.m, g.n, g.m AS own, row_number() OVER (PARTITION BY r.m ORDER BY g.m DESC) AS i FROM r JOIN g ON g.m <= r.m), "
    "l AS (SELECT r.m, max(g.m) AS own FROM r JOIN g ON g.m <= r.m - 1 GROUP BY 1) "
    "SELECT cast(t.m // 12 AS int) AS year, cast(t.m % 12 + 1 AS int) AS month, cast(sum(t.n) AS bigint) AS n_orders, "
    "cast(min(t.own // 12 * 100 + t.own % 12 + 1) AS int) AS since, g.n AS n_latest, g.k AS max_key "
    "FROM t JOIN l ON l.m = t.m JOIN g ON g.m = l.own WHERE t.i <= 3 GROUP BY t.m, g.n, g.k",
    "lagged_join": "SELECT a.o_custkey, a.n AS n_orders, coalesce(b.n, 0) AS n_orders_lag FROM (SELECT o_custkey, count(*) AS n "
    "FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00' "
    "GROUP BY 1) a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-01 00:00:00' "
    "AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1) b ON a.o_custkey = b.o_custkey",
    "replace_period": "SELECT cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, "
    "count(*) AS n_rows, max(o_orderkey) AS max_key FROM orders WHERE NOT (year(o_orderdate) = 1998 AND "
    "month(o_orderdate) = 1 AND o_orderstatus <> 'F') GROUP BY 1, 2",
    "delete_period": "SELECT cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, "
    "count(*) AS n_rows FROM orders WHERE NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 1) GROUP BY 1, 2",
    "rerun_period": "SELECT o_custkey, count(*) AS n_orders, 1998 AS year, 2 AS month FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1998-02-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00' GROUP BY o_custkey",
    "backfill_periods": "SELECT o_custkey, count(*) AS n_orders, cast(year(o_orderdate) AS int) AS year, "
    "cast(month(o_orderdate) AS int) AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' "
    "AND o_orderdate < TIMESTAMP '1997-12-01 00:00:00' GROUP BY 1, 3, 4",
    "lagged_chain": "WITH spend AS (SELECT o_custkey, 1998*12 + 1 - (year(o_orderdate)*12 + month(o_orderdate) - 1) AS lag, count(*) AS n_orders "
    "FROM orders GROUP BY 1, 2) SELECT o_custkey, n_orders FROM spend WHERE lag = 3 AND o_custkey NOT IN "
    "(SELECT o_custkey FROM spend WHERE lag = 1 INTERSECT SELECT o_custkey FROM spend WHERE lag = 2)",
    "period_dates": "SELECT o_orderkey, last_day(cast(o_orderdate AS date)) AS month_end, "
    "concat(cast(year(o_orderdate) AS string), '.', lpad(cast(month(o_orderdate) AS string), 2, '0')) AS period_key, "
    "cast(cast(o_orderdate AS date) - INTERVAL '1' MONTH AS date) AS prev_month_day FROM orders",
    "frame_diff": "WITH e AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders), g AS (SELECT o_orderkey, "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 1.01 ELSE o_totalprice * 1.0000001 END AS o_totalprice, "
    "CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus "
    "FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')), "
    "j AS (SELECT e.o_orderkey AS ek, g.o_orderkey AS gk, e.o_totalprice AS ep, "
    "g.o_totalprice AS gp, e.o_orderstatus AS es, g.o_orderstatus AS gs FROM e FULL OUTER JOIN g ON e.o_orderkey = g.o_orderkey) "
    "SELECT '<rows>' AS column_name, count(*) AS n_diff FROM j WHERE ek IS NULL OR gk IS NULL UNION ALL "
    "SELECT 'o_totalprice', count(*) FROM j WHERE ek IS NOT NULL AND gk IS NOT NULL AND NOT "
    "(abs(ep - gp) <= 1e-8 + 1e-5 * abs(gp)) UNION ALL SELECT 'o_orderstatus', count(*) FROM j "
    "WHERE ek IS NOT NULL AND gk IS NOT NULL AND es IS DISTINCT FROM gs",
    "frame_diff_unkeyed": "SELECT '<rows>' AS column_name, count(*) AS n_diff FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' "
    "UNION ALL SELECT 'o_totalprice', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'customer', 0",
    "ordered_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "checkpointed_count": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey, o_orderpriority",
    "most_recent": "SELECT o_orderkey, o_totalprice FROM orders WHERE date_trunc('month', o_orderdate) = "
    "(SELECT max(date_trunc('month', o_orderdate)) FROM orders)",
    "bounded_periods": f"SELECT cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, "
    f"count(*) AS n_rows FROM {_GAPS} g WHERE o_orderdate < TIMESTAMP '1998-03-01 00:00:00' GROUP BY 1, 2",
    "allowlist_count_written": "SELECT user_id AS id, event_type AS name, count(*) AS count, 2024 AS year, 1 AS month "
    "FROM events WHERE event_type IN ('click','purchase','view') AND ts >= TIMESTAMP '2024-01-01 00:00:00' "
    "AND ts < TIMESTAMP '2024-02-01 00:00:00' GROUP BY user_id, event_type",
    "backfill_periods_range": "SELECT o_custkey, count(*) AS n_orders, cast(year(o_orderdate) AS int) AS year, "
    "cast(month(o_orderdate) AS int) AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' "
    "AND o_orderdate < TIMESTAMP '1997-12-01 00:00:00' GROUP BY 1, 3, 4",
    "lagged_chain_stored": "WITH spend AS (SELECT o_custkey, 1998*12 + 1 - (year(o_orderdate)*12 + month(o_orderdate) - 1) AS lag, count(*) AS n_orders "
    "FROM orders GROUP BY 1, 2) SELECT o_custkey, n_orders FROM spend WHERE lag = 3 AND o_custkey NOT IN "
    "(SELECT o_custkey FROM spend WHERE lag = 1 INTERSECT SELECT o_custkey FROM spend WHERE lag = 2)",
    "month_end_time": "SELECT event_id, ts + to_days(CAST(date_diff('day', CAST(ts AS date), last_day(ts)) AS INTEGER)) "
    "AS month_end_ts FROM events",
    "supplier_months": "SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders, "
    "max(l_quantity) AS max_qty, cast(year(l_shipdate) AS int) AS year, cast(month(l_shipdate) AS int) AS month "
    "FROM lineitem GROUP BY l_suppkey, 5, 6",
    "id_report": "SELECT count(*) AS n_rows, count(*) - count(o_custkey) AS n_null_ids, (SELECT count(*) FROM "
    "(SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d) AS n_duplicated_ids "
    "FROM orders",
}
