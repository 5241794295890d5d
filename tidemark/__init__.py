"""tidemark: monthly parquet tables on Spark.

A table is parquet partitioned by integer ``year`` and ``month``; a job is a
function that returns a DataFrame for one month. Everything here is built from
the DataFrame API so Catalyst prunes partitions, pushes filters and picks the
join and aggregate strategies.
"""

from tidemark.functions import (
    Period,
    cast_columns,
    current,
    in_period,
    last_day_of_month,
    month_end,
    period_key,
    period_range,
    previous,
    shift_months,
    spark_type,
)
from tidemark.operators import (
    allow_from,
    allow_list,
    assert_frames_equal,
    check_id,
    compare_frames,
    conform,
    cut_lineage,
    declare_schema,
    group_count,
    id_report,
    row_count,
    stamp_period,
)
from tidemark.plans import backfill_table, external, frame, lagged_join, multi_lag, needed_periods, run, run_chain, source, table, wide_table
from tidemark.session import build_session, clear_scratch, scratch_path, shared_dir
from tidemark.sources import (
    backfill,
    backfill_range,
    clear_period,
    clear_staging,
    config_frame,
    join_config,
    month_directories,
    partition_inventory,
    read_external,
    read_latest_available,
    read_most_recent,
    read_offset,
    read_period,
    read_periods,
    read_table,
    read_trailing,
    read_upto,
    replace_period,
    replace_periods,
    store_schema,
)

__all__ = [
    "Period", "cast_columns", "current", "in_period", "last_day_of_month", "month_end", "period_key",
    "period_range", "previous", "shift_months", "spark_type",
    "allow_from", "allow_list", "assert_frames_equal", "check_id", "compare_frames", "conform", "cut_lineage",
    "declare_schema", "group_count", "id_report", "row_count", "stamp_period",
    "backfill_table", "external", "frame", "lagged_join", "multi_lag", "needed_periods", "run", "run_chain", "source", "table", "wide_table",
    "build_session", "clear_scratch", "scratch_path", "shared_dir",
    "backfill", "backfill_range", "clear_period", "config_frame", "join_config", "month_directories",
    "partition_inventory", "read_external", "read_latest_available", "read_most_recent", "read_offset",
    "read_period", "read_periods", "read_table", "read_trailing", "read_upto", "clear_staging",
    "replace_period", "replace_periods", "store_schema",
]
