"""Reading and writing monthly parquet tables, and configuration frames."""

from tidemark.sources.config import config_frame, join_config
from tidemark.sources.inventory import completed_periods, month_directories, partition_inventory
from tidemark.sources.notes import noted_schema, store_schema
from tidemark.sources.tables import (
    available_periods,
    listed_periods,
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
from tidemark.sources.writes import (
    backfill,
    backfill_range,
    clear_period,
    clear_staging,
    replace_period,
    replace_periods,
)

__all__ = [
    "config_frame", "join_config", "noted_schema", "store_schema", "completed_periods", "month_directories", "partition_inventory", "available_periods", "listed_periods",
    "month_path", "read_external", "read_latest_available", "read_most_recent", "read_offset",
    "read_period", "read_periods", "read_table", "read_trailing", "read_upto", "trailing_periods",
    "backfill", "backfill_range", "clear_period", "clear_staging", "replace_period", "replace_periods",
]
