"""Compositions: wide and lagged joins, dependency chains, the worked job, the query catalog."""

from tidemark.plans.chains import Dependency, Table, backfill_table, external, frame, needed_periods, run, run_chain, source, table
from tidemark.plans.jobs import NAME_COUNTS_SCHEMA, name_counts
from tidemark.plans.joins import lagged_join, multi_lag, wide_table

__all__ = [
    "Dependency", "Table", "backfill_table", "external", "frame", "needed_periods", "run", "run_chain", "source", "table",
    "NAME_COUNTS_SCHEMA", "name_counts", "lagged_join", "multi_lag", "wide_table",
]
