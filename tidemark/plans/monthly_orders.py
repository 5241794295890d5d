"""The driver's ``orders`` table stored as a monthly table (year and month of ``o_orderdate``).

This is the stand-in for a project's monthly tables: every month present in
``orders`` is written by one job into the shared folder. In the ``gaps``
variant January and February of every year are then cleared, to exercise
"last available month" reads. Tables the queries only read are built once per
session and folder; a query that changes a table works on a copy of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.periods import period_columns
from tidemark.session import scratch_path, shared_dir
from tidemark.sources import fs
from tidemark.sources.tables import listed_periods
from tidemark.sources.writes import clear_period, replace_periods

_BUILT: dict[tuple, str] = {}


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").withColumns(period_columns("o_orderdate"))


def orders_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    """The columns of ``orders``, declared to the readers of the monthly table."""
    key = ("schema", sf_dir.rstrip("/"))
    if key not in _BUILT:
        _BUILT[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").schema
    return _BUILT[key]


def build_orders_table(spark: SparkSession, sf_dir: str, gaps: bool = False, root: "str | None" = None) -> str:
    """Write ``orders`` as a monthly table (one job) and return its root."""
    root = root or scratch_path(spark, "orders-gaps" if gaps else "orders")
    replace_periods(orders_frame(spark, sf_dir), root)
    if gaps:
        fs.parallel(lambda p: clear_period(spark, root, p), [p for p in listed_periods(spark, root) if p.month in (1, 2)])
    return root


def orders_table(spark: SparkSession, sf_dir: str, gaps: bool = False, copy: "str | None" = None, fresh: bool = False) -> str:
    """A monthly ``orders`` table, built once per session, folder, variant and copy name.

    Read-only queries share the unnamed copy. A query that changes its table
    names its own copy; ``fresh`` builds that anew, as it was before any change.
    """
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir.rstrip("/"), gaps, copy)
    root = _BUILT.get(key)
    if fresh or root is None or not fs.exists(spark, root):
        name = "-".join(x for x in ("orders", "gaps" if gaps else "", copy or "") if x)
        root = build_orders_table(spark, sf_dir, gaps, root=scratch_path(spark, name))
        _BUILT[key] = root
    return root
