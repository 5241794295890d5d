"""Group counts.

``groupBy().count()`` plans a partial aggregate before the shuffle, so a key
that holds a large share of the rows sends at most one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def group_count(df: DataFrame, keys) -> DataFrame:
    """Rows per key as a long column ``count``; null keys form their own group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("group_count needs at least one key")
    return df.groupBy(*keys).count()


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows as a one-row frame (lazy, unlike ``df.count()``)."""
    return df.groupBy().count().withColumnRenamed("count", "n_rows")
