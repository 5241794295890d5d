"""The worked monthly job: counts per person of the names on an allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators.aggregates import group_count
from tidemark.operators.filters import allow_list
from tidemark.operators.schema import conform, declare_schema

# The columns of the worked job's result.
NAME_COUNTS_SCHEMA = declare_schema(
    T.StructType(
        [
            T.StructField("id", T.LongType(), True),
            T.StructField("name", T.StringType(), True),
            T.StructField("count", T.LongType(), True),
        ]
    )
)


def name_counts(names: DataFrame, allowed_names: "Sequence[str] | None") -> DataFrame:
    """Rows per ``(id, name)`` for allowed names, conformed to ``id, name, count``."""
    filtered = allow_list(names, "name", allowed_names)
    return conform(group_count(filtered, ["id", "name"]), NAME_COUNTS_SCHEMA)
