"""Configuration dictionaries as small frames, joined to data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PY_TYPES = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()))


def _infer(values: list) -> T.DataType:
    seen = {type(v) for v in values if v is not None}
    for py, spark_t in _PY_TYPES:
        if seen and seen <= {py}:
            return spark_t
    if seen and seen <= {int, float}:
        return T.DoubleType()
    return T.StringType()


def config_frame(
    spark: SparkSession,
    entries: Mapping[str, Mapping],
    first_column: str,
    schema: "str | T.StructType | None" = None,
) -> DataFrame:
    """A dict of dicts as a frame: the outer key in ``first_column``, inner keys as columns.

    Columns come in first-seen key order; values are placed by key, and every
    entry must have every key. Without a schema, column types are inferred
    from the Python values (all-int -> long, strings -> string, ...).
    """
    header: list[str] = []
    for inner in entries.values():
        for key in inner:
            if key not in header:
                header.append(key)
    rows = []
    for outer, inner in entries.items():
        missing = [k for k in header if k not in inner]
        if missing:
            raise ValueError(f"entry {outer!r} has no value for {missing}")
        rows.append((outer, *[inner[k] for k in header]))
    if schema is None:
        cols = list(zip(*rows)) if rows else [[] for _ in range(len(header) + 1)]
        schema = T.StructType(
            [T.StructField(first_column, T.StringType(), True)]
            + [T.StructField(name, _infer(list(cols[i + 1])), True) for i, name in enumerate(header)]
        )
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T.DataType.fromDDL(schema)
    names = [f.name for f in schema.fields]
    if names != [first_column, *header]:
        raise ValueError(f"schema columns {names} do not match {[first_column, *header]}")
    return spark.createDataFrame(rows, schema)


def join_config(df: DataFrame, config: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Join a configuration frame on one key; the key comes back once, as ``left_on``.

    Where an outer join keeps configuration entries that no row has, the key
    is the entry's. Catalyst decides how to join, from the frames' sizes.
    """
    key = "__config_key"
    side = config.withColumnRenamed(right_on, key)
    joined = df.join(side, df[left_on] == side[key], how)
    if key not in joined.columns:  # semi and anti joins
        return joined
    columns = [F.coalesce(df[left_on], side[key]).alias(left_on) if c == left_on else F.col(f"`{c}`") for c in joined.columns if c != key]
    return joined.select(*columns)
