"""Allow-list filters from configuration."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.schema import resolve_column

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_NUMBERS = (int, float, decimal.Decimal)


def _of_type(value, dtype: T.DataType):
    """The value as the column's type has it; None if no value of that type equals it.

    Numbers fit any numeric column; other values must be of the column's own kind.
    """
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(value, _NUMBERS) and not isinstance(value, bool):
        if isinstance(dtype, _INTEGRAL):
            return int(value) if value == value and -(2**63) <= value < 2**63 and value == int(value) else None
        if isinstance(dtype, _FLOATING):
            return float(value)
        if isinstance(dtype, T.DecimalType):
            return decimal.Decimal(str(value))
    kinds = {T.StringType: str, T.DateType: dt.date, T.TimestampType: dt.datetime, T.TimestampNTZType: dt.datetime, T.BinaryType: bytes}
    for spark_kind, python_kind in kinds.items():
        if isinstance(dtype, spark_kind) and isinstance(value, python_kind):
            return value
    raise TypeError(f"the allow-list value {value!r} does not fit a column of type {dtype.simpleString()}")


def _literal(value, dtype: T.DataType) -> "str | None":
    """The value as SQL text of the column's type, which makes a long list one call to the JVM; None for types it is not made for."""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{value}L" if value > -(2**63) else f"({value + 1}L - 1L)"
    if isinstance(value, float) and value - value == 0:
        return f"cast({value!r}D as float)" if isinstance(dtype, T.FloatType) else f"{value!r}D"
    return f"cast(X'{value.encode().hex()}' as string)" if isinstance(value, str) else None


def allow_list(df: DataFrame, column: str, allowed: "Sequence | None") -> DataFrame:
    """Rows whose ``column`` is in ``allowed``. Nulls never match; an empty list keeps nothing.

    One way for a list of any length: an IN predicate of the column's type, which
    reaches the parquet reader. The column is found as Spark resolves names,
    whatever the case. A missing list (``None``) is a configuration error.
    For lists too long for a plan use ``allow_from``.
    """
    if allowed is None:
        raise ValueError(f"no allow-list is configured for column {column!r}")
    if isinstance(allowed, (str, bytes)):
        raise TypeError("the allow-list must be a list of values, not a single string")
    actual = resolve_column(df, column)
    if actual is None:
        raise ValueError(f"column {column!r} is not in the frame (columns: {df.columns})")
    dtype = df.schema[actual].dataType
    values = [_of_type(v, dtype) for v in dict.fromkeys(allowed) if v is not None]
    values = [v for v in values if v is not None]
    texts = [_literal(v, dtype) for v in values]
    if not values or None in texts:
        return df.where(F.col(f"`{actual}`").isin([F.lit(v).cast(dtype) if isinstance(dtype, T.FloatType) else v for v in values]))
    return df.where(F.expr(f"`{actual}` IN ({', '.join(texts)})"))


def allow_from(df: DataFrame, column: str, allowed: DataFrame, allowed_column: "str | None" = None) -> DataFrame:
    """Rows whose ``column`` is among the values of another frame's column (a semi join; Catalyst picks how)."""
    actual = resolve_column(df, column)
    if actual is None:
        raise ValueError(f"column {column!r} is not in the frame (columns: {df.columns})")
    keys = allowed.select(F.col(f"`{allowed_column or column}`").alias("__allowed"))
    return df.join(keys, df[f"`{actual}`"] == keys["__allowed"], "left_semi")
