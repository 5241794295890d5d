"""Spark types by name, and casting a frame from a {column: type name} mapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type class names accepted as plain names, each built
# with no arguments (so "DecimalType" means decimal(10,0)).
SIMPLE_TYPE_NAMES = (
    "NullType",
    "StringType",
    "BinaryType",
    "BooleanType",
    "DateType",
    "TimestampType",
    "TimestampNTZType",
    "DecimalType",
    "DoubleType",
    "FloatType",
    "ByteType",
    "ShortType",
    "IntegerType",
    "LongType",
    "DayTimeIntervalType",
    "YearMonthIntervalType",
    "VariantType",
)


def spark_type(name: "str | T.DataType") -> T.DataType:
    """A Spark type from a class name ("LongType") or a DDL string ("decimal(18,2)").

    A name that is neither raises ``ValueError`` naming it.
    """
    if isinstance(name, T.DataType):
        return name
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"{name!r} names no type")
    text = name.strip()
    if text in SIMPLE_TYPE_NAMES:
        return getattr(T, text)()
    if text.endswith("Type") and text[:1].isupper():
        raise ValueError(f"{name!r} names no type")
    try:
        return T.DataType.fromDDL(text)
    except Exception as exc:  # parse errors come back from the JVM
        raise ValueError(f"{name!r} names no type") from exc


def cast_columns(df: DataFrame, types: Mapping[str, "str | T.DataType"]) -> DataFrame:
    """Cast the named columns, keep the others, keep column order; one ``select``."""
    lower = {c.lower(): c for c in df.columns}
    wanted = {}
    for name, type_name in types.items():
        actual = lower.get(name.lower())
        if actual is None:
            raise ValueError(f"column {name!r} is not in the frame (columns: {df.columns})")
        wanted[actual] = spark_type(type_name)
    return df.select(
        *[F.col(c).cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns]
    )
