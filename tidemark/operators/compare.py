"""Comparing two frames on the executors.

Both frames are tagged and unioned, then grouped on the key columns: one
shuffle, no join, so a key repeated on either side never multiplies rows.
The per-key results fold into one global aggregate of counters and come back
as ``(column_name, n_diff)`` rows, one per compared column plus ``<rows>`` for
rows without a partner. Nothing is collected unless the caller asserts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.matching import unmatched
from tidemark.operators.ranks import running_total

ROWS = "<rows>"
DUPLICATE_KEYS = "<duplicate keys>"

# Default tolerance: |e - g| <= atol + rtol * |g|.
RTOL = 1e-5
ATOL = 1e-8

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def _common(name: str, e: T.DataType, g: T.DataType) -> T.DataType:
    """A type that holds the values of both columns; whole numbers, decimals and floats are kept apart where one would be rounded."""
    if e == g:
        return T.DoubleType() if isinstance(e, T.FloatType) else e
    pair = (e, g)
    if all(isinstance(t, _INTEGRAL) for t in pair):
        return T.LongType()
    if all(isinstance(t, _INTEGRAL + _FLOATING) for t in pair):
        return T.DoubleType()
    if all(isinstance(t, _INTEGRAL + (T.DecimalType,)) for t in pair):
        wide = [t if isinstance(t, T.DecimalType) else T.DecimalType(19, 0) for t in pair]
        scale = max(t.scale for t in wide)
        whole = max(t.precision - t.scale for t in wide)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    raise ValueError(
        f"column {name!r} has type {e.simpleString()} in the expected frame and {g.simpleString()} in the generated one"
    )


def _check_columns(expected: DataFrame, generated: DataFrame) -> dict[str, T.DataType]:
    if expected.columns != generated.columns:
        raise ValueError(
            f"the two frames have different columns: {expected.columns} != {generated.columns}"
        )
    return {e.name: _common(e.name, e.dataType, g.dataType) for e, g in zip(expected.schema.fields, generated.schema.fields)}


def _comparable(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def _differs(e: Column, g: Column, dtype: T.DataType, rtol: float, atol: float) -> Column:
    """True when two values differ; null equals null, NaN equals NaN, and infinities equal themselves only."""
    same = e.eqNullSafe(g)
    if isinstance(dtype, _FLOATING):
        infinite = F.lit(float("inf"))
        finite = (F.abs(e) < infinite) & (F.abs(g) < infinite)
        close = finite & (F.abs(e - g) <= F.lit(atol) + F.lit(rtol) * F.abs(g))
        same = same | F.coalesce(close, F.lit(False))
    return ~same


def _paired(
    both: DataFrame, side: str, exact: list[str], floating: list[str], types: dict[str, T.DataType], rtol: float, atol: float
) -> tuple[DataFrame, list[str]]:
    """The rows to compare column by column, and the keys that pair them.

    What has to be equal goes along as two hashes of 64 bits each.
    """
    flags = [F.col(f"`{c}`").isNull() for c in exact]
    whole = [_comparable(F.col(f"`{c}`"), types[c]) for c in exact]
    if len(floating) > 1:
        # A null, a NaN and the infinities equal themselves only.
        odd = [F.coalesce(F.when(F.abs(f"`{c}`") < float("inf"), F.lit("finite")), F.col(f"`{c}`").cast("string"), F.lit("null")) for c in floating]
        hashes = [F.xxhash64(F.lit(seed), *flags, *whole, *odd).alias(f"h{seed}") for seed in (1, 2)]
        numbers = F.array(*[F.when(F.abs(f"`{c}`") < float("inf"), F.col(f"`{c}`").cast("double") + 0.0).otherwise(0.0) for c in floating])
        rows = both.select(*hashes, F.col(side).alias("side"), F.lit(1).cast("long").alias("n"), numbers.alias("values"))
        left = unmatched(rows, len(floating), rtol, atol)
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
        rest = left.select("h1", "h2", F.col("side").alias(side), "values", each.alias("copy")).select("h1", "h2", side, *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(floating)])
    else:
        hashes = [F.xxhash64(F.lit(seed), *flags, *whole).alias(f"h{seed}") for seed in (1, 2)]
        rest = both.select(*hashes, side, *[F.col(f"`{c}`") for c in floating])
    names = dict(zip(floating, [f"__v{i}" for i in range(len(floating))]))
    plain = rest.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), side, *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(1).alias("__one"))
    placed = running_total(plain, ["__h1", "__h2", side], list(names.values()), "__one", "__place").drop("__one")
    return placed.withColumnsRenamed({n: c for c, n in names.items()}), ["__h1", "__h2", "__place"]


def compare_frames(
    expected: DataFrame,
    generated: DataFrame,
    keys: "str | Sequence[str] | None" = None,
    *,
    rtol: float = RTOL,
    atol: float = ATOL,
    report_duplicates: bool = False,
) -> DataFrame:
    """Differences between two frames as ``(column_name, n_diff)``.

    With ``keys``, rows are matched on the keys: ``<rows>`` counts rows with
    no partner, and each other column counts matched keys whose values differ
    (floating columns within the tolerance, all others exactly). A key present
    more than once on a side is not compared column by column; its surplus
    rows count in ``<rows>`` and, when asked, the keys in ``<duplicate keys>``.

    Without keys the frames are compared as multisets of rows. With one floating
    column, rows equal in the others are paired in its order, which finds
    a partner for every row if there is a way to. With several, every row is
    first matched with a row of the other frame that equals it in the other columns and lies
    within the tolerance in each floating one (``operators.matching``: the nearest
    first; where many unlike rows lie within one tolerance, a row can stay
    without a partner that another choice would have found). Rows without such a partner are paired in
    order among those equal in the other columns, and their floating columns counted
    where they differ. The surplus of a frame counts in ``<rows>``. Both ways run jobs
    when they are called and deal hot groups over many tasks. Frames of floating
    columns alone need keys, or a tolerance of zero.

    Columns of different numeric types are compared in a type that holds both.
    """
    types = _check_columns(expected, generated)
    side = "__side"

    def one(df: DataFrame, number: int) -> DataFrame:
        columns = [F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) if f.dataType != types[f.name] else F.col(f"`{f.name}`") for f in df.schema.fields]
        return df.select(*columns).withColumn(side, F.lit(number))

    floating = [c for c, t in types.items() if isinstance(t, _FLOATING)]
    both = one(expected, 0).unionByName(one(generated, 1))
    if keys is None and floating and (rtol or atol):
        exact = [c for c in expected.columns if c not in floating]
        if not exact:
            raise ValueError("without keys, floating columns cannot be matched within a tolerance; pass keys, or rtol=0 and atol=0")
        both, keys = _paired(both, side, exact, floating, types, rtol, atol)
        types = {f.name: f.dataType for f in both.schema.fields}
        columns = [c for c in both.columns if c != side]
    else:
        columns = expected.columns
    n_e = F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("__n_e")
    n_g = F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("__n_g")

    if keys is None:
        grouped = both.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(n_e, n_g)
        totals = grouped.agg(F.coalesce(F.sum(F.abs(F.col("__n_e") - F.col("__n_g"))), F.lit(0)).cast("long").alias("r0"))
        names = [ROWS]
    else:
        keys = [keys] if isinstance(keys, str) else list(keys)
        missing = [k for k in keys if k not in both.columns]
        if missing:
            raise ValueError(f"key columns {missing} are not in the frames")
        values = [c for c in columns if c not in keys]
        firsts = []
        for i, c in enumerate(values):
            v = _comparable(F.col(f"`{c}`"), types[c])
            firsts.append(F.first(F.when(F.col(side) == 0, v), ignorenulls=True).alias(f"__e{i}"))
            firsts.append(F.first(F.when(F.col(side) == 1, v), ignorenulls=True).alias(f"__g{i}"))
        grouped = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(n_e, n_g, *firsts)
        single = (F.col("__n_e") == 1) & (F.col("__n_g") == 1)
        counters = [F.coalesce(F.sum(F.abs(F.col("__n_e") - F.col("__n_g"))), F.lit(0)).cast("long").alias("r0")]
        for i, c in enumerate(values):
            diff = _differs(F.col(f"__e{i}"), F.col(f"__g{i}"), types[c], rtol, atol)
            counters.append(F.count_if(single & diff).alias(f"r{i + 1}"))
        names = [ROWS] + values
        if report_duplicates:
            counters.append(F.count_if((F.col("__n_e") > 1) | (F.col("__n_g") > 1)).alias(f"r{len(values) + 1}"))
            names.append(DUPLICATE_KEYS)
        totals = grouped.agg(*counters)

    rows = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"r{i}").cast("long").alias("n_diff"))
        for i, name in enumerate(names)
    ])
    return totals.select(F.inline(rows))


def assert_frames_equal(
    expected: DataFrame,
    generated: DataFrame,
    keys: "str | Sequence[str] | None" = None,
    *,
    rtol: float = RTOL,
    atol: float = ATOL,
) -> None:
    """Raise ``AssertionError`` naming every column that differs.

    Only the per-column counters reach the driver, so there is no row limit.
    """
    diffs = compare_frames(expected, generated, keys, rtol=rtol, atol=atol, report_duplicates=keys is not None)
    bad = [(r["column_name"], r["n_diff"]) for r in diffs.collect() if r["n_diff"]]
    if bad:
        detail = ", ".join(f"`{name}`: {n}" for name, n in bad)
        raise AssertionError(f"The frames are not equal ({detail}).")
