"""Joins between monthly frames: wide tables by id, and lagged self joins.

No join here forces a strategy. Features of a wide table are folded into one row per
id before the spine meets them, and the months of a lagged table are moved to
the months that read them before one aggregate puts them side by side, so
the number of shuffles depends neither on the number of features nor of lags.
Small lookup sides are broadcast by Catalyst when their estimated
size is under ``spark.sql.autoBroadcastJoinThreshold``, and AQE re-plans from
runtime sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import PeriodLike, as_periods, period_index
from tidemark.operators.schema import PERIOD_COLUMNS, check_id


def wide_table(spine: DataFrame, id_col: str, features: Sequence[DataFrame]) -> DataFrame:
    """Left-join feature frames to a spine on one id column, then check the id.

    Each feature frame must carry ``id_col`` and hold at most one row per id
    (null ids aside, which join nothing), so that the spine's rows are kept; a
    second row for an id fails the job. All features are tagged, put under each
    other and folded by id in one aggregate, which also counts the rows of each
    feature; the spine then meets one frame, however many features there are. Frames that
    are already aggregated by the id keep their partitioning on the way.
    """
    check_id(spine, id_col)
    taken = set(spine.columns)
    for i, feat in enumerate(features):
        check_id(feat, id_col)
        clash = [c for c in feat.columns if c != id_col and c in taken]
        if clash:
            raise ValueError(f"feature frame {i} repeats columns {clash} of the wide table")
        taken |= set(feat.columns)
    if not features:
        return spine
    return check_id(spine.join(_folded(features, id_col), id_col, "left"), id_col)


def _folded(features: Sequence[DataFrame], id_col: str) -> DataFrame:
    """One row per id with the columns of all features; ids that a feature repeats are an error."""
    values = [[F.col(f"`{c}`") for c in feat.columns if c != id_col] for feat in features]
    types = [feat.select(F.struct(*v)).schema[0].dataType if v else None for feat, v in zip(features, values)]
    key = F.col(f"`{id_col}`")
    tagged = []
    for i, feat in enumerate(features):
        rows = [(F.struct(*values[i]) if i == j else F.lit(None).cast(t)).alias(f"__row{j}") for j, t in enumerate(types) if t is not None]
        tagged.append(feat.where(key.isNotNull()).select(key, F.lit(i).alias("__tag"), *rows))
    both = reduce(DataFrame.unionByName, tagged)
    counts = [F.count_if(F.col("__tag") == i).alias(f"__n{i}") for i in range(len(features))]
    firsts = [F.first(f"__row{j}", ignorenulls=True).alias(f"__row{j}") for j, t in enumerate(types) if t is not None]
    folded = both.groupBy(id_col).agg(*counts, *firsts)
    out = [key]
    for i, (feat, t) in enumerate(zip(features, types)):
        twice = F.raise_error(F.concat(F.lit(f"feature frame {i} has several rows for id "), key.cast("string")))
        if t is None:  # an id alone: nothing to add, but it may not repeat
            out[0] = F.when(F.col(f"__n{i}") <= 1, out[0]).otherwise(twice.cast(feat.schema[id_col].dataType))
            continue
        row = F.when(F.col(f"__n{i}") <= 1, F.col(f"__row{i}")).otherwise(twice.cast(t))
        out += [row.getField(c).alias(c) for c in feat.columns if c != id_col]
    return folded.select(out[0].alias(id_col), *out[1:])


def multi_lag(
    rows: DataFrame,
    keys: "str | Sequence[str]",
    lags: Sequence[int],
    values: Mapping[str, tuple[Callable[[Column], Column], Column]],
    periods: Iterable[PeriodLike],
    *,
    how: str = "left",
) -> DataFrame:
    """Values of several months side by side: per key and run month, each value now and at each lag.

    ``rows`` carries ``year`` and ``month`` of its months. ``values`` gives each
    new column by an aggregate function and what it is taken of, for example
    ``{"n": (F.count, F.lit(1)), "top": (F.max, F.col("price"))}``. The result has the keys, ``year``
    and ``month`` of the run month, ``n``, ``top`` and, per lag k of ``lags``, ``n_lag<k>``, ``top_lag<k>``
    (null, or a count of zero, where that month has no rows of the key). ``how="left"`` keeps the keys
    with rows in the run month itself, ``"full"`` all with rows in any of the months.

    A row goes to the run months that read it and one aggregate with a condition per
    lag does the rest: one shuffle after a partial aggregate, where joins would take one per lag.
    """
    if how not in ("left", "full"):
        raise ValueError(f"unknown way to join {how!r}; use 'left' or 'full'")
    if any(k < 1 for k in lags) or len(set(lags)) != len(lags):
        raise ValueError("lags count months back: whole numbers from 1 on, each once")
    wanted = as_periods(periods)
    if not wanted:
        raise ValueError("no months requested")
    keys = [keys] if isinstance(keys, str) else list(keys)
    steps = [0, *lags]
    runs = [p.index for p in wanted]
    needed = sorted({r - k for r in runs for k in steps})
    # Months that no run month reads are not moved at all; the filter also prunes the scan.
    read = rows.where(period_index().isin(needed))
    names = [f"__v{i}" for i in range(len(values))]
    given = read.select(*keys, period_index().alias("__own"), *[of.alias(n) for n, (_, of) in zip(names, values.values())])
    moved = given.select("*", F.explode(F.array(*map(F.lit, steps))).alias("__lag")).withColumn("__run", F.col("__own") + F.col("__lag")).where(F.col("__run").isin(runs))
    out = []
    for k in steps:
        for n, (name, (fold, _)) in zip(names, values.items()):
            out.append(fold(F.when(F.col("__lag") == k, F.col(n))).alias(f"{name}_lag{k}" if k else name))
    folded = moved.groupBy(*keys, "__run").agg(*out, F.count_if(F.col("__lag") == 0).alias("__now"))
    if how == "left":
        folded = folded.where("__now > 0")
    run = F.col("__run")
    stamped = {"year": F.floor(run / 12).cast("int"), "month": (run % 12 + 1).cast("int")}
    return folded.withColumns(stamped).select(*keys, *PERIOD_COLUMNS, *[c for c in folded.columns if c not in (*keys, "__run", "__now")])


def lagged_join(current: DataFrame, lagged: DataFrame, keys, *, suffix: str = "_lag", how: str = "left") -> DataFrame:
    """Join a month's frame with the same (or another) frame some months earlier.

    Non-key columns of the lagged side get ``suffix``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    renamed = lagged.select(*keys, *[F.col(c).alias(c + suffix) for c in lagged.columns if c not in keys])
    return current.join(renamed, keys, how)
