"""Writing monthly tables: replace months, clear a month, backfill a range.

One month (``replace_period``) is one Spark job that overwrites the month's own
directory through the store's committer. A job that fails leaves the month
without ``_SUCCESS``; running it again is the recovery.

Several months (``replace_periods``) are one Spark job that overwrites the table's
partitions dynamically (``partitionOverwriteMode``): the committer puts the months
that have rows in the place of the old ones when the whole job has succeeded, so a job that
fails leaves the table as it was, and a job may read the table it writes. Requested months
without rows are then cleared apart, and ``_SUCCESS`` is written in each month.
A driver lost in between leaves months without ``_SUCCESS``; running the job
again replaces them all. ``clear_staging`` removes what lost jobs left.

Rows without a year or month, or of a month that was not asked for, fail the
job with the reason; they are checked where the rows are written, without a
pass of their own. A requested month for which there are no rows ends up empty
but marked complete.

Writes of one month are spread evenly over tasks (``rebalance`` hint); writes of
several shuffle on ``(year, month)`` with the same hint: AQE splits a month that
holds a large share of the rows over several tasks and packs small months
together, so files come out near the advisory size.

The rows of each requested month are counted as they are written, and the
table's columns noted (see ``notes``).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import Period, PeriodLike, as_periods, period_index
from tidemark.operators.schema import stamp_period
from tidemark.sources import fs
from tidemark.sources.notes import add_columns, note_rows
from tidemark.sources.tables import available_periods, month_path, month_paths

log = logging.getLogger(__name__)

SUCCESS = "_SUCCESS"


def _checked(df: DataFrame, wanted: "list[Period] | None") -> DataFrame:
    """The frame with int year and month; evaluating the year fails on rows that may not be written."""
    year, month = F.col("year").cast("int"), F.col("month").cast("int")
    good = year.isNotNull() & month.isNotNull()
    if wanted is not None:
        good = good & period_index(year, month).isin([p.index for p in wanted])
    place = F.concat(F.coalesce(year.cast("string"), F.lit("null")), F.lit("-"), F.coalesce(month.cast("string"), F.lit("null")))
    why = "a row has no year or month: " if wanted is None else "a row is of a month that was not requested: "
    checked = F.when(F.coalesce(good, F.lit(False)), year).otherwise(F.raise_error(F.concat(F.lit(why), place)).cast("int"))
    return df.withColumns({"year": checked, "month": month})


def replace_periods(df: DataFrame, root: str, periods: "Iterable[PeriodLike] | None" = None, *,
                    rebalance: bool = True) -> list[Period]:
    """Replace months of the table with the frame's rows for them.

    ``df`` carries integer ``year`` and ``month`` columns. With ``periods``,
    exactly those months are replaced, and a requested month without rows is
    emptied; a row of another month fails the job. Without ``periods``, the
    months that have rows in the frame are replaced; a row without a month
    fails the job. Other months are untouched. Returns the replaced months.

    ``rebalance=False`` skips the sizing shuffle; use it for a frame that
    already comes out of a shuffle in well-sized partitions (an aggregate
    under AQE), where each partition then writes one file per month.
    """
    if "year" not in df.columns or "month" not in df.columns:
        raise ValueError("the frame needs year and month columns; use replace_period for one month")
    wanted = None if periods is None else as_periods(periods)
    if wanted is not None and not wanted:
        raise ValueError("no months requested")
    spark, root = df.sparkSession, root.rstrip("/")
    store = fs.FileStore(spark, root)
    data = _checked(df, wanted)
    if rebalance:
        data = data.hint("rebalance", *([] if wanted is not None and len(wanted) == 1 else ["year", "month"]))
    rows = Observation()
    if wanted is not None:
        index = period_index()
        data = data.observe(rows, *[F.count_if(index == p.index).alias(f"n{p.index}") for p in wanted])
    unfinished = _unfinished(spark, root, store)
    first = not available_periods(spark, root)
    data.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(root)
    # The committer put whole months in place, so those it wrote have no _SUCCESS yet.
    found = _unfinished(spark, root, store)
    written = [p for p, files in found.items() if files and files != unfinished.get(p)]
    counts = None if wanted is None else {p: rows.get[f"n{p.index}"] for p in wanted}
    wanted = written if wanted is None else wanted
    if written:
        add_columns(spark, root, df.schema, new_table=first)

    def finish(p: Period) -> None:
        leaf = month_path(root, p)
        if p not in written:
            log.warning("month %s of %s has no rows; leaving it empty", p, root)
            store.delete(leaf)
            store.mkdirs(leaf)
        elif counts is not None:
            note_rows(store, leaf, counts[p])
        store.touch(f"{leaf}/{SUCCESS}")

    fs.parallel(finish, wanted)
    return wanted


def _unfinished(spark: SparkSession, root: str, store: fs.FileStore) -> dict[Period, set[str]]:
    """The months without ``_SUCCESS``, with their data files."""
    complete = month_paths(spark, root, f"/{SUCCESS}")
    open_ = {p: path for p, path in month_paths(spark, root).items() if p not in complete}
    return dict(zip(open_, fs.parallel(lambda path: set(store.data_files(path)), open_.values()))) if open_ else {}


def replace_period(df: DataFrame, root: str, period: PeriodLike, *, rebalance: bool = True) -> Period:
    """Replace one month of the table with the frame (its own ``year``/``month`` columns are left out)."""
    if df is None:
        raise ValueError("the job returned nothing")
    p, spark, root = Period.of(period), df.sparkSession, root.rstrip("/")
    if fs.reads_from(df, root):  # replaced only when the whole job has succeeded
        replace_periods(stamp_period(df, p), root, [p], rebalance=rebalance)
        return p
    data = df.drop(*[c for c in df.columns if c.lower() in ("year", "month")])
    if rebalance:
        data = data.hint("rebalance")
    rows = Observation()
    leaf, store = month_path(root, p), fs.FileStore(spark, root)
    first = not available_periods(spark, root)
    data.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(leaf)
    if not rows.get["n"]:
        log.warning("month %s of %s has no rows; leaving it empty", p, root)
        fs.parallel(store.delete, store.data_files(leaf))
    else:
        note_rows(store, leaf, rows.get["n"])
        add_columns(spark, root, data.schema, new_table=first)
    if not store.exists(f"{leaf}/{SUCCESS}"):  # committers can be set up not to write it
        store.touch(f"{leaf}/{SUCCESS}")
    return p


def clear_period(spark: SparkSession, root: str, period: PeriodLike) -> bool:
    """Remove one month (that exact month, nothing else); a missing month is a no-op."""
    return fs.delete(spark, month_path(root.rstrip("/"), Period.of(period)))


def clear_staging(spark: SparkSession, root: str) -> list[str]:
    """Remove the directories in which lost jobs kept their months. Only while nobody writes to the table."""
    store = fs.FileStore(spark, root)
    found = store.glob(f"{root.rstrip('/')}/.spark-staging-*")
    fs.parallel(store.delete, found)
    return found


def backfill(
    spark: SparkSession,
    root: str,
    job: Callable[[Period], DataFrame],
    periods: Iterable[PeriodLike],
) -> list[Period]:
    """Run a monthly job for every requested month and write them all in one Spark job.

    ``job(period)`` returns that month's frame (lazy); the frames are stamped
    and unioned, so each month's inputs are read with their own partition
    filters and the whole range is one write. The plan grows with the months;
    ``backfill_range`` keeps it the same for any number.
    """
    wanted = as_periods(periods)
    if not wanted:
        raise ValueError("no months requested")
    frames = []
    for p in wanted:
        out = job(p)
        if out is None:
            raise ValueError(f"the job returned nothing for {p}")
        frames.append(stamp_period(out, p))
    union = frames[0]
    for other in frames[1:]:
        union = union.unionByName(other)
    return replace_periods(union, root, wanted)


def backfill_range(
    spark: SparkSession,
    root: str,
    job: Callable[[list[Period]], DataFrame],
    periods: Iterable[PeriodLike],
) -> list[Period]:
    """Run a range-aware job once for all requested months and write them in one Spark job.

    ``job(periods)`` returns one frame with ``year`` and ``month`` columns for
    all the months (typically grouping by them), so its inputs are scanned
    once instead of once per month. Requested months without rows are emptied.
    """
    wanted = as_periods(periods)
    if not wanted:
        raise ValueError("no months requested")
    out = job(wanted)
    if out is None:
        raise ValueError("the job returned nothing")
    return replace_periods(out, root, wanted)
