"""Which months a table holds, which are complete, and their rows: listings and notes on the driver, no data file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import Period
from tidemark.sources import fs
from tidemark.sources.notes import noted_rows
from tidemark.sources.tables import month_paths, read_periods

SUCCESS = "/_SUCCESS"


def completed_periods(spark: SparkSession, root: str) -> list[Period]:
    """Months holding a ``_SUCCESS`` marker, in order."""
    return list(month_paths(spark, root, SUCCESS))


def month_directories(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """Each month directory of the table with whether it holds ``_SUCCESS``, in time order."""
    complete = set(completed_periods(spark, root))
    return [(path, p in complete) for p, path in month_paths(spark, root).items()]


def partition_inventory(spark: SparkSession, root: str, *, rows: bool = False) -> DataFrame:
    """One row per month directory: ``year, month, n_files, complete``, and ``n_rows`` when asked.

    One listing of the months and one per month, on a few driver threads.
    ``rows=True`` adds the counts that were noted when the months were written (one
    small file each); only months without such a note are counted, in a job
    over their files' footers.
    """
    complete = set(completed_periods(spark, root))
    months = month_paths(spark, root)
    store = fs.FileStore(spark, root)

    def facts(path: str) -> tuple[int, "int | None"]:
        sizes = store.data_sizes(path)
        return len(sizes), noted_rows(store, path, sizes) if rows else None

    found = fs.parallel(facts, months.values())
    listed = [(p.year, p.month, n, p in complete, counted) for p, (n, counted) in zip(months, found)]
    frame = spark.createDataFrame(listed, "year int, month int, n_files long, complete boolean, n_rows long")
    if not rows:
        return frame.drop("n_rows")
    open_ = [p for p, (_, counted) in zip(months, found) if counted is None]
    if not open_:
        return frame
    counts = read_periods(spark, root, open_).groupBy("year", "month").agg(F.count(F.lit(1)).alias("counted"))
    return frame.join(counts, ["year", "month"], "left").select("year", "month", "n_files", "complete", F.coalesce("n_rows", "counted", F.lit(0)).alias("n_rows"))
