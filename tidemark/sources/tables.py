"""Reading monthly tables.

Layout: ``<root>/year=<yyyy>/month=<m>/part-*.parquet`` (month unpadded), the
Hive-style layout Spark's ``partitionBy("year", "month")`` writes.

* Which months a table holds comes from one listing of its month
  directories (``year=*/month=*``) on the driver: metadata only, no file is
  opened. Directories of other names are skipped with a warning.
* A month is available when its directory holds data files; a month that a
  run left empty (complete, without rows) is not.
* The chosen months are read as exactly their own directories (with
  ``basePath`` at the root, so ``year``/``month`` come back as columns): only
  those months are listed and scanned.
* A read of the whole table, or one filtered on ``year``/``month``, goes
  through the root; Catalyst turns the predicate into ``PartitionFilters``.

Every reader takes the table's ``schema`` (with or without the period
columns). With it no file is opened to find the columns, columns a month's
files lack read as null, and a table without any file can be read. Without
it the columns that this library's writers noted beside the table are taken
(``notes``), in the same way. Without a note either, the columns of all files that are
read are merged (``mergeSchema``: one job over their footers), so no month's
column is lost; types that do not fit together are an error.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import Period, PeriodLike, as_periods, period_index, period_of_path
from tidemark.sources import fs
from tidemark.sources.notes import noted_schema

log = logging.getLogger(__name__)

Schema = "T.StructType | None"


def month_path(root: str, period: PeriodLike) -> str:
    p = Period.of(period)
    return f"{root.rstrip('/')}/year={p.year}/month={p.month}"


def stored_schema(schema: T.StructType) -> T.StructType:
    """The schema's columns and, last, the period columns as they are read back."""
    own = [f for f in schema.fields if f.name.lower() not in ("year", "month")]
    return T.StructType([*own, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])


def _load(spark: SparkSession, root: str, paths: list[str], schema: Schema) -> DataFrame:
    schema = noted_schema(spark, root) if schema is None else schema
    if schema is not None:
        full = stored_schema(schema)
        return spark.read.schema(full).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], full)
    return spark.read.option("mergeSchema", "true").option("basePath", root).parquet(*paths)


def month_paths(spark: SparkSession, root: str, below: str = "") -> dict[Period, str]:
    """The paths ``year=*/month=*`` plus ``below`` by month, in order; other names are skipped."""
    out = {}
    for path in fs.glob(spark, f"{root.rstrip('/')}/year=*/month=*{below}"):
        try:
            out[period_of_path(path)] = path
        except ValueError:
            log.warning("ignoring %s: not a year=YYYY/month=M directory", path)
    return dict(sorted(out.items()))


def read_table(spark: SparkSession, root: str, *, schema: Schema = None) -> DataFrame:
    """All months, with integer ``year`` and ``month`` columns."""
    root = root.rstrip("/")
    return _load(spark, root, [root], schema)


def read_period(spark: SparkSession, root: str, period: PeriodLike, *, with_period: bool = False, schema: Schema = None) -> DataFrame:
    """One month. A month that was never written is an error.

    Without ``with_period`` the result has no ``year``/``month`` columns. A
    month that exists but holds no rows reads as an empty frame with the given
    schema, or the columns of the table's other months.
    """
    p, root = Period.of(period), root.rstrip("/")
    leaf = month_path(root, p)
    store = fs.FileStore(spark, root)
    if not store.exists(leaf):
        raise FileNotFoundError(f"month {p} of table {root} does not exist ({leaf})")
    if schema is not None or store.data_files(leaf):
        df = _load(spark, root, [leaf], schema)
    elif available_periods(spark, root):
        df = read_table(spark, root).where(F.lit(False))
    else:
        raise ValueError(f"table {root} holds no rows yet, so its columns are not known; pass its schema")
    return df if with_period else df.drop("year", "month")


def read_offset(spark: SparkSession, root: str, run: PeriodLike, offset: int, *, with_period: bool = False, schema: Schema = None) -> DataFrame:
    """The month ``offset`` months before the run month."""
    if offset < 0:
        raise ValueError("offsets count months back and cannot be negative")
    return read_period(spark, root, Period.of(run).minus(offset), with_period=with_period, schema=schema)


def listed_periods(spark: SparkSession, root: str) -> list[Period]:
    """The months that have a directory in the table, in order (metadata only)."""
    return list(month_paths(spark, root))


def read_periods(spark: SparkSession, root: str, periods: Iterable[PeriodLike], *, schema: Schema = None) -> DataFrame:
    """The given months, with ``year``/``month`` columns; months the table lacks read as nothing.

    Only the months' own directories are listed and scanned.
    """
    root = root.rstrip("/")
    wanted = set(as_periods(periods))
    present = [month_path(root, p) for p in available_periods(spark, root) if p in wanted]
    if present or schema is not None:
        return _load(spark, root, present, schema)
    return read_table(spark, root).where(F.lit(False))


def read_upto(spark: SparkSession, root: str, run: PeriodLike, *, schema: Schema = None) -> DataFrame:
    """Every month up to and including the run month."""
    return read_table(spark, root, schema=schema).where(period_index() <= Period.of(run).index)


def available_periods(spark: SparkSession, root: str, upto: "PeriodLike | None" = None) -> list[Period]:
    """The months that hold data, none after ``upto`` when given (one listing, metadata only)."""
    bound = None if upto is None else Period.of(upto)
    found = month_paths(spark, root, "/[!_.]*")
    return [p for p in found if bound is None or p <= bound]


def trailing_periods(spark: SparkSession, root: str, run: PeriodLike, k: int) -> list[Period]:
    """The last ``k + 1`` available months up to the run month (gaps skipped)."""
    if k < 0:
        raise ValueError("k cannot be negative")
    return available_periods(spark, root, run)[-(k + 1):]


def read_trailing(spark: SparkSession, root: str, run: PeriodLike, k: int, *, schema: Schema = None) -> DataFrame:
    """Rows of the last ``k + 1`` available months up to the run month."""
    return read_periods(spark, root, trailing_periods(spark, root, run, k), schema=schema)


def read_latest_available(spark: SparkSession, root: str, run: PeriodLike, *, schema: Schema = None) -> DataFrame:
    """Rows of the latest available month, never later than the run month."""
    found = trailing_periods(spark, root, run, 0)
    if not found:
        raise FileNotFoundError(f"table {root} has no month up to {Period.of(run)}")
    return read_periods(spark, root, found, schema=schema)


def read_most_recent(spark: SparkSession, root: str, *, schema: Schema = None) -> DataFrame:
    """Rows of the latest available month in the table, whatever the run month.

    Opt-in only: a job reading this can see data from after its run month.
    """
    found = available_periods(spark, root)
    if not found:
        raise FileNotFoundError(f"table {root} has no months")
    log.warning("reading the most recent month %s of %s regardless of the run month", found[-1], root)
    return read_periods(spark, root, found[-1:], schema=schema)


def read_external(spark: SparkSession, root: str, *, schema: Schema = None) -> DataFrame:
    """A table outside the project, all of its partitions read once as one dataset.

    ``schema`` is used as given; without it the columns noted beside the
    table are, or else the files' columns merged.
    """
    if not fs.exists(spark, root):
        raise FileNotFoundError(f"there is nothing to read at {root}")
    months = fs.glob(spark, f"{root.rstrip('/')}/year=*/month=*")
    if len(months) > 1:
        log.warning("external table %s has %d partitions; reading them as one dataset", root, len(months))
    if schema is None:
        noted = noted_schema(spark, root)
        return spark.read.option("mergeSchema", "true").parquet(root) if noted is None else spark.read.schema(stored_schema(noted)).parquet(root)
    return spark.read.schema(schema).parquet(root)
