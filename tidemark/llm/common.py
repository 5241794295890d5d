"""Helpers the operators share: stored intermediate tables, unused column names, running totals."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import scratch_path

# White space between words: space and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back.

    Cuts the lineage: later jobs read files instead of computing the rows
    again, also after an executor was lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 places in a filter, which bounds what ``may_hold`` broadcasts: 16 bytes a word.
FILTER_WORDS = 1 << 18


def may_hold(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` (long) is in the one column of ``wanted``, and few others; rows without a key never are.

    A bitmap of hashed keys is broadcast, FILTER_WORDS rows at most whatever the number of keys;
    a full one lets more rows through, so an exact join has to follow.
    """
    word, place = unused(df.columns, "_word"), unused(df.columns, "_place")

    def placed(of: DataFrame, c: str) -> DataFrame:
        h = F.xxhash64(F.lit("filter"), F.col(c))
        return of.where(F.col(c).isNotNull()).withColumns({word: h.bitwiseAND(F.lit(FILTER_WORDS - 1)), place: F.shiftrightunsigned(h, 58).cast("int")})

    bits = placed(wanted, wanted.columns[0]).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, `{place}`)")).alias("bits"))
    own = placed(df, key)
    met = own.join(F.broadcast(bits.withColumnRenamed(word, "word")), (F.col(word) == F.col("word")) & (F.getbit("bits", F.col(place)) == 1), "left_semi")
    return met.select(df.columns)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    return let(
        F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)),
    )


def word_count(text: Column) -> Column:
    """Number of words of ``words_of`` as a long."""
    return F.size(words_of(text)).cast("long")


def running_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    Rows are dealt to tasks by range of (group, order) and a salt, so a group of
    any size, also one whose rows all tie, is spread over many tasks. Each task's range sums its own rows, and only
    one total per range and group is summed across ranges. ``group`` columns
    must not be null; ``order`` should be total (ties are broken arbitrarily
    but each row counts once). ``value`` must be an integer without nulls.
    """
    part, run, before, salt = (unused(df.columns, c) for c in ("_part", "_run", "_before", "_salt"))
    keys = [F.col(c) for c in [*group, *order, salt]]
    ranged = stored(
        df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn(part, F.spark_partition_id()),
        f"ranges-{out}",
    )
    inside = Window.partitionBy(part, *group).orderBy(*order, salt).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn(run, F.sum(value).over(inside) - F.col(value))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, part).agg(F.sum(value).alias(run))
    offsets = totals.select(*group, part, F.coalesce(F.sum(run).over(earlier), F.lit(0)).alias(before))
    joined = rows.join(offsets, [*group, part])
    return joined.withColumn(out, F.col(run) + F.col(before)).select(*df.columns, out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Local Python workers started elsewhere also find this package (clusters: install it or use --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
