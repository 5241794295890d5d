"""Running totals within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.lineage import cut_lineage


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    Rows are dealt to tasks by range of (group, order) and a salt, so neither a
    group nor a run of rows that tie is tied to one task. Each task sums its
    own range; only one total per range and group is summed across ranges.
    The ranges are stored, so that every later job sees the same ones. Ties
    are ordered arbitrarily, each row counts once. Group columns must not be
    null; ``value`` must be an integer without nulls.
    """
    part, run, before, salt = (f"__{c}_{out}" for c in ("part", "run", "before", "salt"))
    salted = df.withColumn(salt, F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    ranged = cut_lineage(salted.repartitionByRange(*keys, F.col(salt)).withColumn(part, F.spark_partition_id()), name="ranges")
    inside = Window.partitionBy(part, *group).orderBy(*order, salt).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn(run, F.sum(value).over(inside) - F.col(value))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, part).agg(F.sum(value).alias(run))
    offsets = totals.select(*group, part, F.coalesce(F.sum(run).over(earlier), F.lit(0)).alias(before))
    joined = rows.join(offsets, [*group, part])
    return joined.withColumn(out, F.col(run) + F.col(before)).select(*[F.col(f"`{c}`") for c in df.columns], out)
