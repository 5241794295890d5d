"""Connected components of an edge list, and splitting large buckets into cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every node with an edge to another node, the smallest node it can reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    the edges no longer change; then each node points at its smallest one. The
    steps are minimums and joins: a node with any number of neighbours is never
    gathered in one place. Each round is stored. Edges with a null end are ignored.
    """
    current = stored(
        edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before, mark = None, _mark(current)
    while mark != before and mark[0]:
        both = current.union(current.select("v", "u"))
        nearest = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "nearest")
        large = stored(both.join(nearest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(current)
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


CELL = ["bucket", "cell_i", "cell_j"]


def by_cell(rows: DataFrame) -> DataFrame:
    """The rows of each cell in one task, one after the other."""
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other, from what ``by_cell`` put in order; only one cell is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CELL], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[begin].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column of numbers, or of lists of equal length as rows of a matrix."""
    array = table.column(column).combine_chunks()
    if pa.types.is_list(array.type):
        return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)
    return array.to_numpy(zero_copy_only=False)


def cells(rows: DataFrame, bucket: str, id: str, weight: Column, most: int) -> DataFrame:
    """``rows`` copied to the cells of their bucket, with columns cell_i, cell_j and side.

    A bucket whose weights add up to W is dealt into k = ceil(W / most) parts by
    a hash of ``id``. Cell (i, j), i <= j, gets the parts i and j, so that every
    pair of a bucket's rows meets in one cell and no task ever holds more than
    two parts. ``side`` is the row's own part; in a cell with i < j only pairs
    of different sides are new.
    """
    parts = rows.groupBy(bucket).agg(F.ceil(F.sum(weight) / most).cast("int").alias("parts"))
    dealt = rows.join(stored(parts, "parts"), bucket).withColumn("side", F.pmod(F.xxhash64(F.col(id)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return (
        dealt.select("*", other)
        .withColumn("cell_i", F.least("side", "other"))
        .withColumn("cell_j", F.greatest("side", "other"))
        .drop("other", "parts")
    )


def cells_beside(rows: DataFrame, bucket: str, id: str, big: str, weight: Column, most: int) -> DataFrame:
    """As ``cells``, but rows with ``big`` of one bucket do not meet each other.

    The others are dealt into k parts and the big ones into l. Cells are the
    pairs of the k parts, and of each of them with each of the l: a big row is
    copied k times, another k + l times. So a large group that is settled in
    itself is copied once for every part of what is not.
    """
    part = F.ceil(F.sum(F.when(F.col(big), weight).otherwise(0)) / most), F.ceil(F.sum(F.when(F.col(big), 0).otherwise(weight)) / most)
    parts = stored(rows.groupBy(bucket).agg(part[0].cast("int").alias("bigs"), part[1].cast("int").alias("smalls")), "parts")
    h = F.xxhash64(F.col(id))
    own = F.when(F.col(big), F.col("smalls") + F.pmod(h, F.col("bigs"))).otherwise(F.pmod(h, F.col("smalls"))).cast("int")
    last = F.when(F.col(big), F.col("smalls")).otherwise(F.col("smalls") + F.col("bigs")) - 1
    dealt = rows.join(parts, bucket).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("cell_i", F.least("side", "other")).withColumn("cell_j", F.greatest("side", "other")).drop("other", "bigs", "smalls")
