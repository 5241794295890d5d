"""Cutting a frame's lineage in the shared folder.

Two ways, both into the folder named by the cluster's ``spark.checkpoint.dir``
(reachable by every executor, so a lost executor costs a task retry, not a
recomputation of the lineage):

* ``"table"`` (default): write parquet and read it back. Columnar and
  compressed; the read back gets column pruning and filter pushdown.
* ``"checkpoint"``: Spark's reliable ``DataFrame.checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import scratch_path, shared_dir


def cut_lineage(df: DataFrame, *, mode: str = "table", name: str = "lineage") -> DataFrame:
    spark = df.sparkSession
    if mode == "checkpoint":
        shared_dir(spark)  # makes sure a checkpoint directory is set
        return df.checkpoint(eager=True)
    if mode != "table":
        raise ValueError(f"unknown lineage cut mode {mode!r}; use 'table' or 'checkpoint'")
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
