"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for local runs (tests, bench). On a cluster the deployment's own
# settings apply. Results depend on none of them; the sizes of written files and the
# splitting of large months and keys rely on AQE (on by default in Spark).
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    This is the cluster's ``spark.checkpoint.dir``. Only a local session
    (as in tests) that has none gets a local folder as checkpoint directory;
    on a cluster it must be set.
    """
    sc = spark.sparkContext
    current_dir = sc.getCheckpointDir()
    if current_dir:
        return current_dir.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession, older_than_seconds: float, prefix: str = "") -> list[str]:
    """Remove this library's scratch tables in the shared folder older than the given age.

    ``prefix`` limits it to scratch names starting with it (``scratch_path``'s ``name``).

    Scratch tables back lazy DataFrames, so only remove ones no running job
    still reads.
    """
    import time

    from tidemark.sources.fs import FileStore

    base = f"{shared_dir(spark)}/tidemark"
    store = FileStore(spark, base)
    cutoff_ms = (time.time() - older_than_seconds) * 1000
    removed = []
    for path in store.glob(f"{base}/{prefix}*"):
        if store.modified_ms(path) < cutoff_ms:
            store.delete(path)
            removed.append(path)
    return removed
