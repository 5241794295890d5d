"""Metadata calls on the table store through Hadoop's FileSystem.

These list, create and delete directory entries, and keep small notes, on the driver; they
never read rows. Any Hadoop URI works (file:, hdfs:, s3a:, abfs:, ...).
``FileStore`` keeps one FileSystem handle per root so each call is one or two
gateway round trips; ``parallel`` runs independent per-month calls on a few
driver threads, since object stores answer them with latency, not bandwidth.

The calls go through the driver's JVM gateway, so they need a classic session;
Spark Connect has no such gateway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
R = TypeVar("R")

# Driver threads used for independent metadata calls (one per month).
METADATA_THREADS = 16


class FileStore:
    def __init__(self, spark: SparkSession, uri: str):
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, uri: str) -> bool:
        return bool(self._fs.exists(self._Path(uri)))

    def qualified(self, uri: str) -> str:
        """The path with scheme and authority, as Spark names it in plans."""
        return str(self._fs.makeQualified(self._Path(uri)).toString())

    def glob(self, pattern: str) -> list[str]:
        statuses = self._fs.globStatus(self._Path(pattern))
        return [] if statuses is None else [s.getPath().toString() for s in statuses]

    def data_sizes(self, uri: str) -> dict[str, int]:
        """The files of a directory that Spark would read (not ``_*`` or ``.*``), with their bytes."""
        found = [s for s in self._fs.listStatus(self._Path(uri)) if s.isFile()]
        return {s.getPath().toString(): int(s.getLen()) for s in found if not s.getPath().getName().startswith(("_", "."))}

    def data_files(self, uri: str) -> list[str]:
        return list(self.data_sizes(uri))

    def delete(self, uri: str) -> bool:
        """Remove a path and everything under it; a missing path is not an error."""
        return bool(self._fs.delete(self._Path(uri), True))

    def mkdirs(self, uri: str) -> None:
        self._fs.mkdirs(self._Path(uri))

    def touch(self, uri: str) -> None:
        self._fs.create(self._Path(uri), True).close()

    def write_text(self, uri: str, text: str) -> None:
        """A small file of notes, in place of one that is there."""
        out = self._fs.create(self._Path(uri), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, uri: str) -> "str | None":
        """The whole text of a small file; None if there is none."""
        path = self._Path(uri)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def modified_ms(self, uri: str) -> int:
        return int(self._fs.getFileStatus(self._Path(uri)).getModificationTime())


def parallel(fn: Callable[[T], R], items: Iterable[T]) -> list[R]:
    items = list(items)
    if len(items) <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(METADATA_THREADS, len(items))) as pool:
        return list(pool.map(fn, items))


def reads_from(df: DataFrame, root: str) -> bool:
    """Whether the frame's plan reads files under ``root``, or the folder that holds it."""
    inside = FileStore(df.sparkSession, root).qualified(root).rstrip("/") + "/"
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            continue
        paths = leaf.relation().location().rootPaths()
        for j in range(paths.size()):
            path = paths.apply(j).toString().rstrip("/") + "/"
            if path.startswith(inside) or inside.startswith(path):
                return True
    return False


# Function forms for one-off calls.

def exists(spark: SparkSession, uri: str) -> bool:
    return FileStore(spark, uri).exists(uri)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    return FileStore(spark, pattern).glob(pattern)


def delete(spark: SparkSession, uri: str) -> bool:
    return FileStore(spark, uri).delete(uri)


def mkdirs(spark: SparkSession, uri: str) -> None:
    FileStore(spark, uri).mkdirs(uri)


def touch(spark: SparkSession, uri: str) -> None:
    FileStore(spark, uri).touch(uri)
