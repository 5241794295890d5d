"""Two small files beside a table's data, which Spark's readers skip: its columns, and each month's number of rows.

``<root>/_schema`` holds the columns of all files that this library wrote into
the table, as Spark's schema JSON. Readers without a declared schema take it
from there instead of opening the files' footers. It is started with the first
rows of a new table; a table that already holds data gets one by
``store_schema``. A month with more columns adds them. A month that has a
column in another type removes the note, and readers look at the files again.
Write to a table by other means, and call ``store_schema`` or remove the note.

``<month>/_rows`` holds the number of rows of a month's files, with their
number and bytes; a note that does not fit the files counts for nothing. It
comes with the write itself (an observed count), and every overwrite removes it
with the month's other files.

Neither is a log of commits: what a table holds is what lies in its directories.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidemark.sources import fs

log = logging.getLogger(__name__)

SCHEMA = "_schema"
ROWS = "_rows"
_PERIOD = ("year", "month")


def own_columns(schema: T.StructType) -> T.StructType:
    """The columns without the period, all of them nullable, as they are read back."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields if f.name.lower() not in _PERIOD])


def noted_schema(spark: SparkSession, root: str) -> "T.StructType | None":
    """The table's stored columns; None without a note."""
    text = fs.FileStore(spark, root).read_text(f"{root.rstrip('/')}/{SCHEMA}")
    return None if text is None else T.StructType.fromJson(json.loads(text))


def store_schema(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Declare the columns of a table to all its readers, in place of what was declared before."""
    fs.FileStore(spark, root).write_text(f"{root.rstrip('/')}/{SCHEMA}", own_columns(schema).json())


def add_columns(spark: SparkSession, root: str, schema: T.StructType, new_table: bool) -> None:
    """Note the columns of a month that is about to be written. ``new_table``: no other month holds rows."""
    known = noted_schema(spark, root)
    if known is None and not new_table:
        return
    mine = own_columns(schema)
    fields = {f.name.lower(): f for f in (known or T.StructType()).fields}
    for f in mine.fields:
        if f.name.lower() in fields and fields[f.name.lower()].dataType != f.dataType:
            log.warning("column %r of %s has several types; its readers have to look at the files", f.name, root)
            fs.delete(spark, f"{root.rstrip('/')}/{SCHEMA}")
            return
        fields.setdefault(f.name.lower(), f)
    if known is None or len(fields) > len(known.fields):
        store_schema(spark, root, T.StructType(list(fields.values())))


def note_rows(store: fs.FileStore, leaf: str, n_rows: int) -> None:
    sizes = store.data_sizes(leaf)
    store.write_text(f"{leaf}/{ROWS}", f"{n_rows} {len(sizes)} {sum(sizes.values())}")


def noted_rows(store: fs.FileStore, leaf: str, sizes: dict[str, int]) -> "int | None":
    """The month's number of rows; None without a note that fits its files."""
    if not sizes:
        return 0
    text = store.read_text(f"{leaf}/{ROWS}")
    found = (text or "").split()
    if len(found) != 3 or not all(x.isdigit() for x in found):
        return None
    rows, files, size = map(int, found)
    return rows if (files, size) == (len(sizes), sum(sizes.values())) else None
