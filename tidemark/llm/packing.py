"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised, an end id is added, and a document longer than a
sequence is cut into whole sequences and a rest. Only the histogram of piece
lengths (at most ``max_len`` numbers, however many pieces there are) is packed:
lengths are placed longest first, always into the pattern with the most room,
and a pattern is a list of lengths with the number of sequences that use it.
Each piece then finds its place by its length and its rank among the pieces of
that length. Ranks are running totals over ranges of (length, id, start), so a
length that many pieces share is spread over many tasks.

Defined cases: a null or empty text is one piece, the end id alone; rows that
repeat an id are separate documents with equal pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import running_totals, stored, table
from tidemark.llm.tokens import encoder, vocabulary_path

MAX_LEN = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def _cut(path: str, spaces: bool, end_id: int, max_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaces)
        for batch in given:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for row, ids in enumerate(enc.each(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), max_len):
                    piece = ids[at : at + max_len]
                    rows.append(row), starts.append(at), lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece)), totals.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return batches


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, number of such sequences)] that place every length of ``counts``.

    Longest first; each length goes to the open pattern with the most room
    (the shortest pack), and opens new sequences only if it fits nowhere.
    """
    open_patterns: dict[int, list[list]] = {}  # room: [[lengths, sequences]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, patterns in open_patterns.items() if patterns), default=-1)
            if room < length:
                per = max_len // length
                for copies, times in ((per, left // per), (left % per, 1)):
                    if copies and times:
                        open_patterns.setdefault(max_len - copies * length, []).append([(length,) * copies, times])
                left = 0
                continue
            pattern = open_patterns[room].pop()
            if not open_patterns[room]:
                del open_patterns[room]
            placed = min(left, pattern[1])
            if placed < pattern[1]:
                open_patterns.setdefault(room, []).append([pattern[0], pattern[1] - placed])
            open_patterns.setdefault(room - length, []).append([(*pattern[0], length), placed])
            left -= placed
    return [(tuple(lengths), n) for patterns in open_patterns.values() for lengths, n in patterns]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of a length, by rank, and where they go."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.append((length, first, first + n, sequence, offset))
            ranks[length] = first + n
            offset += length
        sequence += n
    return out


def token_pieces(docs: DataFrame, id: str, text: str, path: str, spaces: bool = False, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(_cut(path, spaces, end_id, max_len), "id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, spaces: bool = False, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece: ``id``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, id, text, path or vocabulary_path(VOCABULARY), spaces, end_id, max_len), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_len rows at most
    where = spark.createDataFrame(places(pack_histogram(counts, max_len)), "at long, first long, end long, sequence long, offset long")
    ranked = running_totals(pieces.withColumn("one", F.lit(1).cast("long")), ["length"], ["id", "start"], "one", "rank")
    # The places' number depends on max_len alone.
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
