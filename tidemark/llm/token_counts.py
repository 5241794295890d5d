"""Token counts of documents: each distinct pre-token's pieces are counted once, then joined to the documents' pre-token frequencies.

1. Per block of texts: how often each document has each pre-token, by the
   pre-token's number in the block. These frequencies are stored and stay with
   their block. The block's distinct pre-tokens are dealt by a hash into pages.
2. A page meets a pre-token once per block that has it, in however many
   documents, and counts each distinct one once with the library. So a pre-token that
   every document has weighs no more in its page than others that every block has.
3. The counts go back to the blocks, which multiply them with their
   frequencies and sum by document. No ids of a text are ever made.

A page holds a share of the distinct pre-tokens; beyond KNOWN of them in one
page its memory is emptied and some are counted again, so memory is bounded.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat
an id, and rows without one, are counted each for itself; a special token's string inside a text counts
as one token, as the library does by default; a text of any length is counted whole, and one longer than
a block is a block of its own; an empty table gives no rows; other columns of ``docs`` play no part, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.tokens import encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the splitting rule of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 16_000_000
KNOWN = 1_000_000
LIMIT = 1024
#: Per block one row with its frequencies (page null), and one row for every page that it has pre-tokens of.
_BLOCKS = "block long, page int, docs binary, names binary"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("page", pa.int32()), ("docs", pa.binary()), ("names", pa.binary())])
_COUNTS = "block long, page int, counts binary"
_COUNTS_ARROW = pa.schema([("block", pa.int64()), ("page", pa.int32()), ("counts", pa.binary())])
_SUMS_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, in the narrowest type each fits, compressed."""
    narrow = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = struct.pack(f"<{2 * len(narrow)}q", *(x for a in narrow for x in (a.itemsize, a.nbytes)))
    return zlib.compress(head + b"".join(a.tobytes() for a in narrow), 1)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    head, at, out = struct.unpack_from(f"<{2 * n}q", raw), 16 * n, []
    for width, size in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(raw, f"<u{width}", size // width, at).astype(np.int64))
        at += size
    return out


def _block_rows(block: int, ids: list, texts: list[str | None], pages: int, specials: list[str]) -> Iterator[tuple[int, int | None, bytes | None, bytes | None]]:
    import regex

    find = regex.compile(PRE_TOKEN).findall
    split = regex.compile("|".join(map(regex.escape, specials)))
    number: dict[str, int] = {}
    sizes, special, held, at, freq = [], [], [], [], []
    for text in texts:
        text = text or ""
        sizes.append(len(text.encode("utf-8", "surrogatepass")))
        parts = split.split(text) if any(s in text for s in specials) else [text]
        special.append(len(parts) - 1)
        found = Counter(find(parts[0]))
        for part in parts[1:]:
            found.update(find(part))
        at.extend([number.setdefault(p, len(number)) for p in found])
        freq.extend(found.values())
        held.append(len(found))
    pieces = [p.encode("utf-8", "surrogatepass") for p in number]
    page = np.array([xxhash.xxh3_64_intdigest(p) % pages for p in pieces], np.int64)
    # A pre-token's number is its place among the block's pre-tokens in the order of pages.
    order = np.argsort(page, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    known = np.array([i is not None for i in ids], np.int64)
    numbers = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
    counts = (np.array(x, np.int64) for x in (sizes, special, held))
    yield block, None, _pack(numbers, known, *counts, place[np.array(at, np.int64)], np.array(freq, np.int64)), None
    of_page = page[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of_page)) + 1, [len(order)]]).tolist() if len(order) else []
    for begin, end in zip(cuts[:-1], cuts[1:]):
        names = [pieces[i] for i in order[begin:end].tolist()]
        yield block, int(of_page[begin]), None, _pack(np.frombuffer(b"".join(names), np.uint8), np.array([len(p) for p in names], np.int64))


def _blocks(path: str, pages: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = encoder(path, True).specials
        # The same rows get the same block again when a task is repeated.
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_block_rows(block, ids, texts, pages, specials)), _BLOCKS_ARROW.types)], schema=_BLOCKS_ARROW)

        for batch in given:
            for i, text in zip(batch.column("id"), batch.column("text")):
                ids.append(i.as_py()), texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK_BYTES or len(ids) >= 65536:
                    yield out()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield out()

    return batches


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The number of pieces of each pre-token of a block's page, in the order of its names."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        count: dict[bytes, int] = {}
        for batch in given:
            rows = []
            for data in batch.column("names"):
                text, lengths = _unpack(data.as_py(), 2)
                text, ends = text.astype(np.uint8).tobytes(), np.cumsum(lengths)
                names = [text[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                if len(count) >= KNOWN:
                    count.clear()
                new = [p for p in names if p not in count]
                count.update(zip(new, enc.counts([p.decode("utf-8", "surrogatepass") for p in new])))
                rows.append(_pack(np.fromiter((count[p] for p in names), np.int64, len(names))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("page"), pa.array(rows, pa.binary())], schema=_COUNTS_ARROW)

    return batches


def _summed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in given:
        for docs, parts in zip(batch.column("docs"), batch.column("parts")):
            ids, known, sizes, special, held, place, freq = _unpack(docs.as_py(), 7)
            counts = np.concatenate([np.empty(0, np.int64), *(_unpack(p["counts"], 1)[0] for p in parts.as_py() or [])])
            # Running sums: a document's entries stand together, and some have none.
            sums, ends = np.concatenate([[0], np.cumsum(counts[place] * freq)]), np.cumsum(held)
            total = special + sums[ends] - sums[ends - held]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(total)], schema=_SUMS_ARROW)


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, pages: int | None = None) -> DataFrame:
    """One row per document: ``id``, n_bytes, n_tokens, over_limit.

    ``pages`` (the shuffle partitions if not given) should grow with the
    corpus as shuffle partitions do.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path(VOCABULARY)
    pages = pages or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # Stored: a lost executor does not split texts again, and only pre-tokens and counts are shuffled besides the frequencies' way to the join.
    blocks = stored(given.mapInArrow(_blocks(path, pages), _BLOCKS), "token-blocks")
    names = blocks.where(F.col("page").isNotNull()).select("block", "page", "names").repartition(pages, "page")
    parts = names.mapInArrow(_counted(path), _COUNTS).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("page", "counts"))).alias("parts"))
    whole = blocks.where(F.col("page").isNull()).select("block", "docs").join(parts, "block", "left")
    counts = whole.select("docs", "parts").mapInArrow(_summed, "id long, n_bytes long, n_tokens long")
    return counts.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
