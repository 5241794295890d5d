"""Token ids as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup without decoding it.

A shard holds the ids of consecutive documents (ascending id), SHARD_TOKENS or
a little more, or one longer document. Its file:

    magic, version, documents, ids, distinct ids, partition, shard in partition    (header)
    document ids, null flags, end of each document in the shard
    the distinct ids and how often each occurs
    per level: number of bits, of zeros, the bits, and the ones before every 512 bits

The matrix has the shape of a prefix code: frequent ids have short codes, so a
file takes about the entropy of its ids, and a shard of one id no bits at all. Code
lengths follow from the counts: floor(log2(n / count) + t) with the smallest t, in
steps of 1/64, that leaves room for all codes. At each level the ids stand as the levels above have
stably parted them by their codes' bits, zeros first. Codes are dealt out so that those
that end at a level stand last there: the next level is the front part, without
gaps. Following one position down the levels gives its id; following a range
gives how often an id occurs in it; going up gives places.

Files are written by Spark's text writer (one record per file, whose line feed
ends the file) and read by its binary reader, so any store Spark knows will do.

Defined cases: a null or empty text has the end id alone; null ids come first; rows
that repeat an id stand in a row, ordered by their ids' bytes; a text of any length is one document of one
shard; an empty table writes no shard; ids may be any number below 2^32; other columns play no part, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import running_totals, stored, table
from tidemark.llm.tokens import encoder, vocabulary_path, vocabulary_size
from tidemark.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1_000_000
_HEADER = struct.Struct("<4sIQQQQQ")
_MAGIC, _VERSION, _BLOCK = b"WVMX", 2, 512
_MOST = 32  # bits of a code


def _kind(size: int) -> str:
    """The type that holds the ids of a vocabulary of this size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of the code of each id, by how often it occurs."""
    exact = np.log2(counts.sum() / counts)

    def rounded(t: int) -> np.ndarray:
        return np.minimum(np.floor(exact + t / 64), _MOST).astype(np.int64)

    def room(t: int) -> bool:
        lengths = np.bincount(rounded(t), minlength=1)
        return (lengths * 0.5 ** np.arange(len(lengths))).sum() <= 1

    return rounded(bisect.bisect_left(range(64), True, key=room))


def code_book(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, their bits from the highest of 32 on; the order in which ids whose codes end at one level stand there).

    Per level the prefixes are listed as they stand there. Those of codes that end are the last ones; as many
    as the longer codes need, from the front, go on: first all of them with a zero, then with a one.
    """
    codes = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    ending = np.bincount(lengths, minlength=lengths.max(initial=0) + 1)
    needed = np.zeros(len(ending) + 1, np.int64)
    for level in range(len(ending) - 1, 0, -1):
        needed[level - 1] = -(-(needed[level] + ending[level]) // 2)
    prefixes, at = np.zeros(1, np.uint64), 0
    for level, k in enumerate(ending.tolist()):
        if k:
            codes[order[at : at + k]] = prefixes[len(prefixes) - k :]
            at += k
        on = prefixes[: needed[level]]
        prefixes = np.concatenate([on, on | np.uint64(1 << (31 - level))]) if level < 32 else on
    return codes, order


def _plane(ones: np.ndarray) -> tuple[bytes, bytes]:
    packed = np.packbits(ones, bitorder="little")
    packed = np.pad(packed, (0, -len(packed) % (_BLOCK // 8)))
    per_block = np.bitwise_count(packed.view("<u8")).reshape(-1, _BLOCK // 64).sum(axis=1)
    return packed.tobytes(), np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes()


def write_shard(ids: np.ndarray, doc_ids: list, ends: np.ndarray, part: int, shard: int) -> bytes:
    if ids.max(initial=0) <= 0xFFFF:
        counts = np.bincount(ids, minlength=1)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        numbers = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
        numbers[symbols] = np.arange(len(symbols))
        numbers = numbers[ids]
    else:
        symbols, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
    lengths = code_lengths(counts)
    codes, _ = code_book(lengths)
    out = [_HEADER.pack(_MAGIC, _VERSION, len(doc_ids), len(ids), len(symbols), part, shard)]
    out += [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    out += [symbols.astype("<u4").tobytes(), counts.astype("<u4").tobytes()]
    now = codes[numbers]
    left = np.bincount(lengths, weights=counts).astype(np.int64)
    for level in range(lengths.max(initial=0)):
        now = now[: len(now) - left[level]]
        ones = now.view(np.int32) < 0
        bits, before = _plane(ones)
        zeros = np.flatnonzero(~ones)
        out += [struct.pack("<QQ", len(now), len(zeros)), bits, before]
        now = np.concatenate([now.take(zeros), now.take(np.flatnonzero(ones))]) << np.uint32(1)
    return b"".join(out)


class Shard:
    """A shard file's content; answers from the bit planes."""

    def __init__(self, data: bytes):
        magic, version, n_docs, self.n, n_symbols, self.part, self.shard = _HEADER.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a wavelet matrix shard")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += a.nbytes
            return a

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = pa.array(ids, mask=null == 1)
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.symbols, self.counts = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.int64)
        self.lengths = code_lengths(self.counts)
        self.codes, self.order = code_book(self.lengths)
        self.levels = []
        for _ in range(self.lengths.max(initial=0)):
            size, zeros = take("<u8", 2).tolist()
            blocks = -(-size // _BLOCK)
            self.levels.append((size, zeros, take("u1", blocks * (_BLOCK // 8)), take("<u4", blocks + 1)))

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a level."""
        _, _, plane, before = self.levels[level]
        block = i // _BLOCK
        if block * _BLOCK == i:
            return int(before[block])
        part = plane[block * _BLOCK // 8 : i // 8 + 1].copy()
        part[-1] &= (1 << i % 8) - 1
        return int(before[block]) + int(np.bitwise_count(part).sum())

    def _number(self, value: int) -> int | None:
        at = int(np.searchsorted(self.symbols, value))
        return at if at < len(self.symbols) and self.symbols[at] == value else None

    def access(self, i: int) -> int:
        """The id at position i."""
        code = level = 0
        while level < len(self.levels) and i < self.levels[level][0]:
            _, zeros, plane, _ = self.levels[level]
            bit = int(plane[i // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            code |= bit << (31 - level)
            level += 1
        return int(self.symbols[np.flatnonzero((self.codes == code) & (self.lengths == level))[0]])

    def _range(self, number: int, begin: int, end: int) -> tuple[int, int]:
        """Where an id's occurrences among positions begin to end stand below the last level of its code."""
        code = int(self.codes[number])
        for level in range(int(self.lengths[number])):
            zeros = self.levels[level][1]
            a, b = self._ones(level, begin), self._ones(level, end)
            begin, end = (zeros + a, zeros + b) if code >> (31 - level) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """How often the id occurs at positions begin to end."""
        number = self._number(value)
        if number is None:
            return 0
        a, b = self._range(number, begin, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of a level, for ascending k."""
        _, _, plane, before = self.levels[level]
        places = before.astype(np.int64) if bit else np.arange(len(before)) * _BLOCK - before.astype(np.int64)
        block = np.searchsorted(places, k, side="right") - 1
        blocks, of = np.unique(block, return_inverse=True)
        bits = np.unpackbits(plane.reshape(-1, _BLOCK // 8)[blocks], axis=1, bitorder="little") == bit
        # The number of such bits up to each place; of the k-th one it is one more than of those before it.
        upto = bits.cumsum(axis=1, dtype=np.int32) + (np.arange(len(blocks)) * (_BLOCK + 1))[:, None]
        return np.searchsorted(upto.ravel(), k - places[block] + 1 + of * (_BLOCK + 1)) - of * _BLOCK + block * _BLOCK

    def occurrences(self, value: int) -> list[int]:
        """All positions of the id, ascending."""
        number = self._number(value)
        if number is None:
            return []
        at, code = np.arange(*self._range(number, 0, self.n)), int(self.codes[number])
        for level in range(int(self.lengths[number]) - 1, -1, -1):
            bit = code >> (31 - level) & 1
            at = self._select(level, bit, at - self.levels[level][1] if bit else at)
        return at.tolist()

    def all_ids(self) -> np.ndarray:
        """Every id in order: the levels undone from the last to the first."""
        ends = np.cumsum(np.bincount(self.lengths, minlength=1))
        symbols, counts = self.symbols[self.order], self.counts[self.order]
        kind = np.uint16 if self.symbols.max(initial=0) <= 0xFFFF else np.uint32

        def ended(level: int) -> np.ndarray:
            own = slice(ends[level - 1] if level else 0, ends[level])
            return np.repeat(symbols[own].astype(kind), counts[own])

        now = ended(len(self.levels)) if self.n else np.empty(0, kind)
        for level in range(len(self.levels) - 1, -1, -1):
            size, zeros, plane, _ = self.levels[level]
            ones = np.unpackbits(plane, count=size, bitorder="little").view(bool)
            above = np.empty(size, kind)
            above[np.flatnonzero(ones)] = now[zeros:]
            above[np.flatnonzero(~ones)] = now[:zeros]
            now = np.concatenate([above, ended(level)])
        return now


def _encode(path: str, spaces: bool, end_id: int, kind: str, bounds: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaces)
        for batch in given:
            tokens = [np.append(ids, np.uint32(end_id)).astype(kind).tobytes() for ids in enc.each(batch.column("text"))]
            ids = batch.column("id")
            part = np.searchsorted(bounds, pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pa.array(tokens, pa.binary())], names=["part", "id", "tokens"])

    return batches


def _build(kind: str, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, docs, ids, size = None, 0, [], [], 0

        def out() -> pa.RecordBatch:
            data = write_shard(np.concatenate(ids), docs, np.cumsum([len(i) for i in ids]), part, shard)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in given:
            for of, doc, tokens in zip(*(batch.column(c) for c in ("part", "id", "tokens"))):
                if size and (size >= shard_tokens or of.as_py() != part):
                    yield out()
                    docs, ids, size, shard = [], [], 0, shard + 1
                if of.as_py() != part:
                    part, shard = of.as_py(), 0
                docs.append(doc.as_py()), ids.append(np.frombuffer(tokens.as_py(), kind))
                size += len(ids[-1])
        if size:
            yield out()

    return batches


def write_shards(docs: DataFrame, to: str, id: str = "doc_id", text: str = "text", path: str | None = None, spaces: bool = True, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Tokenises the documents and writes shard files to the folder ``to``, in ascending order of id.

    Quantiles of the ids (as many as there are shuffle partitions) part the
    documents, so that texts are tokenised once and only their ids are shuffled,
    in two bytes each if the vocabulary allows it.
    """
    path = path or vocabulary_path(VOCABULARY)
    kind = _kind(max(vocabulary_size(path), end_id + 1))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = given.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first()["q"]
    bounds = sorted(set(found or []))[: n - 1]
    encoded = given.mapInArrow(_encode(path, spaces, end_id, kind, bounds), "part int, id long, tokens binary")
    ordered = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", "id", "tokens")
    shards = ordered.mapInArrow(_build(kind, shard_tokens), "data binary")
    shards.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(to)
    return to


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select("content")


def _read_documents(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in given:
        for content in batch.column("content"):
            s = Shard(content.as_py())
            ids = memoryview(s.all_ids().astype("<u4"))
            starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), s.ends.tolist())]
            k = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.part] * k, pa.int64()), pa.array([s.shard] * k, pa.int64()), s.doc_ids, pa.array(starts), pa.array(s.ends - starts), pa.array(crcs, pa.int64())],
                names=["part", "shard", "id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """``id``, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the shards."""
    docs = stored(_contents(spark, folder).mapInArrow(_read_documents, "part long, shard long, id long, at long, n_tokens long, ids_crc32 long"), "shard-documents")
    shards = docs.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = running_totals(shards, [], ["part", "shard"], "n", "before")
    return docs.join(before, ["part", "shard"]).select(F.col("id").alias(id), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _find(value: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for content in batch.column("content"):
                s = Shard(content.as_py())
                at = np.array(s.occurrences(value), np.int64)
                doc = np.searchsorted(s.ends, at, side="right")
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([s.doc_ids.take(pa.array(doc)), pa.array(at - starts[doc] if len(at) else at)], names=["id", "at"])

    return batches


def find_token(spark: SparkSession, folder: str, value: int, id: str = "doc_id") -> DataFrame:
    """(``id``, at): every occurrence of an id, with its place in the document, from the bit planes."""
    return _contents(spark, folder).mapInArrow(_find(value), "id long, at long").withColumnRenamed("id", id)


def _count(values: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for content in batch.column("content"):
                s = Shard(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([s.count(v) for v in values], pa.int64())], names=["token", "n"])

    return batches


def count_tokens(spark: SparkSession, folder: str, values: list[int]) -> DataFrame:
    """(token, n): how often each given id occurs in all shards, from the bit planes."""
    return _contents(spark, folder).mapInArrow(_count(values), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "llm-shards"))
    return read_documents(spark, folder)
