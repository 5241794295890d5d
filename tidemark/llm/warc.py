"""WARC archives: pages written as (segmented) records, and segments put together again on reading.

Writing: a page's payload goes into an HTTP response with chunked transfer
framing. Of equal payloads of MIN_REVISIT bytes or more, the page with the
largest page_id is the response and the others are revisit records that refer to
it. A response longer than SEGMENT_BYTES is cut: the first record has segment number 1, the
others are continuation records with the origin's id and their number, the last
also with the total length. Segments lie anywhere in the archives.

Reading: files are parsed record by record by their Content-Length. Segments are
grouped by the origin's id, ordered by number and joined; numbers must run from 1
without gap and the length must be the total, else reading fails and says which
record is damaged. Then the chunked framing is undone and the payload's digest
compared with the one in the header.

The archives are written by Spark's text writer (gzip, a bounded number of
records of bounded size in each file) and read by its binary reader, so any store
Spark knows will do.

Defined cases: a null html is an empty payload; a null url is left out; rows
without a page_id are responses and are read with a null id; rows that repeat a
page_id are records of their own, told apart by a number in their record ids, and
where they repeat the largest page_id of a payload, all are responses; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import running_totals, stored, table
from tidemark.session import scratch_path

MIN_REVISIT = 1000
#: Payloads beyond this are written in segments: small enough that long pages have several.
SEGMENT_BYTES = 8 * 1024
CHUNK_BYTES = 16 * 1024
RECORDS_PER_FILE = 400
#: Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = [VERSION, *(k + b": " + v for k, v in fields), b"Content-Length: %d" % len(block)]
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def _urn(name: str, segment: int = 0) -> bytes:
    """A record id that names page and segment."""
    return f"<urn:page:{name}:{segment}>".encode() if segment else f"<urn:page:{name}>".encode()


def _text(value: str) -> bytes:
    """A header value on one line."""
    return re.sub(rb"[\r\n]+", b" ", value.encode("utf-8", "surrogatepass"))


def page_records(name: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    digest = b"sha1:" + base64.b32encode(bytes.fromhex(sha1))
    target = [(b"WARC-Target-URI", _text(url))] if url else []
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [_record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _urn(name)), (b"WARC-Date", DATE), *target, (b"Content-Type", b"application/http;msgtype=response"), (b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", _urn(refers_to)), (b"WARC-Payload-Digest", digest)], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _urn(name)), (b"WARC-Date", DATE), *target, (b"Content-Type", b"application/http;msgtype=response"), (b"WARC-Payload-Digest", digest)]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, (b"WARC-Segment-Number", b"1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", _urn(name, number)), (b"WARC-Date", DATE), (b"WARC-Segment-Origin-ID", _urn(name)), (b"WARC-Segment-Number", b"%d" % number)]
        if number == len(parts):
            fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_record(fields, part))
    return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive; field names in lower case."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(CRLF)[1:]
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (line.partition(b":") for line in lines)}
        at = end + 4
        size = int(fields["content-length"])
        if len(data) < at + size:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, data[at : at + size]
        at += size


def _write_batches(segment_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            out, size = [], 0
            for name, url, html, sha1, refers_to in zip(*(batch.column(c) for c in ("name", "url", "html", "sha1", "refers_to"))):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                made = page_records(name.as_py(), url.as_py(), payload, sha1.as_py(), refers_to.as_py(), segment_bytes)
                # The writer's line feed, set to CRLF, is the last of each record.
                out += [r[:-2] for r in made]
                size += len(payload)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return batches


def write_archives(pages: DataFrame, to: str, id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Writes the pages as WARC files to the folder ``to``."""
    given = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    given = given.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    slim = given.select("id", "sha1", "bytes")
    copies = slim.where((F.col("bytes") >= MIN_REVISIT) & F.col("id").isNotNull()).groupBy("sha1", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # Joined by id: the largest equal one per page with a twin. Pages that are alone keep their html where it is, unless Spark has to shuffle for the join.
    twins = stored(slim.join(copies.select("sha1", "bytes", "response"), ["sha1", "bytes"]).select(F.col("id").alias("twin"), F.col("sha1").alias("twin_sha1"), "response").distinct(), "equal-payloads")
    marked = given.join(twins, (F.col("id") == F.col("twin")) & (F.col("sha1") == F.col("twin_sha1")), "left").drop("bytes", "twin", "twin_sha1")
    marked = _numbered(marked, slim.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.when(F.col("number").isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col("number").cast("string"))))
    refers_to = F.when((F.col("response") != F.col("id")), F.col("response").cast("string"))
    named = marked.select(name.alias("name"), "url", "html", "sha1", refers_to.alias("refers_to"))
    lines = named.mapInArrow(_write_batches(segment_bytes), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(to)
    return to


def _numbered(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``pages`` with a number that is null for rows with an id of their own, and differs among all others."""
    repeated = stored(repeated, "repeated-pages")
    alone = F.lit(None).cast("long").alias("number")
    if repeated.isEmpty():
        return pages.select("*", alone)
    again = repeated.select(F.col("id").alias("again"))
    same = F.col("id").eqNullSafe(F.col("again"))
    counted = pages.join(again, same, "left_semi").withColumn("one", F.lit(1).cast("long")).withColumn("nth", F.coalesce("id", F.lit(0)))
    counted = running_totals(counted, [], ["nth", "sha1"], "one", "number").drop("one", "nth")
    return pages.join(again, same, "left_anti").select("*", alone).unionByName(counted)


_READ = pa.schema([
    ("name", pa.string()), ("url", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
    ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary()),
])
_READ_KINDS = "name string, url string, type string, origin string, segment int, total long, digest string, refers_to string, block binary"


def _read_batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in given:
        for content in batch.column("content"):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, 31)
            rows = []
            for f, block in records(data):
                kind, number = f["warc-type"], f.get("warc-segment-number")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                name = f["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                origin = f.get("warc-segment-origin-id", f["warc-record-id"]).removeprefix("<urn:page:").removesuffix(">")
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                refers_to = f.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">") or None
                total = f.get("warc-segment-total-length")
                rows.append((name, f.get("warc-target-uri"), kind, origin, int(number) if number else None, int(total) if total else None, base64.b32decode(digest).hex() if digest else None, refers_to, block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)] if rows else [pa.array([], t) for t in _READ.types], schema=_READ)


def _payload(name: str, digest: str | None, block: bytes) -> tuple[bytes, str]:
    """The payload of a response block, its framing undone and its digest compared, and the digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body
    sha1 = hashlib.sha1(payload).hexdigest()
    if digest is not None and digest != sha1:
        raise ValueError(f"record {name}: the payload does not have the digest in its header")
    return payload, sha1


def _measured(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parsed records with the payload's bytes and digest; blocks of whole responses, which nothing else needs, go."""
    for batch in _read_batches(given):
        sizes, sha1s, blocks = [], [], []
        for name, kind, segment, digest, block in zip(*(batch.column(c).to_pylist() for c in ("name", "type", "segment", "digest", "block"))):
            if kind == "response" and segment is None:
                payload, sha1 = _payload(name, digest, block)
                sizes.append(len(payload)), sha1s.append(sha1), blocks.append(None)
            else:
                sizes.append(None), sha1s.append(None), blocks.append(block if segment is not None else None)
        columns = [pa.array(blocks, pa.binary()) if c == "block" else batch.column(c) for c in _READ.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(sha1s, pa.string())], names=[*_READ.names, "payload_bytes", "sha1"])


def _payloads(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The payload of each response block, its framing undone and its digest compared."""
    for batch in given:
        payloads, sha1s = [], []
        for name, digest, block in zip(*(batch.column(c) for c in ("name", "digest", "block"))):
            payload, sha1 = _payload(name.as_py(), digest.as_py(), block.as_py())
            payloads.append(payload), sha1s.append(sha1)
        columns = {c: batch.column(c) for c in ("name", "url")} | {"payload": pa.array(payloads, pa.binary()), "sha1": pa.array(sha1s, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _archive_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select("content")


def _reassembled(read: DataFrame) -> DataFrame:
    """name, url, digest, block of the segmented records; gaps in the numbers or a wrong length fail the job."""
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    joined = (
        read.where("segment is not null").groupBy("origin")
        .agg(F.max("url").alias("url"), F.max(F.when(F.col("type") == "response", F.col("digest"))).alias("digest"), F.max("total").alias("total"), parts.alias("parts"))
        .withColumn("block", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"])))
    )
    complete = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    damaged = F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), F.col("origin"))).cast("binary")
    block = F.when(complete & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False)), F.col("block")).otherwise(damaged)
    return joined.select(F.col("origin").alias("name"), "url", "digest", block.alias("block"))


_PAYLOAD_KINDS = "name string, url string, payload binary, sha1 string"


def read_archives(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(responses: name, url, payload, sha1; revisits: name, url, refers_to, digest) of all archives in a folder.

    Only segmented records are shuffled. A segmented record whose numbers have
    gaps or whose length is not its total fails the job that reads it.
    """
    read = _archive_files(spark, folder).mapInArrow(_read_batches, _READ_KINDS)
    whole = read.where("type = 'response' and segment is null").select("name", "url", "digest", "block")
    responses = whole.unionByName(_reassembled(read)).mapInArrow(_payloads, _PAYLOAD_KINDS)
    return responses, read.where("type = 'revisit'").select("name", "url", "refers_to", "digest")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives.

    The archives are parsed once; what is kept of it are figures and the
    blocks of segments. A revisit's figures are those of the response it refers to.
    """
    id_of = lambda c: F.regexp_extract(c, r"^(-?\d+)", 1)
    page = lambda c: F.when(id_of(c) != "", id_of(c).cast("long"))
    read = stored(_archive_files(spark, folder).mapInArrow(_measured, f"{_READ_KINDS}, payload_bytes long, sha1 string"), "records")
    segmented = _reassembled(read).mapInArrow(_payloads, _PAYLOAD_KINDS).select("name", F.octet_length("payload").cast("long").alias("payload_bytes"), "sha1")
    whole = read.where("type = 'response' and segment is null").select("name", "payload_bytes", "sha1")
    full = stored(whole.unionByName(segmented).select(page("name").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest")), "responses")
    revisits = read.where("type = 'revisit'")
    again = revisits.select(page("name").alias("page_id"), page("refers_to").alias("refers_to"), F.col("digest").alias("payload_digest"))
    target = full.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = again.join(target, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string"))).cast("long")).alias("payload_bytes"),
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        "refers_to",
    )
    return full.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "llm-warc"))
    return read_pages(spark, folder)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND response <> page_id THEN response END AS refers_to
FROM r
"""
