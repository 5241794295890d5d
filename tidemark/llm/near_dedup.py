"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets decide.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z
only); with one to four words, the whole sequence is one shingle; without words
it is empty and linked with nothing. Two documents are linked when
100 * intersection >= percent * union, with PERCENT in the query. The result names for every document the
smallest doc_id reachable by links.

1. Equal sets are one class, which continues as a number of its own.
2. K minimum hashes of each set: the first bands * rows form the band keys, and
   all K, as pairs (place, minimum), are folded into a parity bitmap of BITS
   bits (odd sketch). Where two bitmaps are XORed, the population count tells
   how many minima differ, most precisely where similarity is high.
3. In each band bucket every class is compared with the bucket's smallest one:
   linear in the bucket. Pairs that the sizes and the sketches allow are
   confirmed on full sets; only their texts are fetched.
4. Buckets whose other members still fall into two or more components are
   compared further, in cells of bounded size: all members outside the bucket's
   largest component with each other and with that component, whose members
   need no comparison among themselves. Sketches alone are dealt to the cells first;
   texts follow for the members that have a likely partner. A task returns only the links
   that join components. So no link within a bucket is lost, a
   large group of copies never becomes all its pairs, and no cap is needed.

Bands and sketch limit follow from ``percent``: a pair right at the threshold shares
no band with probability MISS at most, and is sifted out by the sketch with less
than 1e-5. That is 24 bands of 6 minima and 80 bits at 0.85, 29 of 5 and 93 bits at 0.8.

Defined cases: null and blank texts have no shingles and stay by themselves; rows
without a doc_id keep their size, have no component and are kept; rows that
repeat a doc_id are each judged by their own text, and each carries the smallest doc_id
of its own component; equal texts of any number are one class; texts of any length are
compared whole; an empty table gives an empty result; other columns play no part,
whatever their names, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import may_hold, stored, table, unused
from tidemark.llm.graph import CELL, by_cell, cells_beside, components, each_cell, numbers
from tidemark.llm.words import Words, mix

SHINGLE = 5
PERCENT = 85
K, BITS = 192, 256
#: Most minima in a band, and the probability with which a pair at the threshold may share no band.
ROWS, MISS = 6, 1.2e-5
#: Shingles in one part of a split bucket, and what a member counts at least: larger parts are copied less, smaller ones hold less.
CELL_SHINGLES, CELL_LEAST = 400_000, 100


def shingles_of(w: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of hashed words."""
    if not len(w):
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = mix(h + w[j : j + n])
    return np.unique(h)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return shingles_of(Words([(text or "").encode("utf-8", "surrogatepass")]).hashes(lower=True))


_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, K, dtype=np.uint32)[:, None]


def minima(s: np.ndarray) -> np.ndarray:
    """The K minimum hashes of one set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (_A * x[None, i : i + 1024] + _B).min(axis=1), out=out)
    return out


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the pairs (place, minimum) of each row, as BITS / 64 signed longs."""
    at = mix(m.astype(np.uint64) + (np.arange(K, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    row = np.arange(len(m), dtype=np.int64)[:, None] * BITS
    odd = np.bincount((at.astype(np.int64) + row).ravel(), minlength=len(m) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(m), BITS), axis=1).view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    return odd_sketches(m[None])[0]


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows, ROWS at most, whose bands fit into K minima."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-min((percent / 100) ** rows, 1 - 1e-9)))
        if bands * rows <= K:
            return bands, rows
    raise ValueError(f"percent {percent} is too low for {K} minima")


def max_bits(percent: int) -> int:
    """Differing bits up to which a pair is confirmed: what is expected at the threshold and 4.5 deviations."""
    s = percent / 100
    differing = K * (1 - s)
    left = math.exp(-4 * differing / BITS)
    variance = 4 * left**2 * K * s * (1 - s) + BITS / 4 * (1 - left**2) - 2 * differing * left**2
    return math.ceil(BITS / 2 * (1 - left) + 4.5 * math.sqrt(variance))


def band_keys(m: np.ndarray, bands: int, n_rows: int) -> np.ndarray:
    """The band keys of each row of minima."""
    rows = m[:, : bands * n_rows].reshape(len(m), bands, n_rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2])
    for j in range(n_rows):
        h = mix(h + rows[:, :, j])
    return h.view(np.int64)


#: Bytes of text that are worked on together.
CHUNK = 1 << 18
SKETCH = "n long, key binary, bands array<long>, odd array<long>"
SKETCH_ARROW = [("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))]


def _shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, starts = words.hashes(lower=True), words.text.tolist()
    n = len(w) - SHINGLE + 1
    h = np.full(max(n, 0), SHINGLE, np.uint64)
    for j in range(SHINGLE if n > 0 else 0):
        h = mix(h + w[j : j + n])
    sets = []
    for begin, end in zip(starts[:-1], starts[1:]):
        if end - begin >= SHINGLE:
            s = np.sort(h[begin : end - SHINGLE + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(shingles_of(w[begin:end]))
    return sets


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The K minimum hashes of each set."""
    out = np.full((len(sets), K), np.iinfo(np.uint32).max, np.uint32)
    known = [i for i, s in enumerate(sets) if len(s)]
    if known:
        x = (np.concatenate([sets[i] for i in known]) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in known])[:-1]])
        for k in range(K):
            out[known, k] = np.minimum.reduceat(_A[k] * x + _B[k], first)
    return out


def sketches(words: Words, percent: int) -> list[pa.Array]:
    """The columns SKETCH of some texts; those without words have a size of 0 and nulls."""
    sets = _shingle_sets(words)
    m = _minima(sets)
    bands, odd = band_keys(m, *band_shape(percent)), odd_sketches(m)
    empty = np.array([not len(s) for s in sets], bool)
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]

    def lists(of: np.ndarray) -> pa.Array:
        ends = np.arange(0, of.size + 1, of.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(of.ravel()), mask=pa.array(empty))

    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists(bands), lists(odd)]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) of CHUNK bytes or one text each; a null text counts as empty."""
    begin, held, size = 0, [], 0
    for row, text in enumerate(texts):
        held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield begin, held
            begin, held, size = row + 1, [], 0
    if held:
        yield begin, held


def _sketch_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                own = batch.slice(begin, len(texts))
                made = sketches(Words(texts), percent)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("t"), *made], names=["id", "t", *(c for c, _ in SKETCH_ARROW)])

    return sketch_batches


def _linked(n_a: int, n_b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _confirm_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            a, b = [], []
            for begin, texts in chunks(batch.column("text_b")):
                sets = _shingle_sets(Words(texts))
                for row, s in enumerate(sets, begin):
                    i, j = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                    if i != last:
                        last, of_last = i, shingles(batch.column("text_a")[row].as_py())
                    if _linked(len(of_last), len(s), len(np.intersect1d(of_last, s, assume_unique=True)), percent):
                        a.append(i), b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm_batches


def _likely(members: pa.Table, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """For a member of a cell and its labels so far, the later members that may be linked with it and are not yet joined.

    Pairs that share an earlier band are that band's; in a cell of two parts only pairs of unlike sides are new.
    """
    n, side, bands, odd = (numbers(members, c) for c in ("n", "side", "bands", "odd"))
    odd, band, crossing = odd.view(np.uint64), members.column("band")[0].as_py(), members.column("cell_i")[0] != members.column("cell_j")[0]
    most_bits = max_bits(percent)

    def later(x: int, label: np.ndarray) -> np.ndarray:
        rest = np.arange(x + 1, len(n))
        fits = (label[rest] != label[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
        if crossing:
            fits &= side[rest] != side[x]
        rest = rest[fits]
        rest = rest[np.bitwise_count(odd[rest] ^ odd[x]).sum(axis=1) <= most_bits]
        return rest[(bands[rest, :band] != bands[x, :band]).all(axis=1)]

    return later


def _labels(members: pa.Table) -> np.ndarray:
    return np.unique(numbers(members, "label"), return_inverse=True)[1]


def _cell_links(members: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between components among one cell's members."""
    id, n, label, later = numbers(members, "id"), numbers(members, "n"), _labels(members), _likely(members, percent)
    sets = [s for _, texts in chunks(members.column("text")) for s in _shingle_sets(Words(texts))]
    links = []

    for x in range(len(id) - 1):
        for y in later(x, label).tolist():
            if label[y] != label[x] and _linked(int(n[x]), int(n[y]), len(np.intersect1d(sets[x], sets[y], assume_unique=True)), percent):
                links.append((int(id[x]), int(id[y])))
                label[label == label[y]] = label[x]
    return links


def _cell_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in each_cell(batches):
            links = _cell_links(members, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return cell_batches


def _open_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of each cell that have a likely partner there: rows of the cell, never its pairs."""

    def open_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in each_cell(batches):
            label, later = _labels(members), _likely(members, percent)
            found = np.zeros(members.num_rows, bool)
            for x in range(members.num_rows - 1):
                rest = later(x, label)
                found[rest] = True
                found[x] |= len(rest) > 0
            if found.any():
                yield from members.select([*CELL, "id"]).filter(pa.array(found)).combine_chunks().to_batches()

    return open_batches


def _alike(odd_a: str, odd_b: str, n_a: str, n_b: str, percent: int) -> Column:
    """The sizes allow a link and the sketches differ in max_bits at most."""
    bits = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (bits <= max_bits(percent))


def class_components(sketched: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(key, first): for every set of ``sketched`` (id, t and SKETCH), (id, t) of its component's smallest document.

    ``whole`` (id, t, text) is where the texts of likely pairs are fetched from.
    """
    known = sketched.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = known.groupBy("key").agg(F.min(F.struct("id", "t")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    # A class is named by its smallest id, or by a hash of its set where that id has several sets.
    mark = F.xxhash64("key")
    several = known.groupBy("id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo != hi").select(F.col("id").alias("several"))
    named = classes.join(stored(several, "repeated-ids"), F.col("first.id") == F.col("several"), "left")
    classes = stored(named.select("key", F.when(F.col("several").isNull(), F.col("first.id")).otherwise(mark).alias("id"), "first", "n", "bands", "odd"), "classes")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.select(F.col("id").alias("class"), F.col("first.id").alias("id"), F.col("first.t").alias("t")).join(ids.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
        wanted = stored(wanted, "wanted-texts")
        # The likely pairs grow with the documents: a merge join, whatever their number, of the texts that may be wanted.
        found = may_hold(whole, "t", wanted.select("t")).join(wanted.hint("merge"), ["id", "t"]).select(F.col("class").alias("id"), "text")
        return stored(found.dropDuplicates(["id"]), "candidate-texts")

    in_bands = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    buckets = stored(in_bands.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("c")).where("c > 1"), "buckets")
    others = stored(in_bands.join(buckets, "bucket").where("id != center"), "hits")

    pairs = others.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda k, df, *more: df.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in more))
    sifted = stored(pairs, "pairs").join(side("b", classes, "n", "odd"), "b").join(side("a", classes, "n", "odd"), "a")
    likely = stored(sifted.where(_alike("odd_a", "odd_b", "n_a", "n_b", percent)).select("a", "b"), "likely")
    of_likely = texts(likely.select(F.col("a").alias("id")).union(likely.select("b")))
    both = likely.join(side("b", of_likely, "text"), "b").join(side("a", of_likely, "text"), "a").select("a", "b", "text_a", "text_b")
    near = stored(both.mapInArrow(_confirm_batches(percent), "a long, b long"), "near")
    found = stored(components(near), "components")

    # What the comparison with each bucket's smallest member leaves open.
    members = others.where("c > 2").join(found, "id", "left").withColumn("label", F.coalesce("component", "id"))
    members = stored(members.select("bucket", "band", "id", "label"), "open-members")
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most"))
    undecided = stored(sizes.where("labels > 1").select("bucket", F.col("most.label").alias("largest")), "open-buckets")
    if not undecided.isEmpty():
        rest = members.join(undecided, "bucket").withColumn("big", F.col("label") == F.col("largest")).drop("largest")
        # Of a band key, 31 bits are enough to tell whether a pair shares it.
        keys = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")
        rest = stored(rest.join(classes.select("id", "n", keys, "odd"), "id"), "open")
        weight = F.greatest(F.col("n"), F.lit(CELL_LEAST))
        dealt = cells_beside(rest, "bucket", "id", "big", weight, CELL_SHINGLES)
        hopeful = stored(by_cell(dealt).mapInArrow(_open_batches(percent), "bucket long, cell_i int, cell_j int, id long"), "hopeful")
        met = dealt.join(hopeful, [*CELL, "id"]).join(texts(hopeful), "id")
        more = stored(by_cell(met).mapInArrow(_cell_batches(percent), "a long, b long"), "more-near")
        if not more.isEmpty():
            found = stored(components(near.union(more)), "components")

    linked = found.join(classes.select("id", "first"), "id")
    smallest = stored(linked.groupBy("component").agg(F.min("first").alias("smallest")), "smallest")
    of_linked = stored(found.join(smallest, "component").select("id", "smallest"), "linked")
    return stored(classes.select("key", "id", "first").join(of_linked, "id", "left").select("key", F.coalesce("smallest", "first").alias("first")), "class-components")


def _sketched(docs: DataFrame, id: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, t and SKETCH of every row; what ``class_components`` makes of them)."""
    whole = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    sketched = stored(whole.mapInArrow(_sketch_batches(percent), f"id long, t long, {SKETCH}"), "sketches")
    return sketched, class_components(sketched, whole, percent)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id``, n_shingles, component_id, kept (the document is its component's smallest)."""
    sketched, of_class = _sketched(docs, id, text, percent)
    smallest = F.coalesce("first.id", "id")
    return sketched.select("id", "n", "key").join(of_class, "key", "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), smallest).alias("component_id"),
        F.coalesce(F.col("id") == smallest, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; rows without shingles or id stay.

    Where rows repeat that id, the text with the smallest hash stays, and of equal rows one.
    """
    sketched, of_class = _sketched(docs, id, text, percent)
    known = sketched.where(F.col("id").isNotNull()).select("id", "t", "key").join(of_class, "key")
    at, t = unused(docs.columns, "_id"), unused(docs.columns, "_t")
    own = lambda df: df.select(F.col("id").alias(at), F.col("t").alias(t))
    gone = own(known.where(F.struct("id", "t") != F.col("first")).distinct())
    again = stored(own(known.groupBy("id", "t").agg(F.count("*").alias("c")).where("c > 1")), "repeated-rows")
    marked = docs.withColumns({at: F.col(id).cast("long"), t: F.xxhash64(F.col(text))})
    left = marked.join(stored(gone, "near-duplicates"), [at, t], "left_anti")
    if not again.isEmpty():
        left = left.join(again, [at, t], "left_anti").unionByName(left.join(again, [at, t], "left_semi").dropDuplicates([at, t]))
    return left.select(docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + {SHINGLE - 1}), 'string_agg', ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.id = l.x
), m AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.id = doc_id
"""
