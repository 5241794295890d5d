"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors decide which pairs to recompute.

1. Equal vectors of a label are one class, which continues as its smallest vec_id.
2. Each vector is scaled to length 1 and turned by ROTATIONS random rotations.
   The signs of the first rotation are its binary code; with the inner product
   of code and vector (the stored correction factor f), <code, q> / f is an
   unbiased estimate of <vector, q>, and
   EPSILON * sqrt((1 - f^2) / f^2 / (d - 1)) bounds its error. The other vector q of an
   estimate comes in whole steps of one byte per dimension, with the length of
   what rounding left out; that length over f is added to the bound.
3. The signs of all rotations, BAND_BITS at a time, are band keys. Classes that
   share a key and a label meet in cells of bounded size, as codes, steps and keys only.
4. In a cell the estimates of both directions and their bounds sift the pairs. A pair is looked at
   only in the first band it shares. Classes with a pair that the bounds leave
   open are named; only they get their vectors, in that cell, where their open pairs are recomputed
   in double precision and linked at cosine >= THRESHOLD. A cell returns each vector's number of
   links and the links that join components, never all pairs.

At cosine 0.98 a 16-bit key of random signs agrees with probability 0.35, so 32
keys miss a pair with probability 1e-6. Nothing below the threshold is linked.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different lengths are not linked; very large and very small components neither overflow nor vanish; each row is a
vector, so rows that repeat a vec_id and its vector link with each other, and rows that repeat
a vec_id with other vectors are each judged by their own; rows without a vec_id link with
nothing and have no component; vectors of any length are compared whole; an empty table gives no rows; other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.graph import CELL as CELL_KEY
from tidemark.llm.graph import by_cell, cells, components, each_cell, numbers

THRESHOLD = 0.98
ROTATIONS = 8
BANDS = 32
BAND_BITS = 16
#: Width of the confidence bound: an estimate is off by more with probability below 1e-4.
EPSILON = 4.0
SEED = 7
CELL = 512


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows by powers of two, which change no digits, so that their largest entries lie between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turned unit vectors, correction factors, band keys) of the rows of ``x``."""
    d = x.shape[1]
    unit = units(x)
    need = -(-BANDS * BAND_BITS // d)
    turned = [unit @ rotation(d, SEED + i) for i in range(max(ROTATIONS, need))]
    factors = np.abs(turned[0]).sum(axis=1) / np.sqrt(d)
    signs = np.concatenate([t > 0 for t in turned], axis=1)[:, : BANDS * BAND_BITS]
    keys = np.packbits(signs.reshape(len(x), BANDS, BAND_BITS), axis=2).view(">u2")[:, :, 0]
    return turned[0], factors, keys.astype(np.int64)


def steps(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole steps of one byte, size of a step, length of what is left out) of each row."""
    size = np.abs(turned).max(axis=1) / 127
    whole = np.rint(turned / size[:, None])
    return whole.astype(np.int8), size, np.linalg.norm(turned - whole * size[:, None], axis=1)


_CODES = "id long, t long, factor double, step double, left_out double, keys array<short>, code array<byte>, steps array<byte>"


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _code_batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CODES.split(", ")]
    for batch in given:
        vectors = batch.column("vector").to_pylist()
        by_length: dict[int, list[int]] = {}
        for row, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(row)
        for rows in by_length.values():
            turned, factors, keys = codes(scaled(np.array([vectors[r] for r in rows], np.float64)))
            whole, size, left_out = steps(turned)
            code = np.packbits(turned > 0, axis=1).view(np.int8)
            own = batch.take(pa.array(rows))
            lists = (_lists(keys.astype(np.uint16).view(np.int16), pa.int16()), _lists(code, pa.int8()), _lists(whole, pa.int8()))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("t"), *map(pa.array, (factors, size, left_out)), *lists], names=names)


def _open_pairs(members: pa.Table, threshold: float) -> Callable[[int], np.ndarray]:
    """For a member of a cell the later ones that share no earlier band with it, and whose cosine the bounds leave open.

    In a cell of two parts only pairs of unlike sides are new.
    """
    factor, keys, side, left_out = (numbers(members, c) for c in ("factor", "keys", "side", "left_out"))
    band, crossing = members.column("band")[0].as_py(), members.column("cell_i")[0] != members.column("cell_j")[0]
    turned = numbers(members, "steps") * numbers(members, "step")[:, None]
    d = turned.shape[1]
    code = (np.unpackbits(numbers(members, "code").view(np.uint8), axis=1, count=d) * 2.0 - 1) / np.sqrt(d)
    bound = EPSILON * np.sqrt((1 - np.minimum(factor, 1) ** 2) / factor**2 / max(d - 1, 1)) + 1e-9

    def later(a: int) -> np.ndarray:
        rest = np.arange(a + 1, len(factor))
        if crossing:
            rest = rest[side[rest] != side[a]]
        rest = rest[(keys[rest, :band] != keys[a, :band]).all(axis=1)]
        rest = rest[(code[rest] @ turned[a] + left_out[a]) / factor[rest] + bound[rest] >= threshold]
        return rest[(turned[rest] @ code[a] + left_out[rest]) / factor[a] + bound[a] >= threshold]

    return later


def _open_batches(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of each cell that have an open pair there: rows of the cell, never its pairs."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in each_cell(given):
            later, found = _open_pairs(members, threshold), np.zeros(members.num_rows, bool)
            for a in range(members.num_rows - 1):
                rest = later(a)
                found[rest] = True
                found[a] |= len(rest) > 0
            if found.any():
                yield from members.select([*CELL_KEY, "id", "t"]).filter(pa.array(found)).combine_chunks().to_batches()

    return batches


def _cell_pairs(members: pa.Table, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links per member, links that join components) of one cell."""
    id, copies, x, later = numbers(members, "id"), numbers(members, "copies"), scaled(numbers(members, "vector")), _open_pairs(members, threshold)
    norms = np.linalg.norm(x, axis=1)
    n_links = np.zeros(len(id), np.int64)
    label, links = np.arange(len(id)), []
    for a in range(len(id) - 1):
        rest = later(a)
        cosine = np.einsum("ij,j->i", x[rest], x[a]) / (norms[rest] * norms[a])
        near = rest[cosine >= threshold]
        n_links[a] += copies[near].sum()
        n_links[near] += copies[a]
        for b in near[label[near] != label[a]]:
            if label[b] != label[a]:
                links.append((int(id[a]), int(id[b])))
                label[label == label[b]] = label[a]
    return n_links, links


def _cell_batches(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in each_cell(given):
            n_links, links = _cell_pairs(members, threshold)
            id, linked = numbers(members, "id"), np.flatnonzero(n_links)
            a = [*id[linked].tolist(), *(x for x, _ in links)]
            t = [*numbers(members, "t")[linked].tolist(), *[None] * len(links)]
            b = [*[None] * len(linked), *(y for _, y in links)]
            n = [*n_links[linked].tolist(), *[0] * len(links)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, t, b, n)], names=["a", "t", "b", "n"])

    return batches


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``id``, n_links, component_id, kept (``id`` is its component's smallest)."""
    double = F.col(embedding).cast("array<double>")
    given = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), double.alias("vector"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("vector", good) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    rows = stored(given.withColumn("usable", usable), "vectors")
    classes = stored(rows.where("usable").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("t", F.xxhash64("label", "vector")), "classes")
    # Where rows repeat a vec_id with other vectors, it stands for several classes, told apart by t.
    coded = stored(classes.select("id", "t", "vector").mapInArrow(_code_batches, _CODES), "codes")
    in_bands = coded.select("id", "t", F.posexplode("keys").alias("band", "key")).join(classes.select("id", "t", "label", F.size("vector").alias("d")), ["id", "t"])
    in_bands = stored(in_bands.withColumn("bucket", F.xxhash64("label", "d", "band", "key")), "bands")
    shared = stored(in_bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    dealt = cells(stored(in_bands.join(shared, "bucket", "left_semi").select("bucket", "band", "id", "t"), "hits"), "bucket", "id", F.lit(1), CELL)
    full = dealt.join(coded, ["id", "t"])
    named = stored(by_cell(full).mapInArrow(_open_batches(threshold), "bucket long, cell_i int, cell_j int, id long, t long"), "open")
    met = full.join(named, [*CELL_KEY, "id", "t"]).join(classes.select("id", "t", "vector", "copies"), ["id", "t"])
    found = stored(by_cell(met).mapInArrow(_cell_batches(threshold), "a long, t long, b long, n long"), "links")
    joined = stored(components(found.where("b is not null").select("a", "b")), "components")
    n_links = found.where("n > 0").groupBy(F.col("a").alias("first"), "t").agg(F.sum("n").alias("n"))
    of_class = (
        classes.select("label", "vector", F.col("id").alias("first"), "t", "copies")
        .join(n_links, ["first", "t"], "left")
        .join(joined.withColumnRenamed("id", "first"), "first", "left")
        .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "first").alias("c"), F.lit(True).alias("usable"))
    )
    return rows.join(stored(of_class, "of-class"), ["label", "vector", "usable"], "left").select(
        F.col("id").alias(id),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON r.id = l.x
), m AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.x = vec_id
"""
