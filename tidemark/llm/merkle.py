"""Merkle manifest of a dataset: every row a leaf, a tree per group, a tree over the groups, and a proof per row.

A leaf is the SHA-256 of its row's fields. Per group the leaves stand in order;
while several nodes remain, every ``arity`` consecutive ones become the SHA-256
of their digests. What remains is the group's subroot; the subroots, by group
(null first, then UTF-8 bytes), give the root in the same way.

Time-forward processing: nodes are labelled so that children come before their
parents, and are worked off in the order of their labels. A node sends its digest
to its parent through a priority queue ordered by label; when a label is due, the
messages at the head of the queue are the parent's children. The queue is
external: the sequence is cut into blocks of ``arity ** BLOCK_LEVELS`` nodes, a
message to a node above the block is a row of a table that Spark shuffles and sorts
by label (both spill to disk), and only what is due inside a block waits in a heap,
at most ``arity`` messages a level. A reversed sweep over the same labels, the largest first,
then delivers to every node the part of the proof that lies above it, block by block
down to the leaves. So no task holds more than one block, whatever the group's size,
and a group's blocks are spread over all tasks.

A proof is an array, from the leaf upwards, of (before, after): the digests left and
right of the node in its run, as text. ``fold`` recomputes the root from a leaf
and its proof.

Defined cases: a null field counts as ``-``, so it differs from an empty one; a group's
rows without an order value come first, rows that tie stand in the order of
their digests, and equal rows are leaves of their own; rows without a group form one group, the first; texts
of any length are hashed whole, and only their digests are shuffled; a lone leaf is its own subroot, a lone
subroot the root, and their proofs are empty; an empty table has no rows and no root; input columns named
like the added ones are left out of the result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import running_totals, stored, table, unused

ARITY = 3
#: Levels of the tree within a block; a block has at most ARITY ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 6
PROOF = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
_PROOF_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
ADDED = ["subroot", "root", "proof"]


def leaf_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each as UTF-8 byte count, ``:`` and value, or ``-`` for null."""

    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, run: F.sha2(F.concat(run["before"], digest, run["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def block_nodes(digests: list[str], levels: int | None, arity: int = ARITY) -> tuple[list[list[str]], int]:
    """All nodes of one block, by level, and the level of its top.

    ``levels``: how far to go up; None for until one node is left. A label is
    (last leaf below the node in a full tree, level).
    """
    height = 0
    while arity**height < len(digests):
        height += 1
    height = height if levels is None else levels
    nodes: list[list[str]] = [[] for _ in range(height + 1)]
    due: list[tuple[int, int, int, str]] = []

    def send(level: int, digest: str) -> None:
        index = len(nodes[level])
        nodes[level].append(digest)
        if level < height:
            parent = index // arity
            heapq.heappush(due, ((parent + 1) * arity ** (level + 1) - 1, level + 1, index, digest))

    def receive() -> None:
        label, children = due[0][:2], []
        while due and due[0][:2] == label:
            children.append(heapq.heappop(due)[3])
        send(label[1], _hash(children))

    for position, digest in enumerate(digests):
        while due and due[0][0] < position:
            receive()
        send(0, digest)
    while due:
        receive()
    return nodes, height


def block_proofs(nodes: list[list[str]], height: int, above: list[tuple[str, str]], arity: int = ARITY) -> list[list[tuple[str, str]]]:
    """The proof of every leaf of a block whose top has the proof ``above``: the labels in reverse, the largest first."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in nodes[0]]
    due = [(-(arity**height - 1), -height, 0, above)]
    while due:
        _, level, index, proof = heapq.heappop(due)
        level = -level
        if not level:
            proofs[index] = proof
            continue
        first = index * arity
        run = nodes[level - 1][first : first + arity]
        for i, _ in enumerate(run):
            siblings = ("".join(run[:i]), "".join(run[i + 1 :]))
            # A node alone in its run has no siblings, but its parent is still the hash of its digest.
            heapq.heappush(due, (-((first + i + 1) * arity ** (level - 1) - 1), 1 - level, first + i, [siblings, *proof]))
    return proofs


def _whole_blocks(batches: Iterator[pa.RecordBatch], group: str, block: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows in tables that end where a block ends, with the places where blocks begin and the table's length."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        cuts = _cuts(held, group, block)
        if len(cuts) > 2:
            yield held.slice(0, cuts[-2]), cuts[:-1]
            held = held.slice(cuts[-2])
    if held is not None:
        yield held, _cuts(held, group, block)


def _cuts(rows: pa.Table, group: str, block: str) -> list[int]:
    keys = list(zip(rows.column(group).to_pylist(), rows.column(block).to_pylist()))
    return [i for i, k in enumerate(keys) if not i or k != keys[i - 1]] + [len(keys)]


def _levels(block: int, rows: int, arity: int, most: int) -> int | None:
    """A group's only block, if it is not full, ends with one node; all others go up ``most`` levels."""
    return None if block == 0 and rows < arity**most else most


def _up(arity: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_blocks(given, "g", "block"):
            g, block, digest = (rows.column(c).to_pylist() for c in ("g", "block", "digest"))
            tops = []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                nodes, height = block_nodes(digest[begin:end], _levels(block[begin], end - begin, arity, most), arity)
                tops.append((g[begin], block[begin], nodes[height][0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tops), (pa.string(), pa.int64(), pa.string()))], names=["g", "pos", "digest"])

    return batches


def _down(names: dict[str, str], columns: list[str], arity: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``names``: g, block, digest, above and subroot. The first row of a block brings the proof above it."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_blocks(given, names["g"], names["block"]):
            block, digest, above = (rows.column(names[c]).to_pylist() for c in ("block", "digest", "above"))
            subroots = rows.column(names["subroot"]).to_pylist()
            before, after, ends, subroot, keep = [], [], [0], [], []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                nodes, height = block_nodes(digest[begin + 1 : end], _levels(block[begin], end - begin - 1, arity, most), arity)
                for proof in block_proofs(nodes, height, [(r["before"], r["after"]) for r in above[begin]], arity):
                    before += [b for b, _ in proof]
                    after += [a for _, a in proof]
                    ends.append(len(before))
                subroot += [subroots[begin]] * (end - begin - 1)
                keep += range(begin + 1, end)
            leaves = rows.select(columns).take(pa.array(keep, pa.int64())).combine_chunks()
            runs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
            proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs).cast(_PROOF_ARROW)
            out = leaves.append_column("proof", proofs).append_column("subroot", pa.array(subroot, pa.string()))
            yield from out.to_batches()

    return batches


def _blocks(nodes: DataFrame, pos: str, block: str, size: int) -> DataFrame:
    return nodes.withColumn(block, F.floor(F.col(pos) / F.lit(size)).cast("long"))


def _sweep_up(nodes: DataFrame, arity: int, most: int) -> list[DataFrame]:
    """The given nodes (g, pos, digest), then the tops of their blocks, and so on until each g has one node.

    What reaches the driver is the largest position of each round.
    """
    rounds = [nodes]
    while (rounds[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        dealt = _blocks(rounds[-1], "pos", "block", arity**most).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
        rounds.append(stored(dealt.select("g", "block", "digest").mapInArrow(_up(arity, most), "g string, pos long, digest string"), "merkle-up"))
    return rounds


def _sweep_down(nodes: DataFrame, heads: DataFrame, arity: int, most: int, g: str = "g", pos: str = "pos", digest: str = "digest") -> DataFrame:
    """``nodes`` with ``proof`` and ``subroot``, from ``heads`` (g, pos of the block, proof, subroot)."""
    columns = nodes.columns
    names = {"g": g, "digest": digest}
    for c in ("block", "head", "above", "subroot"):
        names[c] = unused([*columns, *names.values()], f"_{c}")
    rows = _blocks(nodes, pos, names["block"], arity**most).withColumns(
        {names["head"]: F.lit(1), names["above"]: F.lit(None).cast(PROOF), names["subroot"]: F.lit(None).cast("string")}
    )
    first = heads.select(
        F.col("g").alias(g), F.col("pos").alias(names["block"]), F.lit(0).alias(names["head"]), F.col("proof").cast(PROOF).alias(names["above"]), F.col("subroot").alias(names["subroot"])
    )
    dealt = rows.unionByName(first, allowMissingColumns=True).repartition(g, names["block"]).sortWithinPartitions(g, names["block"], names["head"], pos)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in nodes.schema], T.StructField("proof", PROOF), T.StructField("subroot", T.StringType())])
    return dealt.mapInArrow(_down(names, columns, arity, most), schema)


def proofs(leaves: DataFrame, digest: str = "leaf", group: str = "source", order: str = "doc_id", arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof`` of every row."""
    leaves = leaves.select(*[c for c in leaves.columns if c.lower() not in ADDED])
    columns = leaves.columns
    g, one, pos = (unused(columns, c) for c in ("_g", "_one", "_pos"))
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    placed = stored(running_totals(leaves.withColumns({g: key, one: F.lit(1)}), [g], [order, digest], one, pos), "merkle-leaves").drop(one)

    rounds = _sweep_up(placed.select(F.col(g).alias("g"), F.col(pos).alias("pos"), F.col(digest).alias("digest")), arity, block_levels)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest", F.lit(1).alias("one"))
    tops = _sweep_up(stored(running_totals(subroots, ["g"], ["of"], "one", "pos").select("g", "of", "pos", "digest"), "merkle-subroots"), arity, block_levels)
    top = tops[-1].first()
    root = top["digest"] if top else None

    nothing = F.array().cast(PROOF)
    heads = tops[-1].select("g", "pos", nothing.alias("proof"), F.col("digest").alias("subroot"))
    for nodes in reversed(tops[:-1]):
        heads = stored(_sweep_down(nodes, heads, arity, block_levels), "merkle-down")
    if len(tops) == 1:
        heads = heads.join(tops[0].select("g", "of", "digest"), "g")
    heads = heads.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"))
    for nodes in reversed(rounds[1:-1]):
        heads = stored(_sweep_down(nodes, heads, arity, block_levels).select("g", "pos", "proof", "subroot"), "merkle-down")
    if len(rounds) == 1:
        # No group has a second node: every leaf is a subroot.
        heads = heads.withColumnRenamed("g", g).select(g, "proof", "subroot")
        return placed.join(heads, g).select(*columns, "subroot", F.lit(root).cast("string").alias("root"), "proof")
    return _sweep_down(placed, heads, arity, block_levels, g, pos, digest).select(*columns, "subroot", F.lit(root).cast("string").alias("root"), "proof")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per document its leaf, subroot, root, the proof's digest, and whether a copy of it, tampered with as the query says, still leads to the root."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest(*[F.col(c) for c in [*fields, "text"]]).alias("leaf"), leaf_digest(*[F.col(c) for c in fields], tampered).alias("given"))
    proved = proofs(leaves, block_levels=block_levels).withColumn("folded_root", fold(F.col("given"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str) -> str:
    """The CTE ``name``: all nodes of the trees over ``leaves`` (g, pos, n, digest)."""
    return f"""
{name}(lvl, g, pos, n, digest) AS (
  SELECT 0, g, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT lvl + 1, g, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY lvl, g, pos // {ARITY}, n
)"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ["doc_id", "source", "lang", "n_chars"])
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT)"
)

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS g, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
         sha256({_LEAF} || {_FIELD.format(f"(CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS given
  FROM documents
), placed AS (
  SELECT rid, doc_id, g, leaf AS digest, given, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS n
  FROM d
), {_tree_sql("t", "placed")}, subs AS (
  SELECT g AS of, '' AS g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), {_tree_sql("u", "subs")}, steps AS (
  SELECT lvl, '' AS tree, g, pos, digest FROM t WHERE n > 1 UNION ALL SELECT lvl, 'u', g, pos, digest FROM u WHERE n > 1
), runs AS (
  SELECT a.tree, a.lvl, a.g, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS before, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS after
  FROM steps a JOIN steps b ON a.tree = b.tree AND a.lvl = b.lvl AND a.g = b.g AND a.pos // {ARITY} = b.pos // {ARITY} GROUP BY ALL
), sides AS (
  SELECT tree, lvl, g, pos, coalesce(before, '') AS before, coalesce(after, '') AS after FROM runs
), low(rid, lvl, g, pos, proof, folded) AS (
  SELECT rid, 0, g, pos, '', given FROM placed
  UNION ALL
  SELECT rid, l.lvl + 1, l.g, l.pos // {ARITY}, proof || before || after, sha256(before || folded || after) FROM low l JOIN sides s ON s.tree = '' AND s.lvl = l.lvl AND s.g = l.g AND s.pos = l.pos
), subbed AS (
  SELECT rid, s.digest AS subroot, s.pos, proof, folded FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) AS r FROM low) l JOIN subs s ON s.of = l.g WHERE r = 1
), high(rid, lvl, subroot, pos, proof, folded) AS (
  SELECT rid, 0, subroot, pos, proof, folded FROM subbed
  UNION ALL
  SELECT rid, l.lvl + 1, subroot, l.pos // {ARITY}, proof || before || after, sha256(before || folded || after) FROM high l JOIN sides s ON s.tree = 'u' AND s.lvl = l.lvl AND s.pos = l.pos
), ended AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) AS r FROM high) WHERE r = 1
), root AS (
  SELECT digest AS root FROM u WHERE n = 1
)
SELECT doc_id, p.digest AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed p JOIN ended USING (rid) CROSS JOIN root
"""
