"""Chat formatting over a prefix tree: conversations that begin alike share their first turns.

A node is a turn with all turns before it, named by the XOR of two 64-bit hashes of each of these
turns and their depths; so prefixes are named by running XORs over ranges of (conversation, depth), and
a conversation of any length is spread over many tasks. Each distinct node is formatted once;
a tree's nodes are laid out depth first, one after the other, so that shared
turns are emitted once. Each node gets

* ``start``: its place in the tree's sequence (code points), from running totals
  over ranges of (tree, path, depth), so a tree of any size is spread over many tasks;
* ``position``: the position id of its first code point, which is the length of its ancestors;
* ``ancestors``: the intervals of the sequence that it may attend to besides
  itself, ascending and joined where they touch;
* ``loss_begin``, ``loss_end``: the part of its text that is trained on (an assistant's words).

The conversation with the smallest id among those that hold a node owns it. What a conversation owns
is the rest of its turns from some depth on: a chain. A path names only the chains on the way from the
root and the depths at which they leave each other, so it does not grow with the turns. A chain is laid out
first and then the chains that leave it, the deepest first, which is an order depth first; ancestors are one interval for each chain.

The template is ``### role: text</turn>`` and a line feed. Inside texts a
backslash becomes ``\\\\``, the ``#`` of ``###`` becomes ``\\h`` and the ``<`` of
``</turn>`` becomes ``\\l``; in roles also ``:`` becomes ``\\c`` and a line feed ``\\n``. So
neither mark can occur inside a text, and what was written can be read back.

Defined cases: a null text or role is empty; rows of a conversation are ordered
by turn (null first), then role, the text's first HEAD code points and its digest, and rows that repeat a turn are turns of their
own; a row without a conv_id is a conversation of its own, without an id in the result; a conversation or a text of any length
is formatted whole; an empty table gives no rows; other columns play no part, whatever their names.
``read_conversations`` digests a conversation in order, so in one task, which holds a batch of its turns at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import running_totals, stored, table

TURN, END = "### ", "</turn>\n"
ASSISTANT = "assistant"
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_IN_ROLE = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, begin and end of the part that is trained on; both 0 for other roles)."""
    head, body = TURN + escape(role or "", _IN_ROLE) + ": ", escape(text or "")
    trained = role == ASSISTANT
    return head + body + END, len(head) if trained else 0, len(head) + len(body) if trained else 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


#: Code points of a text by which turns that agree in turn and role are ordered before their digests.
HEAD = 64
#: Turns formatted together.
PART = 1000
_MADE = [
    T.StructField("head", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("length", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("loss_begin", T.LongType()), T.StructField("loss_end", T.LongType()),
]


def _format_batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in (whole.slice(i, PART) for whole in given for i in range(0, whole.num_rows, PART)):
        rows = []
        for role, plain in zip(batch.column("role").to_pylist(), batch.column("plain").to_pylist()):
            text, begin, end = format_turn(role, plain)
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            rows.append(((plain or "")[:HEAD], digest, len(text), text, begin, end))
        names = [c for c in batch.schema.names if c != "plain"]
        made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *(f.name for f in _MADE)])


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending intervals, those that touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in intervals:
        if out and out[-1][1] == begin:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _ancestor_batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals before each node: of every chain on its way the part up to where the next one leaves it."""
    for batch in given:
        spans = []
        for start, chains in zip(batch.column("start").to_pylist(), batch.column("chains").to_pylist()):
            ways = [(x["start"], x["start"] + y["position"] - x["position"]) for x, y in zip(chains, chains[1:])]
            last = chains[-1]["start"]
            spans.append([{"begin": a, "end": b} for a, b in merged([*ways, *([(last, start)] if start > last else [])])])
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(spans, _SPANS)], names=["node", "ancestors"])


#: What names a conversation: its id, and for rows without one (id 0 here) a number of their own.
CONV = ["solo", "c"]


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (CONV, depth, digest, length, ...) with node, parent and position: running XORs and sums over ranges, as in ``running_totals``."""
    own = {"x": F.xxhash64("depth", "digest", F.lit(1)), "y": F.xxhash64(F.lit(2), "digest", "depth")}
    ranged = stored(turns.withColumns(own).repartitionByRange(*CONV, "depth").withColumn("part", F.spark_partition_id()), "chat-ranges")
    inside = Window.partitionBy("part", *CONV).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns({"nx": F.bit_xor("x").over(inside), "ny": F.bit_xor("y").over(inside), "so_far": F.sum("length").over(inside)})
    totals = ranged.groupBy(*CONV, "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"), F.sum("length").alias("tl"))
    earlier = Window.partitionBy(*CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(c.over(earlier), F.lit(0).cast("long"))
    offsets = totals.select(*CONV, "part", before(F.bit_xor("tx")).alias("bx"), before(F.bit_xor("ty")).alias("by"), before(F.sum("tl")).alias("bl"))
    joined = rows.join(offsets, [*CONV, "part"]).withColumns({"nx": F.col("nx").bitwiseXOR(F.col("bx")), "ny": F.col("ny").bitwiseXOR(F.col("by"))})
    name = lambda x, y: F.unhex(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))
    parent = name(F.col("nx").bitwiseXOR(F.col("x")), F.col("ny").bitwiseXOR(F.col("y")))
    return joined.select(
        *turns.columns, name(F.col("nx"), F.col("ny")).alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), (F.col("so_far") + F.col("bl") - F.col("length")).alias("position")
    )


def chat_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sequences, members).

    ``sequences`` has one row per node: tree, node, parent, depth, start, length,
    position, ancestors, text, loss_begin, loss_end; ``members`` has the nodes of
    each conversation: conv, depth, node, and solo, which tells conversations without an id apart. Both are stored.
    """
    given = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("plain"))
    given = given.withColumn("row", F.monotonically_increasing_id())
    given = given.withColumns({"c": F.coalesce("conv", F.lit(0).cast("long")), "solo": F.when(F.col("conv").isNull(), F.col("row")).otherwise(F.lit(-1).cast("long"))})
    kept = [f for f in given.schema.fields if f.name != "plain"]
    rows = stored(given.mapInArrow(_format_batches, T.StructType([*kept, *_MADE])), "chat-turns")

    order = ["turn", "role", "head", "digest"]
    small = rows.select("row", "conv", *CONV, *order, "length", F.lit(1).cast("long").alias("one"))
    numbered = running_totals(small, CONV, order, "one", "depth").select("row", "conv", *CONV, "depth", "digest", "length")
    members = stored(_prefixes(numbered).drop("digest"), "chat-members")

    # The conversation that owns a node, and its row of it.
    nodes = stored(members.groupBy("node").agg(F.min(F.struct(*CONV, "row", "length", "position", "depth", "parent")).alias("own")).select("node", "own.*"), "chat-nodes")
    owners = nodes.select("node", F.col("solo").alias("of_solo"), F.col("c").alias("of_c"))
    hops = members.join(owners, "node").groupBy(*CONV, "of_solo", "of_c").agg(
        F.min(F.struct("depth", "position")).alias("at"), F.max(F.when(F.col("depth") == 0, F.col("node"))).alias("root")
    )
    # Only conversations that own something are chains; the first chain of a way needs no name.
    hop = F.struct(F.col("at.depth").alias("depth"), F.col("of_solo").alias("solo"), F.col("of_c").alias("c"), F.col("at.position").alias("position"))
    owns = F.max((F.col("of_solo") == F.col("solo")) & (F.col("of_c") == F.col("c")))
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    left = lambda h: F.concat(wide(F.lit(2**62) - h["depth"]), wide(h["solo"]), wide(h["c"]))
    chains = hops.groupBy(*CONV).agg(F.sort_array(F.collect_list(hop)).alias("way"), F.max("root").alias("tree"), owns.alias("owns")).where("owns")
    chains = stored(chains.select(*CONV, "tree", "way", F.array_join(F.transform(F.slice("way", 2, F.size("way")), left), "").alias("path")), "chat-chains")

    placed = nodes.join(chains.select(*CONV, "tree", "path"), CONV).select("node", *CONV, "tree", "path", "depth", "length")
    starts = stored(running_totals(placed, ["tree"], ["path", "depth"], "length", "start").select("node", *CONV, "tree", "start"), "chat-starts")
    firsts = starts.groupBy(*CONV).agg(F.min("start").alias("start"))
    steps = chains.select(F.struct(*CONV).alias("chain"), F.explode("way").alias("h")).select("chain", F.col("h.solo").alias("solo"), F.col("h.c").alias("c"), "h.depth", "h.position")
    ways = steps.join(stored(firsts, "chat-firsts"), CONV).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "position"))).alias("chains"))
    ways = stored(ways.select("chain.*", "chains"), "chat-ways")
    ancestors = starts.join(ways, CONV).select("node", "start", "chains").mapInArrow(_ancestor_batches, "node binary, ancestors array<struct<begin: long, end: long>>")
    texts = rows.select("row", "text", "loss_begin", "loss_end")
    sequences = nodes.join(starts.select("node", "tree", "start"), "node").join(stored(ancestors, "chat-ancestors"), "node").join(texts, "row")
    out = sequences.select("tree", "node", "parent", "depth", "start", "length", "position", "ancestors", "text", "loss_begin", "loss_end")
    return stored(out, "chat-sequences"), members.select("conv", "solo", "depth", "node")


_READ_KINDS = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Read:
    """What one conversation's nodes hold, turn by turn."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss, self.length = conv, 0, 0, 0
        self.told, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int, end: int) -> None:
        for role, text in read_turns(formatted):
            self.n += 1
            self.told.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        trained = unescape(formatted[begin:end])
        self.trained.update(trained.encode("utf-8", "surrogatepass"))
        self.loss += len(trained)
        self.length += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.told.hexdigest(), self.loss, self.trained.hexdigest(), self.length


def _read_batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    key, read = None, None
    for batch in given:
        rows = []
        for conv, solo, text, begin, end in zip(*(batch.column(c) for c in ("conv", "solo", "text", "loss_begin", "loss_end"))):
            if key != (conv.as_py(), solo.as_py()):
                if read:
                    rows.append(read.row())
                key = conv.as_py(), solo.as_py()
                read = _Read(key[0])
            read.add(text.as_py(), begin.as_py(), end.as_py())
        if rows:
            yield made(rows)
    if read:
        yield made([read.row()])


def read_conversations(sequences: DataFrame, members: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation what its nodes hold: number and digest of the turns, length and digest of the part trained on, length."""
    joined = members.join(sequences.select("node", "text", "loss_begin", "loss_end"), "node")
    dealt = joined.repartition("conv", "solo").sortWithinPartitions("conv", "solo", "depth")
    return dealt.select("conv", "solo", "text", "loss_begin", "loss_end").mapInArrow(_read_batches, _READ_KINDS).withColumnRenamed("conv", conv)


#: The conversation that is added to the given ones.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_conversations(*chat_tree(given.unionByName(extra)))


# The formatted length adds, per turn, the marks (14 code points), the role and one for each escaped character.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), l AS (
  SELECT *, length(text) - length(replace(text, '\', '')) AS slashes,
         (length(text) - length(replace(text, '</turn>', ''))) // 7 AS ends,
         list_sum([greatest(length(x) - 2, 0) FOR x IN regexp_extract_all(text, '#+')]) AS hashes
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(text) + slashes + ends + coalesce(hashes, 0))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
