"""Line dedup with a log-template tree: lines that recur across different documents are dropped.

The tree's first levels are fixed: token count, then the first DEPTH tokens. Tokens
with a digit, an @ or a :// are variable fields (``<*>``). A line that would
keep less than half of its tokens is not masked: it recurs only word for word.
Two kinds of templates exist:

* the masked line itself;
* generalised lines, any number in a leaf. Of the lines of a node, a template has at
  each position the token that more than half of them have (weighed by documents), or
  ``<*>``. If at least half of its positions are tokens and lines belong to it, they form
  a template, and the node goes on with the others. A line belongs to a template if it has its
  token at SIMILAR of the positions or more, not counting the first DEPTH. If there is no such
  template, the node is split at the position of its most frequent token that not
  all lines have: every token that enough documents have there makes a node, the rest another;
  without such a token the node ends.

A passage may stand on several lines. So runs of consecutive lines (blank ones
aside) are templates too, named by the hashes of their lines: from every line
shorter than LONG_WORDS on, and back from every such line, the fewest lines that
have LONG_WORDS words together. Both ways, so that no line of a passage of
LONG_WORDS words or more is left out. Where a run recurs, its lines go there,
and stay where they stand elsewhere.

A template recurs when documents of enough copy groups hold it. Documents that
hold a template often enough to matter are grouped as by ``near_dedup``, on their full
shingle sets, at COPY_PERCENT; a group counts once, however large, and is left for document
dedup. Two documents that share a passage only are two groups, however short
they are.

One pass reads the texts and leaves hashes of lines and runs. A second one makes tokens of the lines that are
not alone in their leaf, and the sketches that ``near_dedup`` works on, of the texts that hold a frequent template or such a line.
Bloom filters of bounded size tell which (what they let through besides goes in a join). Texts are shuffled only for
likely copies that the sketches do not settle, and for the final join. Nodes of up to NODE_TOKENS tokens are worked off
within a task; larger ones, such as a leaf with a third of all lines, go through the same
steps as aggregates and joins until their parts are small. So the result does not depend on the limit.

Defined cases: blank lines are never dropped or counted; a null text stays
null; a line repeated within one document counts once; repeated rows are one
group; an empty table gives an empty result; texts are compared whole, at any
length; among tokens that are equally frequent, the first position and then the larger hash decides; added columns
take an underscore in front if the input has their name. Lines are compared by hashes of 63 bits, tokens by 32.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, table, unused
from tidemark.llm.near_dedup import SKETCH_ARROW, chunks, class_components, sketches
from tidemark.llm.words import Words, in_order, mix, word_hash

DEPTH = 3
#: Copy groups a template must be in: short lines, and lines of LONG_WORDS words or more.
MIN_DOCS = 5
LONG_WORDS = 30
LONG_MIN_DOCS = 2
SIMILAR = 0.6
#: Similarity of copies, as in the pipeline's near-duplicate stage.
COPY_PERCENT = 80
#: Rows whose texts are rewritten together.
PART = 500
WILD = b"<*>"
WILD_WORD = word_hash(WILD)
WILD_HASH = int(np.uint32(WILD_WORD >> 32).view(np.int32))


class Lines:
    """The lines of some texts that have words: ``n`` words, hash ``h``, ``leaf`` (0: none), ``line`` (number in its text), by array operations.

    ``text`` has the first line of each text, and their number.
    """

    def __init__(self, words: Words):
        first, self.line, self.text = words.lines()
        total = len(words.begin)
        self.first, self.n = first, np.diff(np.append(first, total))
        tokens, fields = words.hashes(), words.fields()
        masked = np.add.reduceat(fields, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
        self.general = 2 * masked <= self.n
        self.tokens = np.where(fields & np.repeat(self.general, self.n), np.uint64(WILD_WORD), tokens)
        placed = in_order(self.tokens, first, self.n)
        sums = np.add.reduceat(placed, first) if len(first) else placed
        self.h = (mix(sums + self.n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        leafy = np.flatnonzero(self.general & (self.n > DEPTH))
        self.leaf = np.zeros(len(first), np.int64)
        lead = sum(placed[first[leafy] + j] for j in range(DEPTH)) if len(leafy) else np.empty(0, np.uint64)
        self.leaf[leafy] = (mix(mix(lead) + self.n[leafy].astype(np.uint64)) >> np.uint64(1)).astype(np.int64) | 1

    def of(self, i: int) -> tuple[list[int], list[int], list[int]]:
        """(n, h, line) of the lines of text ``i``."""
        own = slice(self.text[i], self.text[i + 1])
        return self.n[own].tolist(), self.h[own].tolist(), self.line[own].tolist()


def runs(sizes: list[int], hashes: list[int]) -> dict[tuple[int, int], int]:
    """{(first, last): key} of the runs of lines with these numbers of words and template hashes."""
    ends = set()
    last = words = 0
    for first, size in enumerate(sizes):  # forward: [first, last) has LONG_WORDS words
        while last < len(sizes) and words < LONG_WORDS:
            words += sizes[last]
            last += 1
        if words >= LONG_WORDS and last - first > 1:
            ends.add((first, last - 1))
        words -= size
    first = words = 0
    for last, size in enumerate(sizes):  # back: [first, last] has LONG_WORDS words, and no fewer lines do
        words += size
        while words - sizes[first] >= LONG_WORDS:
            words -= sizes[first]
            first += 1
        if words >= LONG_WORDS and last > first:
            ends.add((first, last))
    packed = np.array(hashes, "<i8").tobytes()
    return {(i, j): xxhash.xxh3_64_intdigest(b"run " + packed[8 * i : 8 * j + 8]) >> 1 for i, j in ends}


#: Tokens in one node that a task works off by itself.
NODE_TOKENS = 1 << 19
_ROWS = "d long, h long, leaf long, n int"
_ROWS_ARROW = [("d", pa.int64()), ("h", pa.int64()), ("leaf", pa.int64()), ("n", pa.int32())]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines and, without leaf, runs of lines of each text (_ROWS)."""
    for batch in batches:
        for begin, texts in chunks(batch.column("text")):
            lines = Lines(Words(texts))
            d, h, leaf, n = [], [], [], []
            for i, own in enumerate(batch.column("d").slice(begin, len(texts)).to_pylist()):
                sizes, hashes, _ = lines.of(i)
                found = {x: (y, z) for x, y, z in zip(hashes, sizes, lines.leaf[lines.text[i] : lines.text[i + 1]].tolist())}
                for (first, last), key in runs(sizes, hashes).items():
                    found.setdefault(key, (sum(sizes[first : last + 1]), 0))
                d += [own] * len(found)
                h += found
                n += [x for x, _ in found.values()]
                leaf += [x or None for _, x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((d, h, leaf, n), _ROWS_ARROW)], names=[c for c, _ in _ROWS_ARROW])


#: Bits of a filter for each of its keys and at most; places of a key in it.
FILTER_BITS, FILTER_MOST, FILTER_PLACES = 16, 1 << 30, 4


def _filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.astype(np.uint64))
    return np.stack([(mix(h + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(FILTER_PLACES)])


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the one column: (bits, packed). FILTER_MOST bits at most, so its size is bounded; a fuller one lets more through."""
    bits = 1 << 16
    while bits < min(FILTER_BITS * keys.count(), FILTER_MOST):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_filter_places(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    packed = np.zeros(bits >> 6, np.int64)
    rows = keys.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return bits, packed


def _passes(keys: np.ndarray, bits: int, packed: np.ndarray) -> np.ndarray:
    at = _filter_places(keys, bits)
    return ((packed[at >> 6] >> (at & 63)) & 1).all(axis=0).astype(bool)


_SECOND = "d long, leaf long, h long, n int, tokens array<int>, key binary, bands array<long>, odd array<long>"
_SECOND_ARROW = [("d", pa.int64()), ("leaf", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int32())), *[(c, t) for c, t in SKETCH_ARROW if c != "n"]]


def _second_pass(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the texts that the first filter lets through, the SKETCH and, for lines whose leaf the second one does, (leaf, h, n, tokens)."""
    names = [c for c, _ in _SECOND_ARROW]

    def filled(given: dict[str, pa.Array], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(size, t) for c, t in _SECOND_ARROW], names=names)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts, of_leaves = sent.value
        for whole in given:
            batch = whole.filter(pa.array(_passes(whole.column("d").to_numpy(), *of_texts)))
            for begin, texts in chunks(batch.column("text")):
                words = Words(texts)
                lines = Lines(words)
                hit = np.flatnonzero(_passes(lines.leaf, *of_leaves) & (lines.leaf != 0))
                _, once = np.unique(lines.h[hit], return_index=True)
                hit = hit[once]
                n = lines.n[hit]
                ends = np.concatenate([[0], np.cumsum(n)])
                places = np.arange(ends[-1]) + np.repeat(lines.first[hit] - ends[:-1], n)
                tokens = (lines.tokens[places] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))
                yield filled({"leaf": pa.array(lines.leaf[hit]), "h": pa.array(lines.h[hit]), "n": pa.array(n, pa.int32()), "tokens": lists}, len(hit))
                size, *more = sketches(words, COPY_PERCENT)
                sketch = {"d": batch.column("d").slice(begin, len(texts)), "n": size.cast(pa.int32())} | dict(zip(("key", "bands", "odd"), more))
                yield filled(sketch, len(texts))

    return batches


def node_step(tokens: np.ndarray, weights: np.ndarray, need: int) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """One step of a node of lines (rows of tokens): (members of its template, or None; the nodes that go on, as masks)."""
    m, n = tokens.shape
    total = int(weights.sum())
    keys = (np.arange(n, dtype=np.int64) << 32) + (tokens.astype(np.int64) + (1 << 31))
    _, at = np.unique(keys, return_inverse=True)
    at = at.reshape(m, n)
    c = np.bincount(at.ravel(), weights=np.repeat(weights, n)).astype(np.int64)[at]
    best = c.argmax(axis=0)
    fixed = (2 * c.max(axis=0) > total) & (tokens[best, np.arange(n)] != WILD_HASH)
    if 2 * fixed.sum() >= n:
        equal = ((tokens == tokens[best, np.arange(n)]) & fixed)[:, DEPTH:].sum(axis=1)
        members = equal >= SIMILAR * (n - DEPTH)
        if members.any():
            return members, [~members]
    open_ = np.where((c < total) & (tokens != WILD_HASH), c, 0)[:, DEPTH:]
    if open_.max(initial=0) < need:
        return None, []
    position = DEPTH + int(open_.max(axis=0).argmax())
    often = (c[:, position] >= need) & (tokens[:, position] != WILD_HASH)
    values = tokens[:, position]
    return None, [*(often & (values == v) for v in np.unique(values[often])), ~often]


def node_templates(tokens: np.ndarray, weights: np.ndarray, need: int) -> list[np.ndarray]:
    """The members, as row numbers, of every template below a node."""
    out, nodes = [], [np.arange(len(tokens))]
    while nodes:
        rows = nodes.pop()
        if weights[rows].sum() < need:
            continue
        members, rest = node_step(tokens[rows], weights[rows], need)
        if members is not None:
            out.append(rows[members])
        nodes += [rows[r] for r in rest if r.any()]
    return out


def _node_batches(min_docs: int, long_min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(template, h) from rows (node, h, n, w, tokens) with each node's rows together."""

    def made(parts: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        h, w, tokens = (np.concatenate(x) for x in zip(*(part[1:] for part in parts)))
        order = np.argsort(h)  # so that a repeated task names its templates alike
        for members in node_templates(tokens[order], w[order], _need_of(tokens.shape[1], min_docs, long_min_docs)):
            own = h[order][members]
            yield xxhash.xxh3_64_intdigest(np.append(own, parts[0][0]).tobytes()) >> 1, own

    def batch_of(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        names = np.repeat(np.array([name for name, _ in found], np.int64), [len(own) for _, own in found])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([own for _, own in found]))], names=["template", "h"])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # what has been read of the last node: (node, h, w, tokens) by batch
        for batch in given:
            if not batch.num_rows:
                continue
            nodes, n, h, w = (batch.column(c).to_numpy() for c in ("node", "n", "h", "w"))
            tokens, ends = batch.column("tokens").flatten().to_numpy(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            found = []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if held and held[0][0] != nodes[begin]:
                    found += made(held)
                    held = []
                held.append((nodes[begin], h[begin:end], w[begin:end], tokens[ends[begin] : ends[end]].reshape(end - begin, n[begin])))
            if found:
                yield batch_of(found)
        last = list(made(held)) if held else []
        if last:
            yield batch_of(last)

    return batches


def _need_of(n: int, min_docs: int, long_min_docs: int) -> int:
    return long_min_docs if n >= LONG_WORDS else min_docs


def _large_step(nodes: DataFrame, min_docs: int, long_min_docs: int) -> tuple[DataFrame, DataFrame]:
    """``node_step`` for all nodes at once: ((template, h), the rows (node, h, n, w, tokens) that go on)."""
    total = nodes.groupBy("node").agg(F.sum("w").alias("total"), F.first("n").alias("n"))
    at = nodes.select("node", "w", F.posexplode("tokens").alias("at", "token")).groupBy("node", "at", "token").agg(F.sum("w").alias("c"))
    counts = stored(at.join(total, "node"), "node-counts")
    wild = F.col("token") == WILD_HASH
    best = counts.groupBy("node", "at", "total").agg(F.max(F.struct("c", "token")).alias("best"))
    fixed = F.when((F.col("best.c") * 2 > F.col("total")) & (F.col("best.token") != WILD_HASH), F.col("best.token")).alias("token")
    general = (
        best.select("node", "at", fixed).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("x"))
        .select("node", F.transform("x", lambda x: x["token"]).alias("general"))
        .where(F.size(F.filter("general", lambda x: x.isNotNull())) * 2 >= F.size("general"))
    )
    # The node's most frequent token that not all lines have, at its first position.
    pivot = (
        counts.where((F.col("c") < F.col("total")) & ~wild & (F.col("at") >= DEPTH))
        .groupBy("node").agg(F.max(F.struct("c", (-F.col("at")).alias("at"))).alias("most"), F.first("n").alias("n"))
        .where(F.col("most.c") >= _need(min_docs, long_min_docs)).select("node", (-F.col("most.at")).alias("position"))
    )
    rest = lambda x: F.slice(x, DEPTH + 1, F.size(x))
    equal = F.size(F.filter(F.zip_with(rest(F.col("tokens")), rest(F.col("general")), lambda a, b: a.eqNullSafe(b) & b.isNotNull()), lambda x: x))
    belongs = F.coalesce(equal >= (F.col("n") - DEPTH) * SIMILAR, F.lit(False)) & F.col("general").isNotNull()
    marked = stored(nodes.join(stored(general, "node-templates"), "node", "left").withColumn("belongs", belongs).drop("general"), "node-members")
    members = marked.where("belongs").select(F.xxhash64(F.lit("t"), "node", "n").alias("template"), "h")
    peeled = stored(marked.where("belongs").select("node").distinct(), "peeled")
    others = marked.where("not belongs").drop("belongs")
    same = others.join(peeled, "node", "left_semi")
    split = others.join(peeled, "node", "left_anti").join(stored(pivot, "pivots"), "node").withColumn("token", F.element_at("tokens", F.col("position") + 1))
    often = counts.where((F.col("c") >= _need(min_docs, long_min_docs)) & ~wild).select("node", F.col("at").alias("position"), "token", F.lit(True).alias("often"))
    named = split.join(often, ["node", "position", "token"], "left")
    own = F.when(F.col("often"), F.xxhash64("node", "position", "token")).otherwise(F.xxhash64("node", "position"))
    again = same.withColumn("node", F.xxhash64(F.lit("r"), "node")).unionByName(named.withColumn("node", own).select(*same.columns))
    return members, again


def _templates(members: DataFrame, min_docs: int, long_min_docs: int, most: int) -> DataFrame:
    """(template, h): the lines of every template, from rows (node, h, n, w, tokens)."""
    found = []
    while True:
        large = stored(members.groupBy("node").agg(F.sum("n").alias("size")).where(F.col("size") > most).select("node"), "large-nodes")
        small = members.join(large, "node", "left_anti")
        dealt = small.repartition("node").sortWithinPartitions("node")
        found.append(stored(dealt.mapInArrow(_node_batches(min_docs, long_min_docs), "template long, h long"), "templates"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        templates, rest = _large_step(stored(members.join(large, "node", "left_semi"), "large"), min_docs, long_min_docs)
        found.append(stored(templates, "large-templates"))
        members = stored(rest, "nodes")


def _need(min_docs: int, long_min_docs: int) -> Column:
    return F.when(F.col("n") >= LONG_WORDS, long_min_docs).otherwise(min_docs)


def _often(lines: DataFrame, key: str, min_docs: int, long_min_docs: int) -> DataFrame:
    """Rows (key, n, d) of the templates that enough different texts hold, from rows (key, n, d) that may repeat."""
    # Every row of a text counts here, which only lets more templates through to the groups; a single text is one group.
    counts = lines.groupBy(key).agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    need = _need(min_docs, long_min_docs)
    often = stored(counts.where((F.col("docs") >= need) & ((F.col("lo") != F.col("hi")) | (need <= 1))).select(key, "n"), f"often-{key}")
    return stored(lines.select(key, "d").join(often.hint("merge"), key).select(key, "n", "d"), f"holders-{key}")


def _copy_groups(second: DataFrame, given: DataFrame, holders: DataFrame) -> DataFrame:
    """(d, g): the group of near-duplicates of each text in ``holders``."""
    sketch = second.where("key is not null").select(F.col("d").alias("id"), F.col("d").alias("t"), "n", "key", "bands", "odd").dropDuplicates(["id"])
    sketched = stored(sketch.join(holders.select(F.col("d").alias("id")).distinct(), "id", "left_semi"), "holder-sketches")
    groups = class_components(sketched, given.select(F.col("d").alias("id"), F.col("d").alias("t"), "text"), COPY_PERCENT)
    return stored(sketched.select("id", "key").join(groups, "key").select(F.col("id").alias("d"), F.col("first.id").alias("g")), "copy-groups")


def _recurring(held: DataFrame, groups: DataFrame, key: str, min_docs: int, long_min_docs: int) -> DataFrame:
    """Keys that documents of enough copy groups hold."""
    # Stored, so that the join can split the rows of a text with many copies.
    once = held.join(groups.hint("merge"), "d").groupBy(key, "g").agg(F.max("n").alias("n"))
    counts = once.groupBy(key).agg(F.count("*").alias("groups"), F.max("n").alias("n"))
    return counts.where(F.col("groups") >= _need(min_docs, long_min_docs)).select(key)


def recurring_lines(docs: DataFrame, text: str, min_docs: int = MIN_DOCS, long_min_docs: int = LONG_MIN_DOCS, node_tokens: int = NODE_TOKENS) -> DataFrame:
    """(d, h): for each text, by its hash d, the hashes of its lines and runs to drop; rows may repeat."""
    given = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("d"), F.col(text).alias("text"))
    lines = stored(given.mapInArrow(_first_pass, _ROWS), "lines")
    held = _often(lines, "h", min_docs, long_min_docs)

    # Leaves that hold different lines in enough documents: their lines are generalised.
    leaves = (
        lines.where(F.col("leaf").isNotNull())
        .groupBy("leaf")
        .agg(F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("n").alias("n"))
        .where((F.col("lo") != F.col("hi")) & (F.col("docs") >= _need(min_docs, long_min_docs).cast("long")))
        .select("leaf")
    )
    leaves = stored(leaves, "leaves")
    open_lines = stored(lines.join(leaves.hint("merge"), "leaf", "left_semi"), "leaf-lines")
    # Tokens of these lines and sketches of the texts that may hold a template only: most lines are alone in their leaf.
    texts = stored(held.select("d").union(open_lines.select("d")).distinct(), "texts")
    sent = docs.sparkSession.sparkContext.broadcast((_filter(texts), _filter(leaves)))
    second = stored(given.mapInArrow(_second_pass(sent), _SECOND), "second")
    tokens = second.where("leaf is not null").groupBy("leaf", "h").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    weights = open_lines.groupBy("leaf", "h").agg(F.count("*").alias("w"))
    members = tokens.join(weights, ["leaf", "h"]).select(F.col("leaf").alias("node"), "h", "n", "w", "tokens")
    matched = stored(_templates(stored(members, "leaf-members"), min_docs, long_min_docs, node_tokens), "matched")
    # Stored, so that a template with many lines can be split in the joins.
    own = stored(open_lines.select("d", "h", "n").join(matched, "h").select("template", "d", "h", "n"), "template-lines")
    held_templates = _often(own.groupBy("template", "d").agg(F.max("n").alias("n")), "template", min_docs, long_min_docs)

    groups = _copy_groups(second, given, held.select("d").union(held_templates.select("d")))
    exact = held.join(_recurring(held, groups, "h", min_docs, long_min_docs), "h", "left_semi")
    generalised = own.join(_recurring(held_templates, groups, "template", min_docs, long_min_docs), "template", "left_semi")
    return exact.select("d", "h").union(generalised.select("d", "h"))


def _without(text: str, drop: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines that neither recur nor stand in a run that does; blank lines stay."""

    def rewritten(value: str, gone: set[int], lines: Lines, i: int) -> list[str]:
        sizes, hashes, at = lines.of(i)
        drop = {k for k, h in zip(at, hashes) if h in gone}
        for (first, last), key in runs(sizes, hashes).items():
            if key in gone:
                drop.update(at[first : last + 1])
        return [x for k, x in enumerate(value.split("\n")) if k not in drop]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PART) for whole in given for i in range(0, whole.num_rows, PART)):
            column, gone = batch.column(text), batch.column(drop).to_pylist()
            n_lines = pc.fill_null(pc.add(pc.count_substring(column, "\n"), 1), 0).to_numpy().astype(np.int64)
            n_dropped, touched = np.zeros(len(column), np.int64), [i for i, g in enumerate(gone) if g]
            values, rewritten_texts = column.take(pa.array(touched, pa.int64())), []
            for begin, texts in chunks(values):
                lines = Lines(Words(texts))
                for k, value in enumerate(values.slice(begin, len(texts)).to_pylist()):
                    i = touched[begin + k]
                    kept = rewritten(value, set(gone[i]), lines, k)
                    rewritten_texts.append("\n".join(kept))
                    n_dropped[i] = n_lines[i] - len(kept)
            mask = np.zeros(len(column), bool)
            mask[touched] = True
            column = pc.replace_with_mask(column, pa.array(mask), pa.array(rewritten_texts, column.type))
            names = [c for c in batch.schema.names if c != drop]
            columns = [column if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], names=[*names, "lines", "dropped"])

    return batches


def drop_recurring_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, long_min_docs: int = LONG_MIN_DOCS, node_tokens: int = NODE_TOKENS
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines, n_dropped (long).

    The line feeds of dropped lines go with them. Added columns take an
    underscore in front if ``docs`` has their name.
    """
    recurring = recurring_lines(docs, text, min_docs, long_min_docs, node_tokens)
    n_lines = unused(docs.columns, "n_lines")
    n_dropped = unused([*docs.columns, n_lines], "n_dropped")
    d, drop = unused([*docs.columns, n_lines, n_dropped], "_d"), unused([*docs.columns, n_lines, n_dropped], "_drop")
    drops = recurring.groupBy(F.col("d").alias(d)).agg(F.collect_set("h").alias(drop))
    whole = docs.withColumn(d, F.xxhash64(text)).join(stored(drops, "drops").hint("merge"), d, "left").drop(d)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return whole.mapInArrow(_without(text, drop), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs)
