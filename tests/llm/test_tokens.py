"""Encoder, wavelet shards, packing, token counts against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from tests.llm.corpus import DOCS, awkward, prose, with_clashes
from tidemark.llm import packing, token_counts, tokens, wavelet

PIECES = [" ", "  ", "\n", "\t", "a", "B", "é", "ΑΣ", "1", "²", "<|endoftext|>", "<|startoftext|>", "'s", ".", "́", "\xa0", "\x1c", "\x85", "中", "🙂", "\r\n", "\x01", "İ", "ﬁ", "\0", "Ⅷ", "क", "ß", "Ä", "ñ", "\x0b", "ª", "ƻ", "İ", "ʼ", "x\x01"]
KINDS = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(name))


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: k[0])
def test_encoder(kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 300)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 2000)
    name, spaces = kind
    texts = fuzz(3000) + [" ".join(prose(random.Random(i), 200)) for i in range(20)]
    enc, lib = tokens.Encoder(tokens.vocabulary_path(name), spaces), library(name)
    for text, ids in zip(texts, enc.each(pa.array(texts)), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_shard():
    ids = np.random.default_rng(1).integers(0, 60, 5000)
    s = wavelet.Shard(wavelet.write_shard(ids, [1, None], np.array([2000, 5000]), 3, 4))
    assert (s.part, s.shard, s.n, s.doc_ids.to_pylist()) == (3, 4, 5000, [1, None])
    assert (s.all_ids() == ids).all() and all(s.access(i) == ids[i] for i in range(0, 5000, 41))
    for v in (*range(61), 70_000):
        assert s.occurrences(v) == np.flatnonzero(ids == v).tolist() and s.count(v, 100, 3333) == (ids[100:3333] == v).sum()


@pytest.mark.parametrize("kind", ["equal", "two", "zipf", "wide", "one", "none", "distinct", "rare"])
def test_shards_of_all_shapes(kind):
    rng = np.random.default_rng(2)
    ids = {
        "equal": np.full(100_000, 7), "two": rng.integers(0, 2, 3000), "zipf": np.minimum(rng.zipf(1.3, 40_000), 50_000), "wide": rng.integers(69_000, 2**32, 4000),
        "one": np.array([70_000]), "none": np.empty(0, np.int64), "distinct": rng.permutation(3000), "rare": np.array([5] * 5000 + [1, 2, 3]),
    }[kind].astype(np.uint32)
    data = wavelet.write_shard(ids, [4], np.array([len(ids)]), 0, 0)
    s = wavelet.Shard(data)
    assert (s.all_ids() == ids).all() and s.n == len(ids)
    assert all(s.access(i) == ids[i] for i in range(0, len(ids), 97))
    for v in np.unique(ids)[:: max(1, len(np.unique(ids)) // 60)].tolist():
        assert s.occurrences(v) == np.flatnonzero(ids == v).tolist() and s.count(v, len(ids) // 3) == (ids[len(ids) // 3 :] == v).sum()
    assert s.count(4_000_000_000) == (ids == 4_000_000_000).sum() and s.occurrences(69_999) == []
    if kind == "equal":
        assert len(data) < 200
    if kind == "zipf":
        counts = np.unique(ids, return_counts=True)[1]
        entropy = -(counts * np.log2(counts / len(ids))).sum()
        assert 8 * len(data) < 1.2 * entropy + 64 * len(counts) + 32 * 600


def test_shards_of_a_large_vocabulary(spark, scratch, monkeypatch):
    """Ids above 65,535 are kept: the width follows from the vocabulary and the end id."""
    folder = wavelet.write_shards(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), scratch("wide"), end_id=70_000)
    assert wavelet.find_token(spark, folder, 70_000).count() == 2 and wavelet.count_tokens(spark, folder, [4_464]).first().n == 0


def test_shards_round_trip(spark, scratch):
    rows = awkward() + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(fuzz(50))]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    folder = wavelet.write_shards(docs, scratch("shards"), shard_tokens=5000)
    lib = library(wavelet.VOCABULARY)
    ordered = sorted(((r[0], lib.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for i, ids in ordered:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    got = [tuple(r) for r in wavelet.read_documents(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    everything = [t for _, ids in ordered for t in ids]
    counts = {r.token: r.n for r in wavelet.count_tokens(spark, folder, [2, 220, 50256, 31000]).collect()}
    assert counts == {t: everything.count(t) for t in (2, 220, 50256, 31000)}
    found = sorted((str(r.doc_id), r["at"]) for r in wavelet.find_token(spark, folder, 50256).collect())
    assert found == sorted((str(i), k) for i, ids in ordered for k, t in enumerate(ids) if t == 50256)


def test_shards_empty(spark, scratch):
    folder = wavelet.write_shards(spark.createDataFrame([], DOCS), scratch("shards"))
    assert wavelet.read_documents(spark, folder).count() == 0


def test_pack_histogram():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(rng.randrange(1, 40))}
        patterns = packing.pack_histogram(counts, 64)
        used = Counter()
        for lengths, n in patterns:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts
        ranks = defaultdict(list)
        for length, first, end, _, _ in packing.places(patterns):
            ranks[length].append((first, end))
        for length, spans in ranks.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing(spark):
    rows = awkward() + [(1000 + i, " ".join(prose(random.Random(i), i * 7)), "en", "a", 0) for i in range(60)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    lib = library(packing.VOCABULARY)
    got = packing.pack(docs).collect()
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[r[0], at, len(piece), zlib.crc32(np.array(piece, "<u4")), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    assert used > 0.97 * 2048 * (len(sequences) - 1)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts(spark, monkeypatch):
    rows = awkward() + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(fuzz(300))]
    lib = library(token_counts.VOCABULARY)
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    got = token_counts.token_counts(docs).collect()
    want = [(r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(spark.createDataFrame([], DOCS)).count() == 0
    # Small blocks, so that texts longer than a block, and blocks without a pre-token, occur.
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 300)
    small = token_counts.token_counts(docs.coalesce(1), pages=5).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in small) == Counter(want)
    blank = spark.createDataFrame([(-5, None), (None, ""), (-5, " ")], "doc_id long, text string")
    assert Counter(map(tuple, token_counts.token_counts(blank).collect())) == Counter([(-5, 0, 0, False), (None, 0, 0, False), (-5, 1, 1, False)])


def test_token_counts_hot_pre_token(spark, monkeypatch):
    """A pre-token in every document, a third of all words, travels once per block, not once per document."""
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 50_000)
    rng = random.Random(9)
    rows = [(i, " the".join(["", *prose(rng, 12)])) for i in range(3000)]
    lib = library(token_counts.VOCABULARY)
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), pages=7)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    made = list(token_counts._block_rows(0, [i for i, _ in rows], [t for _, t in rows], 7, ["<|endoftext|>"]))
    names = [token_counts._unpack(data, 2) for _, page, _, data in made if page is not None]
    distinct = {p for _, t in rows for p in regex.findall(token_counts.PRE_TOKEN, t)}
    assert sum(len(lengths) for _, lengths in names) == len(distinct)
