"""Chat formatting and WARC archives."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tests.llm.corpus import with_clashes
from tidemark.llm import chat_tree, warc

PARTS = ["\\", "#", "###", "####", "</turn>", "<", "/turn>", "\n", ": ", "### user: ", "\\h", "\\l", "ok", "🙂", ""]


def test_turns_round_trip():
    rng = random.Random(1)
    some = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 8)))
    for _ in range(3000):
        turns = [(some(), some()) for _ in range(rng.randrange(1, 4))]
        formatted = "".join(chat_tree.format_turn(*t)[0] for t in turns)
        assert chat_tree.read_turns(formatted) == turns
        for _, text in turns:
            assert "###" not in chat_tree.escape(text) and "</turn>" not in chat_tree.escape(text)


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, ["system", "user", "assistant"][t % 3], rng.choice(["yes", "no ###", "\\ </turn>"]) if t else "start"))
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (None, 0, "user", "x"), (None, None, "user", "y"), (201, 0, "user", "same"), (201, 0, "user", "same")]
    rows += [(300, t, "user", f"turn {t}") for t in range(300)] + [(301, 0, "assistant", "z" * 200_000)]
    return rows


def test_tree(spark):
    rows = conversations()
    kinds = "conv_id long, turn long, role string, text string"
    sequences, members = chat_tree.chat_tree(with_clashes(spark.createDataFrame(rows, kinds)))
    nodes = {bytes(r.node): r for r in sequences.collect()}
    by_conv = defaultdict(list)
    for m in members.collect():
        by_conv[m.conv if m.conv is not None else (m.solo,)].append((m.depth, bytes(m.node)))
    given = defaultdict(list)
    alone = [(None, t, role, text) for c, t, role, text in rows if c is None]
    assert sorted(len(x) for c, x in by_conv.items() if isinstance(c, tuple)) == [1] * len(alone)
    for c, t, role, text in rows:
        if c is not None:
            given[c].append((t is not None, t or 0, role or "", text or ""))
    of_text = {nodes[x[0][1]].text: c for c, x in by_conv.items() if isinstance(c, tuple)}
    for _, _, role, text in alone:  # rows without a conv_id are conversations of one turn
        given[of_text[chat_tree.format_turn(role, text)[0]]].append((False, 0, role, text))
    assert len(nodes) == len({tuple(sorted(g)[: k + 1]) for g in given.values() for k in range(len(g))})
    trees = defaultdict(dict)
    for n in nodes.values():
        for i, ch in enumerate(n.text):
            assert n.start + i not in trees[bytes(n.tree)]
            trees[bytes(n.tree)][n.start + i] = ch
    for tree in trees.values():
        assert sorted(tree) == list(range(len(tree)))
    for conv, path in by_conv.items():
        so_far = ""
        for depth, node in sorted(path):
            n = nodes[node]
            seen = "".join(trees[bytes(n.tree)][i] for a, b in n.ancestors for i in range(a, b))
            assert seen == so_far and n.position == len(so_far) and n.depth == depth
            assert all(x[1] < y[0] for x, y in zip(n.ancestors, n.ancestors[1:]))
            so_far += n.text
        assert chat_tree.read_turns(so_far) == [(r, t) for _, _, r, t in sorted(given[conv])]
    read = {r.conv_id: r for r in chat_tree.read_conversations(sequences, members).collect()}
    assert chat_tree.read_conversations(sequences, members).where("conv_id is null and n_turns = 1").count() == len(alone)
    for conv, turns in given.items():
        if isinstance(conv, tuple):
            continue
        turns = sorted(turns)
        trained = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (read[conv].n_turns, read[conv].loss_chars) == (len(turns), len(trained))
        assert read[conv].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
        assert read[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()


def test_tree_of_a_hot_conversation(spark):
    """One conversation with most of the rows, others that leave it at many depths: paths and intervals stay short, its turns are in many ranges."""
    n = 6000
    rows = [(50, t, "user", f"turn {t}") for t in range(n)]
    for c in range(60):  # some with smaller ids, some with larger ones, some that end on the way
        leave = 97 * c
        rows += [(20 + c + (c > 29), t, "user", f"turn {t}") for t in range(leave)] + [(20 + c + (c > 29), leave + k, "assistant", f"own {c % 7} {k}") for k in range(c % 3)]
    rows += [(None, 0, "user", "alone")] * 40
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    sequences, members = chat_tree.chat_tree(frame)
    nodes = {bytes(r.node): r for r in sequences.collect()}
    told = defaultdict(list)
    for c, t, role, text in sorted(r for r in rows if r[0] is not None):
        told[c].append(chat_tree.format_turn(role, text)[0])
    assert len(nodes) == len({hashlib.sha256("".join(x[: k + 1]).encode()).digest() for x in told.values() for k in range(len(x))}) + 1
    sequence = defaultdict(str)
    for node in sorted(nodes.values(), key=lambda r: (bytes(r.tree), r.start)):
        assert len(sequence[bytes(node.tree)]) == node.start
        sequence[bytes(node.tree)] += node.text
    by_conv = defaultdict(list)
    for m in members.where("conv is not null").collect():
        by_conv[m.conv].append((m.depth, bytes(m.node)))
    assert {c: len(x) for c, x in by_conv.items()} == {c: len(x) for c, x in told.items()}
    for c, path in by_conv.items():
        last = nodes[max(path)[1]]
        seen = "".join(sequence[bytes(last.tree)][a:b] for a, b in last.ancestors)
        assert seen + last.text == "".join(told[c]) and last.position == len(seen)
    assert max(len(r.ancestors) for r in nodes.values()) < 40
    read = chat_tree.read_conversations(sequences, members)
    assert {r.conv_id: r.formatted_chars for r in read.where("conv_id is not null").collect()} == {c: sum(map(len, x)) for c, x in told.items()}
    assert read.where("conv_id is null").count() == 40


def test_tree_empty(spark):
    sequences, members = chat_tree.chat_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert sequences.count() == 0 and chat_tree.read_conversations(sequences, members).count() == 0


def test_chunked():
    rng = random.Random(3)
    for size in (0, 1, 5, 1000, 40_000):
        payload = rng.randbytes(size)
        assert warc.unchunked(warc.chunked(payload, 1000)) == payload
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def pages():
    rng = random.Random(4)
    big = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(90_000))
    same = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(i, f"http://e.org/{i}", f"<html>{i}{'x' * (i * 97)}") for i in range(40)]
    rows += [(100, "http://a\r\nb: c", same), (105, None, same), (103, "u", same), (110, "u", big), (111, "u", big)]
    rows += [(120, "u", None), (121, "u", ""), (122, "u", "short"), (123, "u", "short"), (130, "u", "r" * 2000), (130, "v", "r" * 2000), (129, "u", "r" * 2000), (None, "u", "n" * 2000)]
    return rows


def brute_pages(rows):
    largest = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(largest.get(html, i), i)
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = i is not None and html in largest and largest[html] != i
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[html] if again else None] += 1
    return out


@pytest.mark.parametrize("segment", [1000, 64 * 1024])
def test_archives(spark, scratch, segment):
    rows = pages()
    frame = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    folder = warc.write_archives(frame, scratch("warc"), segment_bytes=segment, records_per_file=7)
    got = Counter(tuple(r) for r in warc.read_pages(spark, folder).collect())
    assert got == brute_pages(rows)
    responses, _ = warc.read_archives(spark, folder)
    payloads = Counter(bytes(r.payload) for r in responses.collect())
    assert set(payloads) == {(h or "").encode() for _, _, h in rows}


def test_archives_empty(spark, scratch):
    folder = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), scratch("warc"))
    assert warc.read_pages(spark, folder).count() == 0


def test_damage_is_told(spark, scratch):
    whole = warc.page_records("7", "u", b"abc" * 1000, hashlib.sha1(b"abc" * 1000).hexdigest(), None, 500)
    assert [f["warc-type"] for f, _ in warc.records(b"".join(whole))][1:] == ["continuation"] * (len(whole) - 1)
    for name, kept in (("gap", whole[:2] + whole[3:]), ("end", whole[:-1])):
        folder = scratch(name)
        frame = spark.createDataFrame([(bytes(r[:-2]),) for r in kept], "r binary").selectExpr("cast(r as string) as value")
        frame.repartition(2).write.option("lineSep", "\r\n").text(folder)
        with pytest.raises(Exception, match="segments missing or of wrong length: 7"):
            warc.read_pages(spark, folder).collect()


def test_the_query_has_records_in_segments(spark, scratch):
    """The query's segment size makes several records of the given table's long pages, and all come back."""
    from tests.conftest import SF_CHECK

    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    folder = warc.write_archives(pages, scratch("query-segments"))
    read = warc._archive_files(spark, folder).mapInArrow(warc._read_batches, warc._READ_KINDS)
    long = pages.where(f"octet_length(html) > {warc.SEGMENT_BYTES}").count()
    assert read.where("type = 'continuation'").count() >= long > 10
    assert warc.read_pages(spark, folder).count() == pages.count()
