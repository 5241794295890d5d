"""Near-duplicate documents and vectors, recurring lines."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.corpus import DOCS, awkward, prose, with_clashes
from tidemark.llm import common, embedding_dedup, graph, line_dedup, near_dedup
from tidemark.llm.words import Words


def reach(nodes, links):
    """Smallest node reachable by links."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(1, 40)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links + [(None, 1)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == reach(nodes, [(a, b) for a, b in links if a != b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 7)], "bucket long, id long")
    from pyspark.sql import functions as F

    dealt = graph.cells(rows, "bucket", "id", F.lit(1), 30).collect()
    cells = defaultdict(list)
    for r in dealt:
        cells[r.bucket, r.cell_i, r.cell_j].append(r)
    met = defaultdict(int)
    for (bucket, i, j), members in cells.items():
        for a in members:
            for b in members:
                if a.id < b.id and (i == j or a.side != b.side):
                    met[a.id, b.id] += 1
    assert len(met) == 100 * 99 // 2 and set(met.values()) == {1}


def test_a_filter_lets_all_wanted_rows_through(spark, monkeypatch):
    rows = spark.createDataFrame([(i, -i) for i in range(2000)] + [(None, 1)], "k long, _word long")
    wanted = spark.createDataFrame([(i,) for i in range(0, 2000, 7)] + [(None,)], "id long")
    got = common.may_hold(rows, "k", wanted)
    assert got.columns == ["k", "_word"]
    kept = {r.k for r in got.collect()}
    assert set(range(0, 2000, 7)) <= kept and None not in kept and len(kept) < 400
    assert common.may_hold(rows, "k", wanted.limit(0)).count() == 0
    monkeypatch.setattr(common, "FILTER_WORDS", 1)  # a full filter lets more through, and loses nothing
    assert set(range(0, 2000, 7)) <= {r.k for r in common.may_hold(rows, "k", wanted).collect()}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_near(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, reach(ids, links)


def families(seed, groups=12, most=40):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = prose(rng, rng.choice([3, 6, 40, 120, 400]))
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(["neu", "Alt", "gut"])
            out.append(" ".join(words) if rng.random() < 0.8 else "\n".join(w.upper() for w in words))
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = families(seed)
    sets, want = brute_near(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_the_smallest_member_lacks(spark, monkeypatch):
    """Copies of a base that is not in the table: the bucket's other members are compared in full, in several cells."""
    monkeypatch.setattr(near_dedup, "CELL_SHINGLES", 2000)
    rng = random.Random(9)
    base, rows = prose(rng, 300), []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([2, 6, 7])):
            words[rng.randrange(300)] = f"neu{i}"
        rows.append((i, " ".join(words)))
    _, want = brute_near(rows)
    assert len(set(want.values())) > 3
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_awkward(spark):
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(awkward())
    by_id = {r[0]: r for r in got}
    assert by_id[1][2:] == (1, True) and by_id[2][2:] == (1, False) and by_id[None][2:] == (1, True) or by_id[None][2] in (None, 1)
    assert by_id[3] == (3, 0, 3, True) and by_id[4] == (4, 0, 4, True) and by_id[5] == (5, 0, 5, True)
    assert by_id[9] == (9, 1, 8, False) and by_id[11][1] == 1
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in awkward()} - {2, 9}
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_ids_with_unlike_texts(spark):
    """Every row is judged by its own text: an id that has two texts does not join them."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    one = lambda words, k=0: " ".join(words[:-1] + [words[-1] + "x" * k])
    rows = [(1, one(a)), (5, one(a, 1)), (5, one(b)), (7, one(b, 1)), (8, one(c)), (8, one(c)), (9, one(c, 2)), (8, one(a, 2)), (None, one(c)), (10, None), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    want = [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True), (9, 8, False), (8, 1, False), (None, None, True), (10, 10, True), (10, 10, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()), key=str)
    assert left == sorted([(1, one(a)), (5, one(b)), (8, one(c)), (None, one(c)), (10, None), (10, None)], key=str)


def test_a_settled_group_is_not_copied_for_every_part(spark):
    """One stray member beside a group of thousands: the group's rows go to one cell each."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.lit(1).alias("bucket"), "id", (F.col("id") > 2).alias("big"))
    dealt = graph.cells_beside(rows, "bucket", "id", "big", F.lit(1), 100)
    assert dealt.where("big").count() == 4997 and dealt.where("not big").groupBy("id").count().select("count").distinct().first()[0] == 51
    met = dealt.where("not big").alias("a").join(dealt.alias("b"), graph.CELL).where("a.id < b.id and (cell_i = cell_j or a.side != b.side)")
    assert met.count() == met.select("a.id", "b.id").distinct().count() == 3 * 4997 + 3


def test_sketches_of_a_chunk_are_those_of_each_text():
    rng = random.Random(22)
    texts = [None, "", " ", "One two", "a b c d e", " ".join(prose(rng, 3000)), "É ß \u00a0 x"] + [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(50)]
    texts += ["", None, "a b c d e f", " ", ""]  # empty texts beside others
    words = Words([(t or "").encode() for t in texts])
    for i, (n, key, bands, odd) in enumerate(zip(*(a.to_pylist() for a in near_dedup.sketches(words, 85)))):
        s = near_dedup.shingles(texts[i])
        assert n == len(s) and (key is None) == (n == 0)
        if n:
            m = near_dedup.minima(s)
            assert bands == near_dedup.band_keys(m[None], *near_dedup.band_shape(85))[0].tolist() and odd == near_dedup.odd_sketch(m).tolist()


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    for share in (0.8, 0.9, 0.97):
        diffs = []
        for _ in range(40):
            a = rng.integers(0, 2**63, 500, dtype=np.uint64)
            b = a.copy()
            b[: round(500 * (1 - share) / (1 + share))] = rng.integers(0, 2**63, round(500 * (1 - share) / (1 + share)), dtype=np.uint64)
            x, y = (near_dedup.odd_sketch(near_dedup.minima(np.unique(s))).view(np.uint64) for s in (a, b))
            z = int(np.bitwise_count(x ^ y).sum())
            diffs.append(1 + near_dedup.BITS / (4 * near_dedup.K) * np.log(max(1 - 2 * z / near_dedup.BITS, 1e-9)))
        assert abs(np.mean(diffs) - share) < 0.02


def brute_vectors(rows, threshold=0.98):
    usable = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], defaultdict(int)
    for k, (a, x, l) in enumerate(usable):
        for b, y, m in usable[k + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    return n, reach([r[0] for r in rows if r[0] is not None], links)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            base = rng.standard_normal(48)
            for _ in range(rng.integers(1, 12)):
                v = base + rng.standard_normal(48) * rng.choice([0, 0.05, 0.12, 0.2])
                rows.append((i, [float(x) for x in v * rng.uniform(0.5, 2)], label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(60)] + [(i + 100, rows[0][1], None)]
    odd = [None, [], [0.0] * 48, [float("nan")] + [1.0] * 47, [float("inf")] * 48, [None] + [1.0] * 47, [1.0, 2.0], [1.0, 2.0]]
    rows += [(i + 200 + k, v, 1) for k, v in enumerate(odd)]
    n, want = brute_vectors(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(with_clashes(frame)).collect()
    assert {r.vec_id: r.component_id for r in got} == want
    assert {r.vec_id: r.n_links for r in got} == {i: n[i] for i, *_ in rows}
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_empty_and_null_ids(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    got = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], kinds)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == [(5, 1, 5), (5, 1, 5), (None, 0, None)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * rng.standard_normal((200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned, factor, _ = embedding_dedup.codes(x)
    code = np.where(turned > 0, 1.0, -1.0) / 8
    estimate = (code[:200] * turned[200:]).sum(axis=1) / factor[:200]
    true = (unit[:200] * unit[200:]).sum(axis=1)
    bound = embedding_dedup.EPSILON * np.sqrt((1 - factor[:200] ** 2) / factor[:200] ** 2 / 63)
    assert abs((estimate - true).mean()) < 0.02 and (abs(estimate - true) <= bound).all()
    whole, step, left_out = embedding_dedup.steps(turned[200:])
    rounded = (code[:200] * whole * step[:, None]).sum(axis=1) / factor[:200]
    assert (abs(rounded - estimate) <= left_out / factor[:200] + 1e-12).all() and (left_out < 0.03).all()


def test_vectors_of_any_scale(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 40))
    rows = [(10 * k + i, [float(x) for x in (base[k] + 0.02 * rng.standard_normal(40)) * 10.0**e], 1) for k in range(3) for i, e in enumerate((0, 300, -300, -5))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all((r.component_id, r.n_links) == (r.vec_id // 10 * 10, 3) for r in got) and len(got) == 12


def test_vectors_travel_for_open_pairs_only(spark, monkeypatch):
    """Cells get codes; of vectors that share buckets, those without an open pair are never named."""
    rng = np.random.default_rng(9)
    x = 0.55 * rng.standard_normal(64) + 0.84 * rng.standard_normal((300, 64))
    x[1] = x[0] + 0.01 * rng.standard_normal(64)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    kept, store = {}, embedding_dedup.stored
    monkeypatch.setattr(embedding_dedup, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1].component_id == 0 and sum(r.n_links for r in got.values()) == 2
    assert "vector" not in kept["codes"].columns and kept["hits"].select("id").distinct().count() > 200
    assert {r.id for r in kept["open"].select("id").distinct().collect()} >= {0, 1} and kept["open"].select("id").distinct().count() < 100


def line_corpus():
    rng = random.Random(8)
    body = lambda n=120: " ".join(prose(rng, n))
    passage = body(60)
    rows = {}
    for i in range(8):  # a short line in many documents, a numbered one, one with a variable name
        rows[i] = f"{body()}\nAll rights reserved by us.\n{body()}\nPage {i} of 99 pages\nThis page was last edited by {rng.choice('ABCDEFGH')}{'xyz'[i % 3]} on the wiki server\n"
    for i in range(10, 12):  # a long passage in two documents
        rows[i] = f"{body()}\n{passage}\n{body()}"
    copy = "\n".join(body(25) for _ in range(6))
    for i in range(20, 30):  # copies of one document
        rows[i] = copy
    near = [body(12) for _ in range(12)]
    for i in range(30, 38):  # near copies
        rows[i] = "\n".join(near[:i % 12] + ["changed " + near[i % 12]] + near[i % 12 + 1 :])
    for i in range(40, 60):  # clean documents
        rows[i] = "\n".join(body(30) for _ in range(3)) + "\n\n"
    return rows, passage


def test_recurring_lines(spark):
    rows, passage = line_corpus()
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    for i in range(8):
        kept = rows[i].split("\n")
        assert got[i].text == "\n".join([kept[0], kept[2], kept[5]]) and got[i].n_dropped == 3 and got[i].n_lines == 6
    for i in (10, 11):
        assert passage not in got[i].text and got[i].n_dropped == 1
    for i in [*range(20, 38), *range(40, 60)]:
        assert got[i].text == rows[i] and got[i].n_dropped == 0


def test_lines_awkward(spark):
    rows = awkward()
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    out = line_dedup.drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    assert sorted((str((r.doc_id, r.text)) for r in out.collect())) == sorted(str((r[0], r[1])) for r in rows)
    assert line_dedup.drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_a_line_that_most_documents_have(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, 40)) + "\nshared by a third and more\n" + " ".join(prose(rng, 40))) for i in range(300)]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "shared" not in r.text for r in got)


def kept_lines(spark, rows):
    """{doc_id: lines left} of rows (doc_id, text)."""
    return {r.doc_id: r.text.split("\n") for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_group_of_copies_does_not_hide_other_holders(spark):
    rng = random.Random(12)
    page, passage, footer = " ".join(prose(rng, 200)), " ".join(prose(rng, 60)), "all of this is ours"
    rows = [(i, f"{page}{' ' + str(i) if i % 2 else ''}\n{passage}\n{footer}") for i in range(60)]
    rows += [(100 + i, f"{' '.join(prose(rng, 150))}\n{passage}\n{footer}") for i in range(8)]
    got = kept_lines(spark, rows)
    assert all(got[i] == [text.split("\n")[0]] for i, text in rows)


def test_passages_in_short_documents(spark):
    rng = random.Random(13)
    rows, left = [], {}
    for own in (20, 30, 40, 60, 80, 100):
        for _ in range(10):
            passage = " ".join(prose(rng, 60))
            for _ in range(2):
                words = prose(rng, own)
                left[len(rows)] = [" ".join(words[: own // 2]), " ".join(words[own // 2 :])]
                rows.append((len(rows), "\n".join([left[len(rows)][0], passage, left[len(rows)][1]])))
    assert kept_lines(spark, rows) == left


def test_unlike_lines_of_one_leaf_and_rows_of_numbers_stay(spark):
    rng = random.Random(15)
    rows = []
    for i in range(12):
        row = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
        own = [f"there is a {'abcdefghijkl'[i] * 5}", f"there is a {'abcdefghijkl'[i] * 4} {prose(rng, 1)[0]}x", row(3), row(8), row(40), f"total {row(5)}"]
        rows.append((i, "\n".join([" ".join(prose(rng, 40)), *own, "1 2 3", f"Page {i} of 12 pages", " ".join(prose(rng, 40))])))
    got = kept_lines(spark, rows)
    for i, text in rows:
        lines = text.split("\n")
        assert got[i] == [*lines[:7], lines[9]]


def test_passages_on_several_lines(spark):
    rng = random.Random(16)
    rows, left = [], {}
    for size, docs in ((8, 2), (10, 3), (25, 4), (29, 2)):
        words = prose(rng, 60)
        passage = [" ".join(words[i : i + size]) for i in range(0, 60, size)]
        for k in range(docs):
            own = [" ".join(prose(rng, n)) for n in (12, 50, 7, 7)]
            # The passage's first line once more by itself: that is no recurring passage.
            own += [passage[0], " ".join(prose(rng, 40))] if k == 0 else []
            left[len(rows)] = own
            rows.append((len(rows), "\n".join([*own[:2], *passage, *own[2:]])))
    assert kept_lines(spark, rows) == left


def test_runs_leave_no_line_of_a_passage_out():
    rng = random.Random(17)
    for _ in range(500):
        sizes = [rng.choice([1, 3, 9, 20, 29, 30, 45]) for _ in range(rng.randrange(1, 14))]
        found = line_dedup.runs(sizes, list(range(len(sizes))))
        want = set()
        for i in range(len(sizes)):
            want |= {(i, next(j for j in range(i, len(sizes)) if sum(sizes[i : j + 1]) >= 30))} if sum(sizes[i:]) >= 30 else set()
            want |= {(next(j for j in range(i, -1, -1) if sum(sizes[j : i + 1]) >= 30), i)} if sum(sizes[: i + 1]) >= 30 else set()
        assert set(found) == {(i, j) for i, j in want if i < j} and len(set(found.values())) == len(found)
        for a in range(len(sizes)):
            for b in range(a, len(sizes)):
                if sum(sizes[a : b + 1]) >= 30:
                    covered = {k for i, j in want if a <= i and j <= b for k in range(i, j + 1)}
                    assert covered == set(range(a, b + 1))


def masked(line):
    """The tokens of a line, fields masked, and True; as they are, and False, if more than half are fields."""
    tokens = line.split()
    fields = [bool(re.search(rb"[0-9@]|://", t)) for t in tokens]
    return (tokens, False) if 2 * sum(fields) > len(tokens) else ([line_dedup.WILD if f else t for t, f in zip(tokens, fields)], True)


def test_words_and_lines_by_arrays():
    rng = random.Random(25)
    texts = ["", " ", "\n", "a", "A b\n\n c\td ", "x://y 1a :/ b@ <*>\r\nÉ \u00a0\x0b\x0c e\n", "same same\nsame same", "w" * 100_000]
    texts += ["".join(rng.choice("aB1 \n:/@\t") for _ in range(rng.randrange(60))) for _ in range(300)]
    words = Words([t.encode() for t in texts])
    raw, low, lines = words.hashes(), words.hashes(lower=True), line_dedup.Lines(words)
    of_word, of_line, of_leaf = {}, {}, {}
    for i, text in enumerate(texts):
        own = slice(words.text[i], words.text[i + 1])
        for w, h, g in zip(text.encode().split(), raw[own], low[own], strict=True):
            assert of_word.setdefault(w, h) == h and of_word.setdefault(w.lower(), g) == g
        n, h, at = lines.of(i)
        want = [(k, *masked(x.encode())) for k, x in enumerate(text.split("\n")) if x.encode().split()]
        assert at == [k for k, _, _ in want] and n == [len(x) for _, x, _ in want]
        leaves = lines.leaf[lines.text[i] : lines.text[i + 1]]
        for (_, x, general), own_h, leaf in zip(want, h, leaves):
            assert of_line.setdefault(tuple(x), own_h) == own_h
            assert (leaf != 0) == (general and len(x) > 3)
            if leaf:
                assert of_leaf.setdefault((len(x), *x[:3]), leaf) == leaf
    for known in (of_word, of_line, of_leaf):
        assert len(set(known.values())) == len(known) > 50


def brute_templates(lines, need):
    """Sets of lines, one per template, of a leaf: {tuple of masked tokens: number of texts}; plain Python, on the tokens themselves."""
    if sum(lines.values()) < need:
        return []
    total, n = sum(lines.values()), len(next(iter(lines)))
    c = [defaultdict(int) for _ in range(n)]
    for tokens, w in lines.items():
        for at, token in enumerate(tokens):
            c[at][token] += w
    general = [next((t for t, k in c[at].items() if 2 * k > total and t != line_dedup.WILD), None) for at in range(n)]
    if 2 * sum(t is not None for t in general) >= n:
        own = {x for x in lines if sum(a == b for a, b in zip(x[3:], general[3:])) >= 0.6 * (n - 3)}
        if own:
            left = {x: w for x, w in lines.items() if x not in own}
            return [own, *(brute_templates(left, need) if left else [])]
    most, position = max(((k, -at) for at in range(3, n) for t, k in c[at].items() if k < total and t != line_dedup.WILD), default=(0, 0))
    if most < need:
        return []
    parts = defaultdict(dict)
    for x, w in lines.items():
        token = x[-position]
        parts[token if c[-position][token] >= need and token != line_dedup.WILD else None][x] = w
    return [t for part in parts.values() for t in brute_templates(part, need)]


def brute_lines(rows):
    """{id: lines left} by the whole tree in plain Python, on texts and tokens instead of hashes."""
    texts = {t for _, t in rows if t is not None}
    sets = {t: shingle_set(t) for t in texts}
    order = sorted(texts)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = reach(order, links)
    # Copies are grouped among the holders of frequent templates only; here all texts are, which joins no more in these corpora.
    parsed, holds, leaves = {}, defaultdict(set), defaultdict(lambda: defaultdict(set))
    for text in texts:
        at = []
        for i, line in enumerate(text.split("\n")):
            tokens, general = masked(line.encode())
            if tokens:
                at.append((i, tuple(tokens)))
                holds[(tuple(tokens),)].add(text)
                if general and len(tokens) > 3:
                    leaves[len(tokens), tuple(tokens[:3])][tuple(tokens)].add(text)
        runs = [tuple(x for _, x in at[i : j + 1]) for i, j in line_dedup.runs([len(x) for _, x in at], list(range(len(at))))]
        for run in runs:
            holds[run].add(text)
        parsed[text] = at
    recurs = lambda words, held: len({group[t] for t in held}) >= (2 if words >= 30 else 5)
    gone = {k for k, held in holds.items() if recurs(sum(map(len, k)), held)}
    for (n, _), lines in leaves.items():
        if len(lines) > 1:
            for own in brute_templates({x: len(held) for x, held in lines.items()}, 2 if n >= 30 else 5):
                if recurs(n, set().union(*(lines[x] for x in own))):
                    gone |= {(x,) for x in own}
    out = {}
    for i, text in rows:
        if text is None:
            continue
        at = parsed[text]
        drop = {k for k, x in at if (x,) in gone}
        for first, last in line_dedup.runs([len(x) for _, x in at], list(range(len(at)))):
            if tuple(x for _, x in at[first : last + 1]) in gone:
                drop |= {k for k, _ in at[first : last + 1]}
        out[i] = [x for k, x in enumerate(text.split("\n")) if k not in drop]
    return out


def template_corpus(seed):
    """Texts of lines from a few templates with variable fields that share their first tokens, passages, copies and own lines."""
    rng = random.Random(seed)
    words = prose(rng, 12)
    shapes = []
    for _ in range(6):
        start, n = rng.choice([["this", "page", "was"], words[:3]]), rng.choice([6, 6, 9, 34])
        shape = start + [rng.choice(words) for _ in range(n - 3)]
        shapes.append((shape, rng.sample(range(3, n), rng.choice([0, 1, 1, 2]))))
    passage = [" ".join(prose(rng, 11)) for _ in range(4)]
    rows = []
    for i in range(70):
        lines = [" ".join(prose(rng, rng.choice([3, 8, 35]))) for _ in range(rng.randrange(1, 5))]
        for shape, fields in rng.sample(shapes, rng.randrange(0, 4)):
            line = list(shape)
            for f in fields:
                line[f] = rng.choice([*prose(rng, 3), f"n{i}"])
            lines.insert(rng.randrange(len(lines) + 1), " ".join(line))
        if rng.random() < 0.1:
            lines[1:1] = passage
        rows.append((i, "\n".join(lines)))
        if rng.random() < 0.2:
            rows.append((200 + i, rows[-1][1] + rng.choice(["", "\nx"])))
    return [*rows, (900, None), (901, ""), (902, rows[0][1])]


@pytest.mark.parametrize("seed", range(4))
def test_lines_against_a_plain_tree(spark, seed):
    rows = template_corpus(seed)
    want = brute_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Also with nodes so small that all of them go through the aggregates and joins of large ones.
    for node_tokens in (line_dedup.NODE_TOKENS, 1) if seed < 2 else (line_dedup.NODE_TOKENS,):
        got = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_recurring_lines(docs, node_tokens=node_tokens).collect() if r.text is not None}
        assert {i: x or [""] for i, x in want.items()} == got
    assert sum(len(x) for x in want.values()) < sum(len(t.split("\n")) for _, t in rows if t is not None)


def test_several_templates_of_one_leaf(spark):
    """Two and three templates of one length that share their first three tokens: all go, alone or together."""
    rng = random.Random(23)
    shapes = ["this page was last edited by {} on the old server", "this page was first seen in {} at some new place", "this page was once called {} by all its few authors"]
    for k in (1, 2, 3):
        rows, left = [], {}
        for i in range(8 * k):
            own = [" ".join(prose(rng, 40)), " ".join(prose(rng, 40))]
            left[i] = own
            rows.append((i, "\n".join([own[0], shapes[i % k].format(f"name{'abcdefghijklmnopqrstuvwx'[i]}"), own[1]])))
        assert kept_lines(spark, rows) == left


def test_the_two_ways_through_a_node_agree(spark):
    rng = random.Random(24)
    rows, plain = [], {}
    for node in range(30):
        n = rng.choice([4, 7, 12])
        bases = [[rng.randrange(6) for _ in range(n)] for _ in range(rng.randrange(1, 4))]
        lines = {}
        for _ in range(rng.randrange(1, 25)):
            line = [0, 0, 0, *rng.choice(bases)[3:]]
            for _ in range(rng.choice([0, 1, 2])):
                line[rng.randrange(3, n)] = rng.choice([line_dedup.WILD_HASH, rng.randrange(40)])
            lines[tuple(line)] = rng.randrange(1, 4)
        plain[node] = lines
        rows += [(node, rng.randrange(2**60), n, w, list(x)) for x, w in lines.items()]
    members = spark.createDataFrame(rows, "node long, h long, n int, w long, tokens array<int>")

    def found(most):
        by = defaultdict(set)
        for r in line_dedup._templates(members, 5, 2, most).collect():
            by[r.template].add(r.h)
        weight = {h: w for _, h, _, w, _ in rows}
        return {frozenset(x) for x in by.values() if sum(weight[h] for h in x) >= 5}

    assert found(10**6) == found(0) and len(found(10**6)) > 20
