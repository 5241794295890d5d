import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.compare import DUPLICATE_KEYS, ROWS, assert_frames_equal, compare_frames


def _diffs(df):
    return {r["column_name"]: r["n_diff"] for r in df.collect()}


def test_equal_frames(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None)], "k long, x double, s string")
    assert _diffs(compare_frames(df, df, "k")) == {ROWS: 0, "x": 0, "s": 0}
    assert_frames_equal(df, df, "k")
    assert_frames_equal(df, df)


def test_nulls_in_different_rows_are_differences(spark):
    e = spark.createDataFrame([(1, None), (2, 1.0)], "k long, x double")
    g = spark.createDataFrame([(1, 1.0), (2, None)], "k long, x double")
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "x": 2}
    with pytest.raises(AssertionError, match="`x`: 2"):
        assert_frames_equal(e, g, "k")


def test_tolerance(spark):
    e = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, float("nan"))], "k long, x double")
    g = spark.createDataFrame([(1, 100.00001), (2, 100.1), (3, float("nan"))], "k long, x double")
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "x": 1}


def test_missing_rows_and_duplicates(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "k long, s string")
    g = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k long, s string")
    d = _diffs(compare_frames(e, g, "k", report_duplicates=True))
    assert d == {ROWS: 1, "s": 1, DUPLICATE_KEYS: 1}


def test_no_row_limit(spark):
    e = spark.range(25_000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("x"))
    g = e.withColumn("x", F.when(F.col("k") == 7, F.lit(-1.0)).otherwise(F.col("x")))
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "x": 1}


def test_timestamps_compare(spark):
    e = spark.createDataFrame([(1, dt.datetime(2020, 1, 1))], "k long, t timestamp_ntz")
    g = spark.createDataFrame([(1, dt.datetime(2020, 1, 2))], "k long, t timestamp_ntz")
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "t": 1}


def test_infinity_equals_itself_only(spark):
    inf = float("inf")
    e = spark.createDataFrame([(1, 1.0), (2, inf), (3, inf), (4, inf)], "k long, x double")
    g = spark.createDataFrame([(1, inf), (2, 1.0), (3, -inf), (4, inf)], "k long, x double")
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "x": 3}


def test_numeric_types_are_widened_not_narrowed(spark):
    whole = spark.createDataFrame([(1, 1), (2, 5)], "k int, x long")
    parts = spark.createDataFrame([(1, 1.9), (2, 5.0)], "k long, x double")
    assert _diffs(compare_frames(whole, parts, "k")) == _diffs(compare_frames(parts, whole, "k")) == {ROWS: 0, "x": 1}
    with pytest.raises(ValueError, match="decimal"):
        compare_frames(whole.selectExpr("k", "cast(x as decimal(10,2)) as x"), parts, "k")


def test_decimals_are_exact(spark):
    e = spark.sql("SELECT 1 AS k, cast(1000000.00 AS decimal(18,2)) AS x UNION ALL SELECT 2, cast(7 AS decimal(18,2))")
    g = spark.sql("SELECT 1 AS k, cast(1000005.00 AS decimal(20,3)) AS x UNION ALL SELECT 2, cast(7 AS decimal(20,3))")
    assert _diffs(compare_frames(e, g, "k")) == {ROWS: 0, "x": 1}
    assert _diffs(compare_frames(e, spark.sql("SELECT 1 AS k, 1000000L AS x UNION ALL SELECT 2, 8L"), "k")) == {ROWS: 0, "x": 1}


def test_tolerance_without_keys(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", None)], "s string, x double")
    g = spark.createDataFrame([("b", None), ("b", 3.0 + 1e-9), ("a", 2.0 - 1e-9), ("a", 1.0)], "s string, x double")
    assert _diffs(compare_frames(e, g)) == {ROWS: 0, "x": 0}
    assert_frames_equal(e, g)
    assert _diffs(compare_frames(e, g.withColumn("x", F.col("x") * 2))) == {ROWS: 0, "x": 3}
    assert _diffs(compare_frames(e, g, rtol=0, atol=0)) == {ROWS: 4}
    with pytest.raises(ValueError, match="keys"):
        compare_frames(e.select("x"), g.select("x"))


def test_multiset_without_keys(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, s string")
    g = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, s string")
    assert _diffs(compare_frames(e, g)) == {ROWS: 2}


def test_columns_must_match(spark):
    e = spark.createDataFrame([(1, "a")], "k long, s string")
    with pytest.raises(ValueError):
        compare_frames(e, e.select("s", "k"), "k")
    with pytest.raises(ValueError):
        compare_frames(e, e.withColumn("s", F.lit(1)), "k")


def test_noise_in_one_column_does_not_decide_the_pairs(spark):
    e = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.0 + 1e-9, 3.0)], "s string, a double, b double")
    g = spark.createDataFrame([("k", 1.0 + 1e-9, 5.0), ("k", 1.0, 3.0)], "s string, a double, b double")
    assert _diffs(compare_frames(e, g)) == {ROWS: 0, "a": 0, "b": 0}
    assert_frames_equal(e, g)
    assert _diffs(compare_frames(e, g.withColumn("b", F.col("b") + 1))) == {ROWS: 0, "a": 0, "b": 2}


def _close(x, y, rtol, atol):
    if x is None or y is None or x != x or y != y or abs(x) == float("inf") or abs(y) == float("inf"):
        return x is y or x == y or (x != x and y != y)
    return abs(x - y) <= atol + rtol * abs(y)


@pytest.mark.parametrize(("rtol", "atol", "scale"), [(1e-5, 1e-8, 1e-6), (0, 1e-3, 1e-5), (1e-6, 0, 1e-8), (0.1, 0, 1e-3), (1e-12, 1e-12, 1e-14)])
def test_every_row_with_noise_finds_its_partner(spark, rtol, atol, scale):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), *[rng.choice([-1, 1]) * 10 ** rng.uniform(-2, 6) for _ in range(4)]) for _ in range(400)]
    rows += [("a", 1.0, None, float("nan"), float("inf")), ("a", 0.0, -float("inf"), None, -1.0), ("b", None, None, None, None)] * 2 + rows[:50]
    noisy = lambda x: x if x is None or x - x != 0 else x * (1 + scale * rng.uniform(-1, 1)) if rtol else x + scale * rng.uniform(-1, 1)
    other = [(r[0], *map(noisy, r[1:])) for r in rows]
    rng.shuffle(other)
    schema = "s string, w double, x double, y double, z double"
    got = _diffs(compare_frames(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), rtol=rtol, atol=atol))
    assert got == {ROWS: 0, "w": 0, "x": 0, "y": 0, "z": 0}


def test_rows_without_a_partner(spark):
    """Random sparse rows: the number without a partner is that of a largest matching, found by augmenting paths."""
    rng = random.Random(2)
    for case in range(3):
        e = [(rng.choice("ab"), float(rng.randrange(8)), float(rng.randrange(8))) for _ in range(60)]
        g = [(s, x + rng.choice([0, 1e-9, 0.5]), y - rng.choice([0, 1e-9])) for s, x, y in e[case * 5 :]]
        taken: dict = {}

        def place(i, seen):
            for j, row in enumerate(g):
                if j not in seen and e[i][0] == row[0] and all(_close(a, b, 1e-5, 1e-8) for a, b in zip(e[i][1:], row[1:])):
                    seen.add(j)
                    if j not in taken or place(taken[j], seen):
                        taken[j] = i
                        return True
            return False

        most = sum(place(i, set()) for i in range(len(e)))
        schema = "s string, x double, y double"
        got = _diffs(compare_frames(spark.createDataFrame(e, schema), spark.createDataFrame(g, schema)))
        lone = {s: [sum(1 for r in f if r[0] == s) for f in (e, g)] for s in "ab"}
        assert got[ROWS] == sum(abs(a - b) for a, b in lone.values())
        # Pairs made of rows without a partner differ in a column each, surplus rows are counted alone.
        assert max(got["x"], got["y"]) <= len(g) - most <= got["x"] + got["y"]


def test_a_hot_group_is_dealt_over_tasks(spark):
    """All rows in one group: its cells are keys of their own, and equal rows are one row before they travel."""
    from tidemark.operators.matching import unmatched

    rows = spark.range(30_000).select(
        F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), (F.col("id") % 2).cast("int").alias("side"), F.lit(1).cast("long").alias("n"),
        F.array((F.floor(F.col("id") / 2) * 1.5 + 1).cast("double") * (1 + (F.col("id") % 2) * 1e-9), F.lit(7.0)).alias("values"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert unmatched(rows.where("id < 60000"), 2, 1e-7, 0).count() == 0
        lone = unmatched(rows.where("side = 0"), 2, 1e-7, 0)
        assert lone.agg(F.sum("n")).first()[0] == 15_000
        assert len(lone.inputFiles()) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = spark.range(50_000).select(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), (F.col("id") % 2).cast("int").alias("side"), F.lit(1).cast("long").alias("n"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"))
    assert unmatched(same, 2, 1e-7, 0).count() == 0


def test_sparse_rows_are_matched_by_batch(monkeypatch):
    """Rows alone in their cell, and pairs, never come one by one; clusters that run over batches leave what they leave row by row."""
    import pyarrow as pa

    from tidemark.operators import matching

    types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.list_(pa.float64())]
    one_by_one, take = [], matching._Free.take
    monkeypatch.setattr(matching._Free, "take", lambda self, *row: one_by_one.append(row) or take(self, *row))

    def left(rows, size):
        given = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types)], names=["h1", "h2", "cell", "side", "n", "values"]) for i in range(0, len(rows), size))
        return sorted(row for b in matching._match([0, 1], 1e-9, 1e-8)(given) for row in zip(*(c.to_pylist() for c in b.columns)))

    rows = []
    for i in range(1, 3001):
        rows.append((i % 2, 7, i, 0, 2 if i % 5 == 0 else 1, [i * 1.5, 3.0]))
        if i % 3:
            rows.append((i % 2, 7, i, 1, 1, [i * 1.5 * (1 + 1e-10), 3.0 if i % 4 else 4.0]))
    rows.sort(key=lambda r: (*r[:3], r[5], r[3]))
    want = []
    for i in range(1, 3001):
        met = i % 3 and i % 4
        n = (2 if i % 5 == 0 else 1) - (1 if met else 0)
        want += [(i % 2, 7, 0, n, [i * 1.5, 3.0])] if n else []
        want += [(i % 2, 7, 1, 1, [i * 1.5 * (1 + 1e-10), 4.0])] if i % 3 and not met else []
    assert left(rows, 1000) == left(rows, 7) == sorted(want)
    assert not one_by_one

    rng = random.Random(3)
    for spread in (3, 40, 400):
        places = {(1 + 1e-9 * rng.uniform(0, spread), 2 + 1e-9 * rng.randrange(spread)) for _ in range(300)}
        crowd = [(1, 2, 3, rng.randrange(2), rng.choice([1, 3]), list(p)) for p in sorted(places)]
        free = matching._Free([0, 1], 1e-9, 1e-8)
        for row in crowd:
            free.take(*row[3:])
        assert left(crowd, 300) == left(crowd, 11) == left(crowd, 1) == sorted((1, 2, *row) for row in free.left())
