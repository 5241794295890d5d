import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import Period
from tidemark.operators.lineage import cut_lineage
from tidemark.plans.chains import backfill_table, external, frame, needed_periods, run, run_chain, source, table
from tidemark.sources.config import config_frame, join_config
from tidemark.sources.tables import read_period, read_table
from tidemark.sources.writes import replace_periods


def test_config_dict_to_frame(spark):
    cfg = {"eu": {"currency": "EUR", "vat": 21, "open": True}, "ch": {"currency": "CHF", "vat": 8, "open": False}}
    df = config_frame(spark, cfg, "market")
    assert df.columns == ["market", "currency", "vat", "open"]
    assert sorted(map(tuple, df.collect())) == [("ch", "CHF", 8, False), ("eu", "EUR", 21, True)]


def test_config_values_placed_by_key(spark):
    cfg = {"a": {"x": 1, "y": "p"}, "b": {"y": "q", "x": 2}}
    df = config_frame(spark, cfg, "id")
    assert sorted(map(tuple, df.collect())) == [("a", 1, "p"), ("b", 2, "q")]
    with pytest.raises(ValueError):
        config_frame(spark, {"a": {"x": 1}, "b": {"y": 2}}, "id")


def test_join_config(spark):
    cfg = config_frame(spark, {"A": {"tier": "gold"}, "Q": {"tier": "q"}}, "seg")
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "k long, seg_name string")

    def rows(how):
        return sorted(map(tuple, join_config(df, cfg, "seg_name", "seg", how).collect()), key=str)

    assert rows("inner") == [(1, "A", "gold")]
    assert rows("left") == [(1, "A", "gold"), (2, "B", None), (3, None, None)]
    assert rows("right") == [(1, "A", "gold"), (None, "Q", "q")]
    assert rows("full") == [(1, "A", "gold"), (2, "B", None), (3, None, None), (None, "Q", "q")]
    assert rows("left_semi") == [(1, "A")] and rows("left_anti") == [(2, "B"), (3, None)]


def _chain(deepest=None):
    """sales -> month totals -> growth on the month before -> report on growth now, two and five months back."""
    sales = source("sales", "unused")
    totals = table("totals", lambda p, d: d, [sales.at(0)])
    growth = table("growth", lambda p, now, before: now, [totals.at(0), totals.at(1)])
    return table("report", lambda p, *parts: parts[0], [growth.at(0), growth.at(2), growth.at(5), deepest or totals.at(12)])


def test_needed_periods_of_a_chain():
    run_month = Period(2021, 4)
    need = needed_periods(_chain(), run_month)
    lags = {name: {run_month.index - p.index for p in months} for name, months in need.items()}
    assert lags == {"report": {0}, "growth": {0, 2, 5}, "totals": {0, 1, 2, 3, 5, 6, 12}, "sales": {0, 1, 2, 3, 5, 6, 12}}


def test_needed_periods_of_trailing_and_latest():
    src = source("src", "unused")
    assert needed_periods(table("t", None, [src.trailing(3, 1)]), (2021, 2))["src"] == {
        Period(2021, 1), Period(2020, 12), Period(2020, 11), Period(2020, 10)}
    assert needed_periods(table("t", None, [src.latest(1)]), (2021, 2))["src"] == {Period(2021, 1)}


def test_each_table_and_month_is_built_once(spark):
    calls = []
    node = external("base", "unused")
    level = table("level0", lambda p: spark.range(3), [])
    for i in range(1, 7):
        def build(p, a, b, i=i):
            calls.append((i, p))
            return a
        level = table(f"level{i}", build, [level.at(0), level.at(0)])
    frame(spark, level, (2021, 2))
    assert len(calls) == 6
    assert len(needed_periods(level, (2021, 2))) == 7 and node.external


def _jobs(spark, group, action):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        action()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_backfill_jobs_do_not_grow_with_the_months(spark, scratch):
    root = scratch("long-src")
    months = [Period.from_index(Period(2015, 1).index + i) for i in range(36)]
    rows = [(c, p.year, p.month) for p in months for c in range(p.month)]
    replace_periods(spark.createDataFrame(rows, "cust long, year int, month int"), root)
    schema = T.StructType([T.StructField("cust", T.LongType())])
    count = F.count(F.lit(1)).alias("n")
    src = source("src", root, schema)
    out_schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("note", T.StringType())])
    ranged = table("ranged", lambda p, m: m.groupBy().agg(count), [src.at(1)], root=scratch("ranged"), schema=out_schema,
                   build_range=lambda m: m.groupBy("year", "month").agg(count))
    single = table("single", lambda p, m: m.groupBy().agg(count), [src.at(1)], root=scratch("single"), schema=out_schema)
    used = [_jobs(spark, f"g{i}", lambda: backfill_table(spark, t, wanted))
            for i, (t, wanted) in enumerate([(ranged, months[1:5]), (ranged, months[1:]), (single, months[1:5]), (single, months[1:])])]
    # Over 32 paths Spark lists in a job of its own. Month by month there is one shuffle per month, and no job for schemas.
    assert used[1] - used[0] <= 1 and used[3] <= len(months[1:]) + 3
    got = [{(r["year"], r["month"]): r["n"] for r in read_table(spark, t.root).collect()} for t in (ranged, single)]
    assert got[0] == got[1] == {(p.year, p.month): p.minus(1).month for p in months[1:]}


def test_no_job_looks_for_a_declared_schema(spark, stored):
    schema = T.StructType([T.StructField("cust", T.LongType())])
    assert _jobs(spark, "declared", lambda: [read_period(spark, stored, (1997, m), schema=schema) for m in (10, 11, 12)]) == 0


def test_run_chain_stores_each_month_once(spark, scratch, stored):
    built = []

    def counted(p, m):
        built.append(p)
        return m.groupBy().agg(F.count(F.lit(1)).alias("n"))

    counts = table("counts", counted, [source("src", stored).at(0)], root=scratch("counts"))
    pair = table("pair", lambda p, a, b: a.crossJoin(b.withColumnRenamed("n", "before")), [counts.at(0), counts.at(1)], root=scratch("pair"))
    top = table("top", lambda p, a, b: a.unionByName(b), [pair.at(0), pair.at(1)], root=scratch("top"))
    done = run_chain(spark, top, (1997, 12))
    assert done == {"counts": [Period(1997, 10), Period(1997, 11), Period(1997, 12)], "pair": [Period(1997, 11), Period(1997, 12)], "top": [Period(1997, 12)]}
    assert sorted(built) == done["counts"]
    assert sorted(map(tuple, read_period(spark, top.root, (1997, 12)).collect())) == [(11, 10), (12, 11)]


def test_most_recent_dependency(spark, stored):
    recent = table("recent", lambda p, m: m, [source("src", stored).most_recent()])
    assert frame(spark, recent, (1990, 1)).count() == 1  # 1998-01, after the run month


def test_tables_of_one_name_are_an_error(spark, stored):
    one, two = (table("same", lambda p, m: m, [source("src", stored).at(0)]) for _ in range(2))
    with pytest.raises(ValueError, match="named"):
        frame(spark, table("top", lambda p, a, b: a, [one, two]), (1997, 12))
    with pytest.raises(ValueError, match="named"):
        run_chain(spark, table("top", lambda p, a, b: a, [one, two]), (1997, 12))


def _shared_chain(root, out):
    """base is read three times: by left and right, and by top itself."""
    count = F.count(F.lit(1)).alias("n")
    months = lambda m: m.groupBy("year", "month").agg(count)
    base = table("base", lambda p, m: m.groupBy("cust").agg(count), [source("src", root, T.StructType([T.StructField("cust", T.LongType())])).at(0)],
                 build_range=lambda m: m.groupBy("cust", "year", "month").agg(count))
    left = table("left", lambda p, b: b.groupBy().agg(count), [base.at(0)], build_range=months)
    right = table("right", lambda p, b: b.groupBy().agg(count), [base.at(0)], build_range=months)
    build = lambda p, a, b, c: a.unionByName(b).unionByName(c.groupBy().agg(count))
    return table("top", build, [left.at(0), right.at(0), base.at(1)], root=out, build_range=lambda a, b, c: a.unionByName(b).unionByName(months(c)))


def test_a_table_with_several_readers_is_computed_once(spark, stored, scratch, monkeypatch):
    from tidemark.plans import chains

    cuts, cut = [], chains.cut_lineage

    def recorded(df, **given):
        cuts.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, **given)

    monkeypatch.setattr(chains, "cut_lineage", recorded)
    top = _shared_chain(stored, scratch("shared"))
    plain = frame(spark, top, (1997, 12))
    assert not cuts
    once = frame(spark, top, (1997, 12), cut_shared=True)
    # December has two readers and is stored once; November has one and stays in the plan.
    assert len(cuts) == 1 and cuts[0].count("FileScan") == 1
    months = [{f.split("month=")[1].split("/")[0] for f in df.inputFiles() if stored.rsplit("/", 1)[-1] in f} for df in (once, plain)]
    assert months == [{"11"}, {"11", "12"}]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect())) == [(11,), (12,), (12,)]
    # By range the months of all readers are computed together, whatever their number.
    cuts.clear()
    backfill_table(spark, top, [(1997, 11), (1997, 12), (1998, 1)])
    assert len(cuts) == 1 and cuts[0].count("FileScan") == 1
    got = sorted((r["year"], r["month"], r["n"]) for r in read_table(spark, top.root).collect())
    assert got == sorted((y, m, n) for y, m, before in ((1997, 11, 10), (1997, 12, 11), (1998, 1, 12)) for n in (m, m, before))


def test_trailing_and_latest_by_range_are_those_of_each_month(spark, scratch):
    root = scratch("gappy")
    months = [Period.from_index(Period(2015, 1).index + i) for i in range(40) if i % 5 not in (1, 2)]
    replace_periods(spark.createDataFrame([(c, p.year, p.month) for p in months for c in range(p.month)], "cust long, year int, month int"), root)
    src = source("src", root, T.StructType([T.StructField("cust", T.LongType())]))
    count = F.count(F.lit(1)).alias("n")

    def whole(p, t, l, r):  # noqa: E741
        return t.groupBy().agg(count, F.sum(F.col("year") * 100 + F.col("month")).alias("own")).crossJoin(l.groupBy().agg(count.alias("l"))).crossJoin(r.groupBy().agg(count.alias("r")))

    def ranged(t, l, r):  # noqa: E741
        by = ["year", "month"]
        own = F.sum(F.col("own_year") * 100 + F.col("own_month")).alias("own")
        return t.groupBy(*by).agg(count, own).join(l.groupBy(*by).agg(count.alias("l")), by).join(r.groupBy(*by).agg(count.alias("r")), by)

    deps = [src.trailing(3), src.latest(2), src.most_recent()]
    by_month = table("by_month", whole, deps)
    by_range = table("by_range", whole, deps, root=scratch("by-range"), build_range=ranged)
    few, many = [Period(2016, m) for m in range(1, 5)], [Period.from_index(Period(2015, 4).index + i) for i in range(36)]
    used = [_jobs(spark, f"avail{i}", lambda: backfill_table(spark, by_range, wanted)) for i, wanted in enumerate((few, many))]
    assert used[1] - used[0] <= 1  # Spark lists more than 32 paths in a job of its own
    got = {(r["year"], r["month"]): (r["n"], r["own"], r["l"], r["r"]) for r in read_table(spark, by_range.root).collect()}
    assert set(got) == {(p.year, p.month) for p in many}
    for p in (many[0], many[7], many[20], many[-1]):
        assert got[(p.year, p.month)] == tuple(frame(spark, by_month, p).first())
    with pytest.raises(FileNotFoundError):
        backfill_table(spark, by_range, [(2015, 1)])


@pytest.fixture
def stored(spark, scratch):
    root = scratch("chain-src")
    data = [(c, y, m) for (y, m) in [(1997, 10), (1997, 11), (1997, 12), (1998, 1)] for c in range(m)]
    replace_periods(spark.createDataFrame(data, "cust long, year int, month int"), root)
    return root


def test_chain_frame_run_and_backfill(spark, scratch, stored):
    src = source("src", stored)
    counts = table("counts", lambda p, m: m.groupBy().agg(F.count(F.lit(1)).alias("n")), [src.at(0)],
                   root=scratch("counts"))
    lagged = table("lagged", lambda p, now, lag: now.withColumn("n_lag", F.lit(lag.first()["n"])),
                   [counts.at(0), counts.at(2)])
    assert frame(spark, lagged, (1998, 1)).first().asDict() == {"n": 1, "n_lag": 11}
    run(spark, counts, (1998, 1))
    assert read_period(spark, counts.root, (1998, 1)).first()["n"] == 1
    backfill_table(spark, counts, [(1997, 10), (1997, 11)])
    got = {(r["year"], r["month"]): r["n"] for r in read_table(spark, counts.root).collect()}
    assert got == {(1997, 10): 10, (1997, 11): 11, (1998, 1): 1}
    # stored months are read back instead of rebuilt
    assert frame(spark, counts, (1997, 11), use_stored=["counts"]).first()["n"] == 11


def test_latest_dependency(spark, stored):
    src = source("src", stored)
    latest = table("latest", lambda p, m: m, [src.latest(0)])
    assert frame(spark, latest, (1998, 6)).count() == 1  # 1998-01 holds one row


@pytest.mark.parametrize("mode", ["table", "checkpoint"])
def test_cut_lineage(spark, mode):
    df = spark.range(1000).where(F.col("id") % 3 == 0)
    cut = cut_lineage(df, mode=mode)
    assert cut.count() == df.count()
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_external_dependency_and_wide_id(spark, stored):
    ext = external("ext", stored)
    wide = table("wide", lambda p, e: e.groupBy("cust").count(), [ext.at(0)], id_col="cust")
    assert frame(spark, wide, (2030, 1)).count() == 12  # all months read, whatever the run month
    bad = table("bad", lambda p, e: e.select("year"), [ext.at(0)], id_col="cust")
    with pytest.raises(ValueError):
        frame(spark, bad, (2030, 1))
    schema = T.StructType([T.StructField("cust", T.LongType())])
    with pytest.raises(ValueError):
        table("both", lambda p: None, schema=schema, id_col="cust")


def test_clear_scratch(spark):
    import time

    from tidemark.session import clear_scratch, scratch_path
    from tidemark.sources import fs

    path = scratch_path(spark, "clear-me")
    fs.mkdirs(spark, path)
    assert clear_scratch(spark, 3600, prefix="clear-me") == []
    time.sleep(0.05)
    assert any(p.endswith(path.rsplit("/", 1)[-1]) for p in clear_scratch(spark, 0, prefix="clear-me"))
    assert not fs.exists(spark, path)
