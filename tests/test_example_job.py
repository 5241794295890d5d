"""The worked job: badge swipes counted per person and name, for the names on a list."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.compare import assert_frames_equal
from tidemark.operators.filters import allow_from, allow_list
from tidemark.plans.jobs import name_counts

# (id, name, day): one name under two ids, an id with two names, a null name and a null id, a repeated row.
SWIPES = [
    (11, "Mira", "2021-03-01"),
    (11, "Mira", "2021-03-01"),
    (11, "Mira", "2021-03-09"),
    (12, "Mira", "2021-03-02"),
    (12, "Okon", "2021-03-02"),
    (13, None, "2021-03-04"),
    (None, "Okon", "2021-03-05"),
    (14, "okon", "2021-03-05"),
    (15, "Veer", "2021-02-28"),
]
LISTED = ["Okon", "Mira", "Absent"]
COUNTED = [(11, "Mira", 3), (12, "Mira", 1), (12, "Okon", 1), (None, "Okon", 1)]


@pytest.fixture
def swipes(spark):
    return spark.createDataFrame(SWIPES, "id long, name string, day string")


def test_name_counts(spark, swipes):
    out = name_counts(swipes, LISTED)
    assert out.columns == ["id", "name", "count"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(COUNTED, key=str)
    assert_frames_equal(spark.createDataFrame(COUNTED, "id long, name string, count long"), out, keys=["id", "name"])


def test_missing_allow_list_is_an_error(swipes):
    with pytest.raises(ValueError):
        name_counts(swipes, None)


def test_empty_allow_list_keeps_nothing(swipes):
    assert name_counts(swipes, []).count() == 0


def test_nulls_never_match(swipes):
    assert {r["id"] for r in allow_list(swipes, "name", ["Veer", None]).collect()} == {15}


@pytest.mark.parametrize("length", [3, 20_000])
def test_a_list_of_any_length_behaves_alike(spark, swipes, length):
    """Another case of the column's name, and values of another numeric type, whatever the length."""
    names = [*LISTED, *(f"other{i}" for i in range(length))]
    assert allow_list(swipes, "NAME", names).count() == 6
    numbers = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double")
    assert [r["x"] for r in allow_list(numbers, "X", [1, *range(10, length)]).collect()] == [1.0]
    whole = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r["x"] for r in allow_list(whole, "x", [2.0, 1.5, *(float(i) for i in range(10, length))]).collect()] == [2]
    with pytest.raises(TypeError):
        allow_list(whole, "x", ["1"])


def test_awkward_strings_in_a_list(spark):
    odd = ["it's", "a\\b", 'q"q', "é\n", "%_", "X'41'"]
    df = spark.createDataFrame([(s,) for s in odd] + [("plain",)], "s string")
    assert sorted(r["s"] for r in allow_list(df, "s", odd).collect()) == sorted(odd)


def test_values_are_of_the_columns_own_type(spark, scratch):
    """A float column holds the float nearest to 1.1, and so does the list."""
    path = scratch("floats")
    spark.createDataFrame([(1.1,), (2.5,), (float("inf"),), (float("nan"),)], "x float").write.parquet(path)
    floats = spark.read.parquet(path)
    listed = allow_list(floats, "x", [1.1, 3])
    assert listed.count() == 1 and "PushedFilters: [In(x, [1.1,3.0])]" in listed._jdf.queryExecution().executedPlan().toString()
    assert allow_list(floats, "x", [1.1, float("inf"), float("nan")]).count() == 3
    assert allow_list(floats.select(F.col("x").cast("double").alias("x")), "x", [1.1]).count() == 0
    prices = spark.sql("SELECT cast(1.01 AS decimal(18,2)) AS x")
    assert allow_list(prices, "x", [1.005]).count() == 0 and allow_list(prices, "x", [1.01]).count() == 1


def test_allow_from_a_frame(spark, swipes):
    listed = spark.createDataFrame([("Mira",), (None,), ("Mira",)], "who string")
    out = allow_from(swipes, "name", listed, "who")
    assert out.columns == swipes.columns and out.count() == 4
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
    assert swipes.where(F.col("name") == "Mira").count() == 4
