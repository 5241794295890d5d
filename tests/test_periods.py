import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import (
    Period,
    current,
    last_day_of_month,
    month_end,
    month_end_date,
    period_key,
    period_range,
    previous,
    shift_date,
    shift_months,
)


def test_period_arithmetic_across_year_end():
    run = Period(1998, 2)
    assert run.minus(4) == Period(1997, 10)
    assert run.minus(2) == Period(1997, 12)
    assert run.minus(-11) == Period(1999, 1)
    assert Period.from_index(run.index) == run
    assert run.key == "1998.02"
    assert Period(2020, 1).key < Period(2020, 10).key


def test_period_parsing_and_validation():
    assert Period.of("1998-02") == Period.of("1998.02") == Period.of((1998, 2)) == Period(1998, 2)
    assert Period.of(dt.date(2020, 3, 31)) == Period(2020, 3)
    with pytest.raises(ValueError):
        Period(2020, 13)
    with pytest.raises(TypeError):
        Period("2020", 1)


def test_period_range_inclusive():
    assert period_range("1997-11", "1998-02") == [Period(1997, 11), Period(1997, 12), Period(1998, 1), Period(1998, 2)]
    assert period_range("1998-02", "1998-01") == []


def test_offset_policies():
    assert current() == 0
    assert previous() == 1
    assert previous(3) == 3
    with pytest.raises(ValueError):
        previous(-1)


def test_month_shift_clamps_to_month_end():
    assert shift_date(dt.date(2020, 3, 31), -1) == dt.date(2020, 2, 29)
    assert shift_date(dt.date(2019, 3, 31), -1) == dt.date(2019, 2, 28)
    assert shift_date(dt.date(1998, 1, 15), -3) == dt.date(1997, 10, 15)


def test_last_day_keeps_time_of_day():
    assert last_day_of_month(dt.datetime(2020, 2, 10, 5, 0)) == dt.datetime(2020, 2, 29, 5, 0)
    assert last_day_of_month(dt.date(2021, 12, 3)) == dt.date(2021, 12, 31)


def test_column_functions(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 2, 10, 5, 0), dt.date(2020, 3, 31))], "ts timestamp_ntz, d date"
    )
    row = df.select(
        month_end("ts").alias("ts_end"),
        month_end("d").alias("d_end"),
        F.last_day("d").alias("d_last"),
        period_key(F.year("ts"), F.month("ts")).alias("key"),
        shift_months("d", -1).alias("prev"),
    ).first()
    assert row["ts_end"] == dt.datetime(2020, 2, 29, 5, 0)
    assert row["d_last"] == dt.date(2020, 3, 31)
    assert row["key"] == "2020.02"
    assert row["prev"] == dt.date(2020, 2, 29)
    assert row["d_end"] == dt.datetime(2020, 3, 31)
    assert df.select(month_end_date("d").alias("x")).first()["x"] == dt.date(2020, 3, 31)


def test_period_of_path():
    from tidemark.functions.periods import period_of_path

    assert period_of_path("s3a://b/t/year=2020/month=1") == Period(2020, 1)
    assert period_of_path("file:/x/t/year=2020/month=10/part-0.parquet") == Period(2020, 10)
    assert period_of_path("/t/year=1997/month=12/_SUCCESS").key == "1997.12"
    with pytest.raises(ValueError):
        period_of_path("/t/year=2020")
