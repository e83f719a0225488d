import datetime as dt

import pytest
from pyspark.sql import functions as F

from hauldeck.functions import cleaning as C
from hauldeck.functions import numeric as N
from hauldeck.functions import trips as T


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_missing_texts_become_null(spark):
    assert apply(spark, C.clean_str, [" nan ", "", "NaT", "NA", "na", "None", "NaN", None, " Nan ", " a b\t"]) == [None] * 8 + ["Nan", "a b"]


def test_mobile(spark):
    assert apply(spark, C.clean_mobile, ["9876543210.0", "98.01", "+91 98-76", "0", " 0.0 ", "abc"]) == ["9876543210", "981", "+919876", None, None, None]
    assert apply(spark, C.clean_mobile_suffix, ["9876543210.0", "98.01"]) == ["9876543210", "9801"]


def test_day_first_dates(spark):
    got = apply(spark, C.parse_datetime, ["05-01-2024 05:00:00", "2024-01-05", "13/02/2024 10:30", "bad", ""])
    assert got == [dt.datetime(2024, 1, 5, 5), dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 13, 10, 30), None, None]


def test_numbers(spark):
    assert apply(spark, C.safe_float, ["inf", "NaN", "abc", "1.5", "-inf"]) == [None, None, None, 1.5, None]
    assert apply(spark, C.safe_int, ["12.9", "-12.9", "inf", "x"]) == [12, -12, None, None]


def test_rounding_has_no_binary_noise(spark):
    assert apply(spark, lambda c: N.rnd(c), [0.145, 1.005, 2.5, None], "double") == [0.15, 1.01, 2.5, None]


def test_speed_range_gap(spark):
    assert apply(spark, T.speed_range, [0.0, 20.0, 20.5, 21.0, 80.0, 95.0], "double") == ["Stopped (0)", "Slow (1-20)", "Over 80", "Medium (21-40)", "Very Fast (61-80)", "Over 80"]


def test_status_speed(spark):
    texts = ["Moving 65", "moving 12.5 kmph", "Stopped", "Idle", None]
    assert apply(spark, T.status_speed, texts) == [65.0, 12.5, 0.0, None, None]
    assert apply(spark, lambda c: T.status_speed(c, True), texts)[3] == 0.0


def test_duration_text(spark):
    assert apply(spark, T.duration_text, [45.0, 59.6, 60.0, 185.0, 119.7], "double") == ["45m", "60m", "1h", "3h 5m", "1h 60m"]


def test_week_label_keeps_calendar_year(spark):
    assert apply(spark, lambda c: T.week_label(c.cast("timestamp")), ["2024-12-30 10:00:00", "2024-01-01 00:00:00"]) == ["2024-W01", "2024-W01"]


def test_weekday_numbers(spark):
    assert apply(spark, T.weekday_to_sql_day, list(range(7)), "int") == [2, 3, 4, 5, 6, 7, 1]


@pytest.mark.parametrize("n,rate", [(4, 100.0), (500, 75.0), (1, 0.0)])
def test_smoothed_rate_lies_between_raw_and_prior(spark, n, rate):
    [v] = apply(spark, lambda c: T.smoothed_rate(F.lit(n), c, 40.0, 15), [rate], "double")
    assert min(rate, 40.0) <= v <= max(rate, 40.0)


def test_experience_beats_a_few_lucky_trips(spark):
    few, many = (apply(spark, lambda c, n=n: T.smoothed_rate(F.lit(n), c, 40.0, 15), [r], "double")[0] for n, r in ((4, 100.0), (500, 75.0)))
    assert many >= few
