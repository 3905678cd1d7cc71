import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from candlewick.functions import timegrid as TG


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t timestamp_ntz").select(expr("t").alias("x")).first()["x"]


def test_parse_interval():
    assert TG.parse_interval("15m") == dt.timedelta(minutes=15)
    assert TG.parse_interval("5T") == dt.timedelta(minutes=5)
    assert TG.parse_interval("1h") == dt.timedelta(hours=1)
    assert TG.parse_interval("8H") == dt.timedelta(hours=8)
    for bad in ("15", "1d", "m", ""):
        with pytest.raises(ValueError):
            TG.parse_interval(bad)


@pytest.mark.parametrize("t,iv,expected", [
    ("2024-01-01 12:50:51", 15, "2024-01-01 13:00:00"),
    ("2024-01-01 12:39:51", 15, "2024-01-01 12:45:00"),
    ("2024-01-01 12:45:00", 15, "2024-01-01 13:00:00"),
    ("2024-01-01 23:59:30", 15, "2024-01-02 00:00:00"),
    ("2024-01-01 23:58:00", 7, "2024-01-02 00:00:00"),   # grid restarts at midnight
    ("2024-01-01 12:50:51", 7, "2024-01-01 12:57:00"),
    ("2024-01-01 17:00:00", 480, "2024-01-02 00:00:00"),
])
def test_next_boundary(spark, t, iv, expected):
    got = one(spark, lambda c: TG.next_boundary(c, iv), dt.datetime.fromisoformat(t))
    assert got == dt.datetime.fromisoformat(expected)


@pytest.mark.parametrize("t,p,expected", [
    ("2024-01-15", 1, "2024-01"), ("2024-12-31", 1, "2024-12"), ("2024-05-01", 3, "2024-04"),
    ("2024-06-30", 6, "2024-01"), ("2024-07-01", 6, "2024-07"), ("2018-12-05", 3, "2018-10"),
])
def test_period_label(spark, t, p, expected):
    assert one(spark, lambda c: TG.period_label(c, p), dt.datetime.fromisoformat(t)) == expected


@pytest.mark.parametrize("t,p,start,end", [
    ("2024-01-15", 1, "2023-12-01", "2024-01-01"),
    ("2024-01-01", 1, "2023-11-01", "2023-12-01"),   # exactly on a boundary: one more step back
    ("2024-03-01", 1, "2024-01-01", "2024-02-01"),
    ("2024-01-01", 3, "2023-07-01", "2023-10-01"),
    ("2024-02-10", 3, "2023-10-01", "2024-01-01"),
    ("2025-01-02", 12, "2024-01-01", "2025-01-01"),  # December -> January roll
])
def test_latest_complete_period(spark, t, p, start, end):
    got = one(spark, lambda c: TG.latest_complete_period(c, p), dt.datetime.fromisoformat(t))
    assert (str(got["period_start"]), str(got["period_end"])) == (start, end)


def test_latest_complete_period_before_start_is_null(spark):
    assert one(spark, lambda c: TG.latest_complete_period(c, 1), dt.datetime(2018, 5, 1)) is None
    mid = dt.date(2023, 6, 15)
    got = one(spark, lambda c: TG.latest_complete_period(c, 1, start=mid), dt.datetime(2023, 6, 20))
    assert got is None


def test_period_cutoff(spark):
    got = one(spark, lambda c: TG.period_cutoff(c, 30, 1), dt.datetime(2024, 3, 10))
    assert str(got) == "2024-02-01"
    got = one(spark, lambda c: TG.period_cutoff(c, 30, 3), dt.datetime(2024, 3, 10))
    assert str(got) == "2024-01-01"


def _reference_bucket(t: dt.datetime, iv: int, off: int) -> dt.datetime:
    m = t.replace(second=0, microsecond=0)
    shifted_minute = (t - dt.timedelta(minutes=off)).minute
    return m - dt.timedelta(minutes=shifted_minute % iv)


@settings(max_examples=60, deadline=None)
@given(st.datetimes(min_value=dt.datetime(2019, 1, 1), max_value=dt.datetime(2030, 1, 1)),
       st.sampled_from([1, 2, 3, 5, 10, 15, 20, 30, 60]), st.integers(min_value=-120, max_value=120))
def test_bucket_start_matches_minute_formula(spark, t, iv, off):
    t = t.replace(second=0, microsecond=0)
    got = one(spark, lambda c: TG.bucket_start(c, iv, off), t)
    assert got == _reference_bucket(t, iv, off % iv)


def test_batch_time(spark):
    got = one(spark, lambda c: TG.batch_time(c, 15), dt.datetime(2024, 1, 1, 23, 45))
    assert got == dt.datetime(2024, 1, 2, 0, 0)
    assert TG.minutes_of("1h") == 60 and TG.minutes_of(15) == 15
