"""Resample and hybrid-merge semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlewick.operators.resample import bucket_audit, merge_tiers, resample
from candlewick.plans.store import BarStore, choose_tier, validate
from candlewick.schema import RESAMPLED_COLUMNS
from helpers import bar, bars_df, series


def test_first_last_by_time_not_by_input_order(spark):
    rows = series("2024-01-01 00:00", 4)
    df = bars_df(spark, list(reversed(rows)))
    out = resample(df, 60, 0, 15).collect()
    assert len(out) == 1
    r = out[0]
    assert r["open"] == 1.0 and r["close"] == 4.0 and r["high"] == 4.0 and r["low"] == 1.0
    assert r["volume"] == 4.0 and r["trade_num"] == 4
    # avg_price is the first base bar's, not a recomputed mean
    assert r["avg_price"] == 1.0
    assert list(resample(df, 60, 0, 15).columns) == RESAMPLED_COLUMNS


def test_partial_buckets_dropped_and_offset(spark):
    df = bars_df(spark, series("2024-01-01 00:15", 8))   # 00:15 .. 02:00
    assert resample(df, 60, 0, 15).count() == 1          # 01:00 bucket only
    at15 = [r["resample_time"] for r in resample(df, 60, 15, 15).collect()]
    assert sorted(at15) == [dt.datetime(2024, 1, 1, 0, 15), dt.datetime(2024, 1, 1, 1, 15)]
    # negative offset is taken modulo the interval
    neg = [r["resample_time"] for r in resample(df, 60, -45, 15).collect()]
    assert sorted(neg) == sorted(at15)


def test_interval_not_multiple_of_base_floors(spark):
    df = bars_df(spark, series("2024-01-01 00:00", 12, step_min=5))
    assert resample(df, 3, 0, 5).count() == 0              # needs 0 bars: never equal
    out = resample(df, 12, 0, 5).collect()                  # needs 2 bars
    assert all(r["volume"] == 2.0 for r in out) and len(out) > 0
    with pytest.raises(ValueError):
        resample(df, 0, 0, 5)


def test_zero_volume_bar_avg_price_null_first(spark):
    rows = [bar("2024-01-01 00:00", v=0.0, q=0.0)] + series("2024-01-01 00:15", 3)
    out = resample(bars_df(spark, rows), 60, 0, 15).first()
    assert out["avg_price"] is None


def test_trade_num_overflow_raises(spark):
    rows = [bar(f"2024-01-01 00:{m:02d}", n=2_000_000_000) for m in (0, 15, 30, 45)]
    with pytest.raises(Exception):
        resample(bars_df(spark, rows), 60, 0, 15).collect()


def test_bucket_audit(spark):
    rows = series("2024-01-01 00:00", 4) + series("2024-01-01 01:00", 2)
    a = bucket_audit(bars_df(spark, rows), 60, 0, 15).first()
    assert (a["complete_buckets"], a["partial_buckets"], a["bars"]) == (1, 1, 6)


def test_merge_recent_wins_each_column(spark):
    base = series("2024-01-01 00:00", 4)
    arch = resample(bars_df(spark, base), 60, 0, 15)
    revised = [bar(r[0], o=r[2] + 100, v=0.0, q=0.0) for r in base]    # avg_price NULL in recent
    rec = resample(bars_df(spark, revised), 60, 0, 15)
    m = merge_tiers(arch, rec).first()
    assert m["open"] == 101.0 and m["avg_price"] is None and m["volume"] == 0.0
    assert merge_tiers(None, None) is None


def test_validate_and_choose_tier():
    validate("usdt_perp", 60, 15, 15)
    for args in (("coin_perp", 60, 0), ("usdt_perp", 45, 0), ("usdt_perp", 60, 60), ("usdt_perp", 60, 10),
                 ("usdt_perp", 0, 0), ("usdt_perp", 120, 0)):
        with pytest.raises(ValueError):
            validate(*args, base=15)
    t = dt.datetime(2024, 1, 20)
    assert choose_tier(dt.datetime(2024, 1, 21), dt.datetime(2024, 1, 22), t) == "recent"
    assert choose_tier(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), t) == "archive"
    assert choose_tier(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 22), t) == "hybrid"
    assert choose_tier(dt.datetime(2024, 1, 1), t, t) == "hybrid"


def _tiers(spark):
    # archive: AAA and BBB up to 06:00; recent: AAA and CCC from 05:00 with shifted prices
    arch = series("2024-01-01 00:00", 25, symbol="AAAUSDT") + series("2024-01-01 00:00", 25, symbol="BBBUSDT")
    rec = series("2024-01-01 05:00", 20, symbol="AAAUSDT", price=50) + series("2024-01-01 05:00", 20, symbol="CCCUSDT")
    a = bars_df(spark, arch).withColumn("market", F.lit("usdt_perp"))
    r = bars_df(spark, rec).withColumn("market", F.lit("usdt_perp"))
    return BarStore(spark, frames={"archive": a, "recent": r}, base_minutes=15)


def test_hybrid_edges_and_precedence(spark):
    store = _tiers(spark)
    assert store.archive_watermark("usdt_perp") == dt.datetime(2024, 1, 1, 6, 0)
    out = store.get_market("usdt_perp", 60, 0, "2024-01-01 02:00:00", "2024-01-01 08:00:00").collect()
    keys = [(r["symbol"], r["resample_time"].hour) for r in out]
    assert len(keys) == len(set(keys))
    # a symbol present in one tier only still appears
    assert {"AAAUSDT", "BBBUSDT", "CCCUSDT"} == {k[0] for k in keys}
    # redundancy: buckets one hour before begin come back unclipped
    assert ("AAAUSDT", 1) in keys
    clipped = store.get_market("usdt_perp", 60, 0, "2024-01-01 02:00:00", "2024-01-01 08:00:00", clip=True).collect()
    assert all(dt.datetime(2024, 1, 1, 2) <= r["resample_time"] <= dt.datetime(2024, 1, 1, 8) for r in clipped)
    # the hot (recent) row wins the overlapping bucket
    aaa5 = [r for r in out if r["symbol"] == "AAAUSDT" and r["resample_time"].hour == 5][0]
    assert aaa5["open"] == 50.0


def test_inverted_range_single_tier_is_empty_with_schema(spark):
    store = _tiers(spark)
    out = store.get_market("usdt_perp", 60, 0, "2024-01-01 04:00:00", "2024-01-01 02:00:00")
    assert out.count() == 0 and out.columns == RESAMPLED_COLUMNS


def test_empty_archive_falls_back_to_recent(spark):
    r = bars_df(spark, series("2024-01-01 00:00", 8)).withColumn("market", F.lit("usdt_perp"))
    store = BarStore(spark, frames={"recent": r}, base_minutes=15)
    assert store.get_market("usdt_perp", 60, 0, "2023-12-31", "2024-01-02").count() == 2
    with pytest.raises(ValueError):
        store.get_market("usdt_perp", 60, 7, "2023-12-31", "2024-01-02")


def _pandas_resample(rows, iv, off):
    import pandas as pd
    df = pd.DataFrame(rows, columns=["open_time", "symbol", "open", "high", "low", "close", "volume", "quote_volume",
                                     "trade_num", "tb", "tq", "avg_price"])
    minutes = (df["open_time"] - pd.Timestamp("1970-01-01")).dt.total_seconds() // 60
    df["bucket"] = pd.to_datetime((minutes - (minutes - off) % iv) * 60, unit="s")
    out = {}
    for (sym, b), g in df.sort_values("open_time").groupby(["symbol", "bucket"]):
        if len(g) == iv // 15:
            out[(sym, b.to_pydatetime())] = (g["open"].iloc[0], g["high"].max(), g["low"].min(), g["close"].iloc[-1],
                                            g["volume"].sum(), int(g["trade_num"].sum()))
    return out


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["AUSDT", "BUSDT"]), st.integers(0, 200), st.integers(1, 64),
                          st.integers(0, 3)), min_size=1, max_size=80,
                unique_by=lambda x: (x[0], x[1])),
       st.sampled_from([(30, 0), (60, 0), (60, 15), (60, 45), (15, 0)]))
def test_resample_matches_pandas(spark, raw, iv_off):
    iv, off = iv_off
    t0 = dt.datetime(2024, 1, 1)
    rows = [bar(t0 + dt.timedelta(minutes=15 * slot), sym, o=p / 4, h=p / 4 + 1, lo=p / 4 - 1, c=p / 4 + 0.5, v=float(v), n=v)
            for sym, slot, p, v in raw]
    want = _pandas_resample(rows, iv, off)
    got = {(r["symbol"], r["resample_time"]): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["trade_num"])
           for r in resample(bars_df(spark, rows), iv, off, 15).collect()}
    assert got == want
