"""Plan shape: JVM-only expressions, pushed filters, no extra shuffles."""

import datetime as dt

from candlewick import fixtures as fx
from candlewick.operators.quality import clip_to_trading_range, find_gaps
from candlewick.plans.store import BarStore
from helpers import bars_df, series


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _store(spark, root):
    s = BarStore(spark, root, base_minutes=15)
    rows = series("2024-01-18 00:00", 300, symbol="AAAUSDT") + series("2024-01-18 00:00", 300, symbol="BBBUSDT")
    s.write_archive(bars_df(spark, [r for r in rows if r[0] <= dt.datetime(2024, 1, 20)]), "usdt_perp")
    s.append_recent(bars_df(spark, [r for r in rows if r[0] >= dt.datetime(2024, 1, 19)]), "usdt_perp")
    return s


def test_resample_plan_pushdown_and_no_python(spark, tmp_store_root):
    s = _store(spark, tmp_store_root)
    df = s.get_market("usdt_perp", 60, 15, "2024-01-18 00:00:00", "2024-01-19 12:00:00", order=False)
    p = plan(df)
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "SortAggregate" not in p
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(open_time" in final.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    q = s.scan("archive", "usdt_perp", "2024-01-18", "2024-01-19")
    ex = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in ex and "period" in ex and "PushedFilters" in ex


def test_hybrid_merge_adds_no_third_shuffle(spark, tmp_store_root):
    s = _store(spark, tmp_store_root)
    df = s.get_market("usdt_perp", 60, 15, "2024-01-18 00:00:00", "2024-01-21 00:00:00", order=False)
    p = df._jdf.queryExecution().sparkPlan().toString()      # before AQE re-planning
    assert p.count("Exchange") <= 2, p
    assert "SortAggregate" not in p and "PythonUDF" not in p
    keys = [(r["symbol"], r["resample_time"]) for r in df.collect()]
    assert len(keys) == len(set(keys))


def test_clip_runs_no_job_of_its_own(spark):
    bars = bars_df(spark, series("2024-01-01 00:00", 20))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("clip", "clip")
    df = clip_to_trading_range(bars)
    assert list(tracker.getJobIdsForGroup("clip")) == []          # building the plan starts nothing
    assert df.count() == 20
    spark.sparkContext.setJobGroup("", "")


def test_gap_finder_shuffles_bars_once(spark):
    df = find_gaps(bars_df(spark, series("2024-01-01 00:00", 10)), 15)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert p.count("Scan ExistingRDD") + p.count("LocalTableScan") == 1 and "Python" not in p
    # bars meet in symbol-days; the window runs over one row a symbol-day
    assert "_day" in p and p.count("ObjectHashAggregate") == 2


def test_get_symbol_has_no_single_task(spark, tmp_store_root):
    s = _store(spark, tmp_store_root)
    df = s.get_symbol("usdt_perp", "AAAUSDT", 60, 0, "2024-01-18", "2024-01-21")
    assert "Coalesce" not in df._jdf.queryExecution().executedPlan().toString()


def test_fixture_plan_has_no_python(spark):
    p = plan(fx.dense_bars(spark, "/root/testdata/sf0.001"))
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_dense_bars_stay_dealt_by_symbol(spark):
    """Filling the slots and resampling them shuffles sparse bars only; tiers are cut without a join."""
    from candlewick.operators.resample import resample
    done = _executed(resample(fx.dense_bars(spark, "/root/testdata/sf0.001"), 60, 15, 15))
    assert done[:done.index("Generate")].count("Exchange") == 0 and done.count("Exchange") == 2
    for tier in fx.tiers(spark, "/root/testdata/sf0.001"):
        assert "Join" not in plan(tier)


def test_symbol_sets_and_stored_keys_are_not_broadcast_row_by_row(spark):
    from candlewick.operators.symbols import onboarded
    from candlewick.plans.store import rows_to_insert
    archive, recent = fx.tiers(spark, "/root/testdata/sf0.001")
    right = plan(onboarded(archive, recent))
    assert right.split("Generate")[0].count("Join") == 1 and "BroadcastExchange" in right and right.count("HashAggregate(keys=[symbol#") >= 8   # both sides one row a symbol
    assert "BroadcastExchange" not in plan(rows_to_insert(recent, archive))
