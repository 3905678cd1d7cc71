import datetime as dt

import pytest

from candlewick.plans.store import BarStore, latest_state
from candlewick.schema import SENTINEL_TIME
from helpers import bar, bars_df, series


def test_state_latest_keep_first_and_base_interval(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    assert s.get_state_value("k") is None
    s.put_state("k", "a", dt.datetime(2024, 1, 1))
    s.put_state("k", "b", dt.datetime(2024, 1, 2))
    assert s.get_state_value("k") == "b" and s.get_state_value("k", keep_first=True) == "a"
    s.check_base_interval()
    s.check_base_interval()
    with pytest.raises(ValueError):
        BarStore(spark, tmp_store_root, base_minutes=5).check_base_interval()
    s.compact_state()
    assert s.get_state_value("k") == "b"
    assert latest_state(s.state_log()).count() == 2


def test_archive_write_merges_and_watermark(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    assert s.archive_watermark("usdt_perp") == SENTINEL_TIME
    dec = series("2023-12-31 22:00", 4)
    jan = series("2024-01-01 00:00", 4)
    s.write_archive(bars_df(spark, dec + jan), "usdt_perp")
    assert s.archive_watermark("usdt_perp") == dt.datetime(2024, 1, 1, 0, 45)
    assert s.latest_period("archive", "usdt_perp") == "2024-01"
    # corrected bars replace stored ones in any period; the others stay
    s.write_archive(bars_df(spark, [bar(dec[0][0], o=99.0), bar(jan[1][0], o=98.0)]), "usdt_perp")
    got = {r["open_time"]: r["open"] for r in s.scan("archive", "usdt_perp").collect()}
    assert len(got) == 8 and got[dec[0][0]] == 99.0 and got[jan[1][0]] == 98.0 and got[jan[0][0]] == 1.0
    # new bars of a stored period join it
    s.write_archive(bars_df(spark, series("2024-01-02 00:00", 4)), "usdt_perp")
    assert s.scan("archive", "usdt_perp").count() == 12
    # partition pruning: only the January partition is read for a January range
    q = s.scan("archive", "usdt_perp", "2024-01-01", "2024-01-01 01:00:00")
    assert q.count() == 4
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert {f.rsplit("period=", 1)[1][:7] for f in q.inputFiles()} >= {"2024-01"}


def test_append_reads_only_the_batch_periods(spark, tmp_store_root):
    """One stray old bar does not widen the stored side to everything in between."""
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    for month in (1, 2, 3, 4):
        s.append_recent(bars_df(spark, series(f"2024-0{month}-10 00:00", 4)), "usdt_perp")
    seen = []
    real = s.tier
    s.tier = lambda *a: seen.append(real(*a)) or seen[-1]
    jan, apr = series("2024-01-10 00:00", 2), series("2024-04-10 00:00", 6)
    s.append_recent(bars_df(spark, jan + apr), "usdt_perp")
    assert s.scan("recent", "usdt_perp").count() == 18
    assert s.periods("recent", "usdt_perp") == ["2024-01", "2024-02", "2024-03", "2024-04"]
    s.compact_recent("usdt_perp")
    assert s.scan("recent", "usdt_perp").count() == 18


def test_nothing_leaves_both_tiers(spark, tmp_store_root):
    """The archive ends inside the period that is exported."""
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    days = [series(f"2024-01-{d:02d} 00:00", 96) for d in range(10, 32)] + [series(f"2024-02-{d:02d} 00:00", 96) for d in range(1, 13)]
    rows = [r for d in days for r in d]
    s.write_archive(bars_df(spark, [r for d in days[:11] for r in d]), "usdt_perp")       # to 20 January
    s.append_recent(bars_df(spark, [r for d in days[9:] for r in d]), "usdt_perp")        # from 19 January
    info = s.export_period("usdt_perp", as_of=dt.datetime(2024, 2, 12), retention_days=7)
    assert info["exported"]
    both = s.scan("archive", "usdt_perp").union(s.scan("recent", "usdt_perp")).select("open_time").distinct().count()
    assert both == len(rows)
    assert s.scan("archive", "usdt_perp").count() == 22 * 96
    # expiry alone removes nothing that the archive lacks
    s.expire_recent("usdt_perp", dt.datetime(2024, 2, 20))
    assert s.scan("recent", "usdt_perp").count() == 12 * 96


def test_bootstrap_of_a_stale_archive(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = series("2023-10-31 00:00", 96) + series("2023-11-05 00:00", 96)
    s.write_archive(bars_df(spark, rows), "usdt_perp")
    assert s.bootstrap_recent("usdt_perp", as_of=dt.datetime(2024, 2, 15)) == dt.datetime(2023, 11, 6)
    assert s.scan("archive", "usdt_perp").count() == 96 and s.scan("recent", "usdt_perp").count() == 96


def test_two_loads_clip_like_one(spark, tmp_store_root):
    from candlewick.plans.load import archive_clipped
    jan = series("2024-01-31 00:00", 96)
    feb = [bar(r[0], v=0.0) for r in series("2024-02-01 00:00", 48)] + series("2024-02-01 12:00", 48)
    for k, loads in enumerate(([jan, feb], [feb, jan], [jan + feb])):
        s = BarStore(spark, f"{tmp_store_root}-{k}", base_minutes=15)
        for rows in loads:
            archive_clipped(s, bars_df(spark, rows), "usdt_perp")
        assert s.scan("archive", "usdt_perp").count() == 192


def test_state_compaction_keeps_first_and_latest(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root)
    for i in range(6):
        s.put_state("k", str(i), dt.datetime(2024, 1, 1 + i))
    s.compact_state()
    assert s.state_log().count() == 2
    assert s.get_state_value("k") == "5" and s.get_state_value("k", keep_first=True) == "0"


def test_append_keeps_stored_and_commit_replay(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15, as_of=dt.datetime(2024, 1, 2))
    first = series("2024-01-01 00:00", 4)
    s.append_recent(bars_df(spark, first), "usdt_perp")
    revised = [bar(r[0], o=50.0) for r in first] + series("2024-01-01 01:00", 2, price=7)
    batch = bars_df(spark, revised + revised[:1])              # duplicate key inside the batch
    s.commit_batch(batch, "usdt_perp", dt.datetime(2024, 1, 1, 1, 30))
    s.commit_batch(batch, "usdt_perp", dt.datetime(2024, 1, 1, 1, 30))   # replay: nothing new
    rows = s.scan("recent", "usdt_perp").collect()
    assert len(rows) == 6
    assert {r["open"] for r in rows if r["open_time"].hour == 0} == {1.0, 2.0, 3.0, 4.0}
    assert s.ready("usdt_perp") == "2024-01-01 01:30:00"
    far = BarStore(spark, tmp_store_root, base_minutes=15, as_of=dt.datetime(2024, 3, 1))
    assert far.recent_watermark("usdt_perp") == SENTINEL_TIME     # older than 30 days


def test_replace_instruments_one_market(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root)
    schema = "market string, symbol string, status string"
    s.replace_instruments(spark.createDataFrame([("usdt_perp", "A", "TRADING"), ("usdt_spot", "B", "TRADING")], schema),
                          "usdt_perp")
    s.replace_instruments(spark.createDataFrame([("usdt_spot", "B", "TRADING")], schema), "usdt_spot")
    s.replace_instruments(spark.createDataFrame([("usdt_spot", "C", "BREAK")], schema), "usdt_spot")
    got = sorted((r["market"], r["symbol"]) for r in s.instruments().collect())
    assert got == [("usdt_perp", "A"), ("usdt_spot", "C")]
    with pytest.raises(ValueError):
        s.get_instruments("coin_perp")
    assert s.get_instruments("usdt_spot").count() == 1


def test_export_expire_bootstrap(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = series("2024-01-30 00:00", 4) + series("2024-02-01 00:00", 4) + series("2024-02-20 00:00", 4)
    s.append_recent(bars_df(spark, rows), "usdt_perp")
    info = s.export_period("usdt_perp", as_of=dt.datetime(2024, 2, 25), retention_days=7)
    assert info["exported"] and str(info["period_start"].date()) == "2024-01-01"
    assert s.scan("archive", "usdt_perp").count() == 4
    # rows before 2024-01-31 expired; the February partition is untouched
    left = sorted(r["open_time"] for r in s.scan("recent", "usdt_perp").collect())
    assert left[0] == dt.datetime(2024, 2, 1) and len(left) == 8
    again = s.export_period("usdt_perp", as_of=dt.datetime(2024, 2, 25), retention_days=7)
    assert not again["exported"]

    b = BarStore(spark, tmp_store_root + "-b", base_minutes=15)
    b.write_archive(bars_df(spark, rows), "usdt_perp")
    wm = b.bootstrap_recent("usdt_perp", as_of=dt.datetime(2024, 3, 5), days=30)
    assert wm == dt.datetime(2024, 2, 20, 1, 0)
    assert b.latest_period("archive", "usdt_perp") == "2024-01"      # newest period moved out
    assert b.archive_watermark("usdt_perp") == dt.datetime(2024, 1, 30, 0, 45)
    assert b.scan("recent", "usdt_perp").count() == 8


def test_table_metadata(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    s.write_archive(bars_df(spark, series("2024-01-01 00:00", 3)), "usdt_perp")
    counts = {(r["table"], r["market"]): r["rows"] for r in s.describe_tables().collect()}
    assert counts == {("archive", "usdt_perp"): 3, ("state", None): 1}
    cols = {r["column"]: r["type"] for r in s.table_schema("archive").collect()}
    assert cols["open_time"] == "timestamp_ntz" and cols["trade_num"] == "int"
    with pytest.raises(ValueError):
        s.table_schema("nope")


def test_export_defaults_to_recent_watermark(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15, as_of=dt.datetime(2024, 2, 26))
    rows = series("2024-01-30 00:00", 4) + series("2024-02-20 00:00", 4)
    s.commit_batch(bars_df(spark, rows), "usdt_perp", dt.datetime(2024, 2, 20, 1, 0))
    info = s.export_period("usdt_perp", retention_days=7)     # 2024-02-20 01:00 - 7 days -> January closed
    assert info["exported"] and str(info["period_start"].date()) == "2024-01-01"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_files_of_a_period_follow_its_bytes(spark, tmp_store_root, monkeypatch):
    """A period beyond eight files is cut along its time too, so a hot symbol has several files."""
    from candlewick.plans import store as st
    assert st.layout(0) == st.layout(1) == (1, 1) and st.layout(st.SMALL_BYTES * 5) == (5, 1) == st.layout(st.SMALL_BYTES * 6 - 1)
    assert st.layout(st.FILE_BYTES) == st.layout(st.FILE_BYTES * 8) == (8, 1)
    assert st.layout(st.FILE_BYTES * 80) == (8, 10) and st.layout(10 ** 14)[0] == 8
    rows = series("2024-01-01 00:00", 96 * 30) + [r for k in range(20) for r in series("2024-01-05 00:00", 20, symbol=f"S{k}")]
    monkeypatch.setattr(st, "FILE_BYTES", 4000)
    s, merging = BarStore(spark, tmp_store_root, base_minutes=15), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")                     # else Spark puts such small shares into one task
    try:
        s.write_archive(bars_df(spark, rows), "usdt_perp")
        s.write_archive(bars_df(spark, [bar("2024-01-03 00:00", "LATE")]), "usdt_perp")
    finally:
        spark.conf.unset(merging)
    assert s.scan("archive", "usdt_perp").count() == len(rows) + 1
    folder = s._folder("archive", "usdt_perp")
    held = spark.read.parquet(folder).filter("symbol = 'AAAUSDT'")
    from pyspark.sql import functions as F
    assert held.select(F.input_file_name()).distinct().count() > 1


def test_activity_is_merged_from_period_summaries(spark, tmp_store_root):
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    dead = [bar(r[0], "DEAD", v=0.0) for r in series("2024-01-05 00:00", 3)]
    s.write_archive(bars_df(spark, series("2024-01-31 23:30", 4, v=2.0) + dead), "usdt_perp")
    s.write_archive(bars_df(spark, series("2024-03-01 00:00", 2)), "usdt_perp")
    got = {r.symbol: tuple(r)[1:] for r in s.activity("usdt_perp").collect()}
    assert got == {"AAAUSDT": (dt.datetime(2024, 1, 31, 23, 30), dt.datetime(2024, 3, 1, 0, 15), 10.0), "DEAD": (None, None, 0.0)}
    assert "/archive/" not in "".join(s.activity("usdt_perp").inputFiles())            # no bar is read
    s.bootstrap_recent("usdt_perp", as_of=dt.datetime(2024, 3, 5), days=30)           # March leaves the archive
    assert {r.symbol: r.total_volume for r in s.activity("usdt_perp").collect()} == {"AAAUSDT": 8.0, "DEAD": 0.0}
    assert BarStore(spark, tmp_store_root + "-none", base_minutes=15).activity("usdt_perp").count() == 0


def _land(root, kind, symbol, date, rows, good=True):
    import hashlib
    import os
    import zipfile
    folder = os.path.join(root, kind, symbol)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{symbol}-15m-{date}.zip")
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr("x.csv", "\n".join(
            f"{int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)},{c},{c},{c},{c},1,0,{c},1,0,0,0" for t, c in rows))
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    with open(path + ".CHECKSUM", "w") as f:
        f.write(f"{digest if good else 'wrong'}  x.zip\n")


def test_second_load_opens_only_what_is_new(spark, tmp_store_root, tmp_path):
    from candlewick.plans.load import files_to_load, landed_files, load_history
    root, t = str(tmp_path / "landing"), dt.datetime(2024, 1, 1)
    step = dt.timedelta(minutes=15)
    _land(root, "monthly_klines", "AUSDT", "2024-01", [(t, 1.0), (t + step, 2.0)])
    _land(root, "monthly_klines", "AUSDT", "2024-02", [(dt.datetime(2024, 2, 1), 3.0)])
    _land(root, "daily_klines", "BUSDT", "2024-01-01", [(t, 5.0)], good=False)
    s = BarStore(spark, tmp_store_root, base_minutes=15)

    def todo():
        return sorted(p.rsplit("/", 1)[1] for p in files_to_load(s, "usdt_perp", landed_files(spark, root)))

    def closes():
        return sorted((r.symbol, r.open_time, r.close) for r in s.scan("archive", "usdt_perp").collect())

    assert len(todo()) == 3
    load_history(spark, root, s, "usdt_perp")
    assert [c for *_, c in closes()] == [1.0, 2.0, 3.0] and todo() == []
    assert load_history(spark, root, s, "usdt_perp").count() == 0
    # a daily file opens its symbol's month again, in which daily bars win; February stays shut
    _land(root, "daily_klines", "AUSDT", "2024-01-01", [(t, 9.0)])
    assert todo() == ["AUSDT-15m-2024-01-01.zip", "AUSDT-15m-2024-01.zip"]
    load_history(spark, root, s, "usdt_perp")
    assert [c for *_, c in closes()] == [9.0, 2.0, 3.0]
    # a mended checksum is a change, and so is a monthly file that comes again: the daily bar still wins
    _land(root, "daily_klines", "BUSDT", "2024-01-01", [(t, 5.0)])
    _land(root, "monthly_klines", "AUSDT", "2024-01", [(t, 7.0), (t + step, 8.0), (t + 2 * step, 8.5)])
    assert len(todo()) == 3
    load_history(spark, root, s, "usdt_perp")
    assert closes()[0][2] == 9.0 and [c for *_, c in closes()] == [9.0, 8.0, 8.5, 3.0, 5.0]


def test_suspensions_meet_bars_of_their_day_only(spark):
    from pyspark.sql import functions as F
    from candlewick.operators.quality import suspended_bars
    rows = series("2024-01-01 00:00", 96 * 3) + series("2024-01-01 00:00", 5, symbol="B")
    start = dt.datetime(2024, 1, 1)
    many = [("AAAUSDT", start + dt.timedelta(minutes=k), start + dt.timedelta(minutes=k, seconds=1)) for k in range(0, 4000, 3)]
    long = [("B", dt.datetime(1990, 1, 1), dt.datetime(2090, 1, 1)), ("AAAUSDT", start, start - dt.timedelta(1)), (None, start, start)]
    windows = spark.createDataFrame(many + long, "symbol string, start timestamp_ntz, end timestamp_ntz")
    got = suspended_bars(bars_df(spark, rows), windows)
    want = sorted(r[0] for r in rows if r[1] != "B" and not any(a <= r[0] <= b for _, a, b in many))
    assert sorted(r.open_time for r in got.select(F.col("open_time")).collect()) == want
    assert "_wd" in _plan(got) and suspended_bars(bars_df(spark, rows), windows.limit(0)).count() == len(rows)
    assert suspended_bars(bars_df(spark, []), windows).count() == 0


def test_expiry_starts_over_when_bars_come_meanwhile(spark, tmp_store_root, monkeypatch):
    from candlewick.plans import store as st
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = series("2024-01-10 00:00", 8)
    s.append_recent(bars_df(spark, rows), "usdt_perp")
    s.write_archive(bars_df(spark, rows), "usdt_perp")
    real, calls = st.materialize, []

    def meanwhile(df, name="x"):
        out = real(df, name)
        if name == "keep" and not calls:
            calls.append(1)
            s.append_recent(bars_df(spark, series("2024-01-20 00:00", 3)), "usdt_perp")
        return out

    monkeypatch.setattr(st, "materialize", meanwhile)
    s.expire_recent("usdt_perp", dt.datetime(2024, 2, 1))
    assert s.scan("recent", "usdt_perp").count() == 3 and calls          # not archived: they stay
    assert s.scan("archive", "usdt_perp").count() == 8


def test_writes_merge_in_one_pass_without_staged_copies(spark, tmp_store_root, monkeypatch):
    """Bars go straight to the tier that they are for, archive, export and recent alike."""
    from pyspark.sql.readwriter import DataFrameWriter
    real, paths = DataFrameWriter.parquet, []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (paths.append(path), real(self, path, *a, **k))[1])
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = series("2024-01-30 23:00", 8)
    s.append_recent(bars_df(spark, rows + [bar("2024-01-30 23:00", o=0.5)]), "usdt_perp")      # two copies of a key
    s.append_recent(bars_df(spark, [bar("2024-01-30 23:15", o=9.0), bar("2024-02-01 00:00", "B")]), "usdt_perp")
    assert s.scan("recent", "usdt_perp").count() == 9
    assert s.export_period("usdt_perp", as_of=dt.datetime(2024, 2, 20), retention_days=7)["exported"]
    s.write_archive(bars_df(spark, [bar("2024-01-30 23:15", o=7.0)]), "usdt_perp")
    assert {r.open_time.minute: r.open for r in s.scan("archive", "usdt_perp").filter("hour(open_time) = 23").collect()}[15] == 7.0
    assert s.scan("archive", "usdt_perp").count() == 8
    others = [p for p in paths if not p.startswith(tmp_store_root)]
    assert all("/keep-" in p or "/lacking-" in p for p in others), others                  # expiry's alone


def test_landed_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Files of any depth with their sidecars, hidden ones left out; the driver reads no folder, so the plan
    holds no file scan, and a digest counts by the first word of the sidecar."""
    from candlewick.sources.bars import listed_files, read_zip_csv, verify_checksums
    root, t = str(tmp_path / "landing"), dt.datetime(2024, 1, 1)
    for k in range(40):
        _land(root, "monthly_klines", f"S{k}USDT", "2024-01", [(t, float(k))], good=k % 2 == 0)
    _land(root, "daily_klines", "_HIDDEN", "2024-01-01", [(t, 1.0)])
    files = listed_files(spark, root)
    assert "FileScan" not in files._jdf.queryExecution().toString()
    assert {(r.path.endswith(".zip"), r.sidecar) for r in files.collect()} == {(True, True), (False, False)}
    assert files.count() == 80
    assert verify_checksums(spark, root).filter("verified").count() == 20
    assert sorted(r.close for r in read_zip_csv(spark, root, verified_only=True).collect()) == [float(k) for k in range(0, 40, 2)]
    assert read_zip_csv(spark, f"{root}/monthly_klines").count() == 40           # one level fewer
    assert read_zip_csv(spark, f"{root}/monthly_klines/S3USDT").count() == 1     # files in the root itself


def _shuffle_files(spark):
    import glob
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in glob.glob(f"{folder.getPath()}/**/shuffle_*.data", recursive=True)}


def test_shuffles_of_writes_go_with_the_write(spark, tmp_store_root):
    """Files of a write's shuffles do not wait until the driver collects its garbage."""
    import time
    s, before = BarStore(spark, tmp_store_root, base_minutes=15), _shuffle_files(spark)
    rows = series("2024-01-10 00:00", 300) + series("2024-01-10 00:00", 300, symbol="B")
    s.append_recent(bars_df(spark, rows), "usdt_perp")
    s.append_recent(bars_df(spark, rows + series("2024-01-14 00:00", 3)), "usdt_perp")
    s.write_archive(bars_df(spark, rows), "usdt_perp")
    s.expire_recent("usdt_perp", dt.datetime(2024, 1, 12))
    for _ in range(50):                                                  # Spark removes them in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"              # the caller's settings stay


def test_files_of_a_period_are_of_even_size(spark, tmp_store_root, monkeypatch):
    """F8: one task a file, and stretches of the time that the bars have, not of the whole period."""
    from candlewick.plans import store as st
    monkeypatch.setattr(st, "FILE_BYTES", 96 * 300)
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = [r for k in range(40) for r in series("2024-01-20 00:00", 192, symbol=f"S{k}")]      # two days of January
    s.append_recent(bars_df(spark, rows), "usdt_perp")
    from pyspark.sql import functions as F
    sizes = [r["count"] for r in spark.read.parquet(s._folder("recent", "usdt_perp")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 3 * sum(sizes) / len(sizes), sizes


def test_a_replayed_append_writes_nothing(spark, tmp_store_root):
    """keys are counted first; a batch that is stored already is not shuffled or written."""
    from pyspark.sql.readwriter import DataFrameWriter
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    odd = [bar("2024-01-10 00:07:31.5", o=3.0), bar("1969-12-31 23:59:59.9", o=4.0)]          # off the grid
    rows = series("2024-01-10 00:00", 200) + odd
    s.append_recent(bars_df(spark, rows + rows[:5]), "usdt_perp")
    folder = s._folder("recent", "usdt_perp")
    files = set(spark.read.parquet(folder).inputFiles())
    real, paths = DataFrameWriter.parquet, []
    DataFrameWriter.parquet = lambda self, path, *a, **k: (paths.append(path), real(self, path, *a, **k))[1]
    try:
        s.append_recent(bars_df(spark, rows), "usdt_perp")
    finally:
        DataFrameWriter.parquet = real
    assert set(spark.read.parquet(folder).inputFiles()) == files and not [p for p in paths if p.startswith(folder)]
    assert s.scan("recent", "usdt_perp").count() == 202


def test_expiry_compares_keys_exactly(spark, tmp_store_root):
    """keys meet as cells of 63 slots; rows that the archive lacks stay, off the grid or in a cell half archived."""
    s = BarStore(spark, tmp_store_root, base_minutes=15)
    rows = series("2023-12-30 00:00", 400) + [bar("2024-01-01 00:07:31.5"), bar("2024-01-01 00:07:31", "B")]
    s.append_recent(bars_df(spark, rows), "usdt_perp")
    gone = {r[0] for r in rows[:390:3]}
    s.write_archive(bars_df(spark, [r for r in rows[:400] if r[0] in gone] + [bar("2024-01-01 00:00", "B"), rows[401]]), "usdt_perp")
    s.expire_recent("usdt_perp", dt.datetime(2024, 1, 4))
    kept = {(r.symbol, r.open_time) for r in s.scan("recent", "usdt_perp").collect()}
    want = {(r[1], r[0]) for r in rows[:401] if r[0] >= dt.datetime(2024, 1, 3) or r[0] not in gone}
    assert kept == want
    import os
    assert not os.listdir(f"{tmp_store_root}/_expiring")


def test_pending_bars_meet_new_ones_by_cells(spark, tmp_store_root, monkeypatch):
    """waiting bars are compared with new ones row by row only if they share a key, and then the new ones win."""
    from candlewick.plans import load
    s, joined, real = BarStore(spark, tmp_store_root, base_minutes=15), [], load.without_keys
    monkeypatch.setattr(load, "without_keys", lambda *a: (joined.append(1), real(*a))[1])
    idle = [bar(r[0], v=0.0) for r in series("2024-01-01 00:00", 3)]
    load.archive_clipped(s, bars_df(spark, idle + series("2024-01-01 00:45", 1)), "usdt_perp")
    load.archive_clipped(s, bars_df(spark, [bar("2024-01-01 02:00")]), "usdt_perp")
    assert not joined and s.scan("archive", "usdt_perp").count() == 2
    load.archive_clipped(s, bars_df(spark, [bar("2024-01-01 00:15", o=5.0)]), "usdt_perp")
    assert joined and {r.open_time.minute: r.open for r in s.scan("archive", "usdt_perp").filter("hour(open_time) = 0").collect()} == {15: 5.0, 30: 1.0, 45: 1.0}
