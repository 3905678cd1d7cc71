"""Benchmark: build a bar store from the driver tables, then time the
read-path queries over it, next to DuckDB running the same SQL on the same
Parquet files.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"value" is the sum of the per-query medians (seconds, warm runs); the store
build (events -> dense bars -> partitioned archive + recent tier) is timed
separately as "build_store".
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from candlewick import fixtures as fx  # noqa: E402
from candlewick.operators import quality as Q  # noqa: E402
from candlewick.plans.store import BarStore  # noqa: E402
from candlewick.session import build_session, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BEGIN, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"


def timed(fn, runs=RUNS):
    fn()                                   # warm-up
    out = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        out.append(time.perf_counter() - t0)
    return statistics.median(out)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(f"local[{CPUS}]", CPUS * 2,
                          extra={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "64m"})
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-ckpt-"))
    root = scratch_path(spark, "bench-store")     # shared folder from spark.checkpoint.dir

    # ---- store build: events -> bars -> archive (<= threshold) + recent tier
    from candlewick.plans.joins import materialize
    run(fx.dense_bars(spark, SF_DIR))          # JVM / codegen warm-up, not timed
    steps = {}
    t0 = time.perf_counter()
    k0 = materialize(fx.event_bars(spark, SF_DIR))
    steps["event_bars"] = time.perf_counter() - t0
    k1 = materialize(fx.dense_bars(spark, SF_DIR))
    steps["dense_bars"] = time.perf_counter() - t0 - sum(steps.values())
    archive, recent = fx.tiers(spark, SF_DIR, dense=k1, events=k0)
    store = BarStore(spark, root, base_minutes=fx.BASE_MINUTES)
    store.write_archive(archive.drop("market"), fx.MARKET)
    steps["write_archive"] = time.perf_counter() - t0 - sum(steps.values())
    store.append_recent(recent.drop("market"), fx.MARKET)
    steps["append_recent"] = time.perf_counter() - t0 - sum(steps.values())
    build = time.perf_counter() - t0

    arch = lambda: store.scan("archive", fx.MARKET)
    queries = {
        "resample_60m_off15_archive": lambda: run(store.get_market(fx.MARKET, 60, 15, BEGIN, "2024-01-19 23:00:00")),
        "resample_60m_off15_recent": lambda: run(store.get_market(fx.MARKET, 60, 15, "2024-01-20 01:00:00", END)),
        "hybrid_60m_off15": lambda: run(store.get_market(fx.MARKET, 60, 15, BEGIN, END)),
        "get_symbol_60m": lambda: run(store.get_symbol(fx.MARKET, "U3USDT", 60, 0, BEGIN, END)),
        "clip_to_trading_range": lambda: run(Q.clip_to_trading_range(arch())),
        "find_gaps": lambda: run(Q.find_gaps(arch(), fx.BASE_MINUTES)),
        "trading_range_dead": lambda: run(Q.symbol_activity(arch())),
        "missing_days": lambda: run(Q.missing_days(arch())),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    results = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        results[name] = round(timed(fn), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)

    rows = {
        "archive_rows": store.tier("archive", fx.MARKET).count(),
        "recent_rows": store.tier("recent", fx.MARKET).count(),
    }
    duck = duckdb_times(root) if os.environ.get("BENCH_DUCKDB", "1") == "1" else {}
    print(json.dumps({
        "metric": "read_path_total_sec",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "build_store": round(build, 3),
        "build_steps": {k: round(v, 3) for k, v in steps.items()},
        "sf": _sf_value(SF_DIR),
        "cpus": CPUS,
        "runs": RUNS,
        **rows,
        "duckdb_queries": duck,
        "duckdb_total_sec": round(sum(duck.values()), 3) if duck else None,
    }))
    spark.stop()


def _sf_value(sf_dir: str):
    text = os.path.basename(sf_dir).replace("sf", "")
    try:
        return float(text)
    except ValueError:
        return text


def duckdb_times(root: str) -> dict:
    """The same read path in DuckDB (one process) on the same stored Parquet,
    each result fully materialized as an Arrow table."""
    try:
        import duckdb
    except ImportError:
        return {}
    from candlewick.registry import resample_sql
    con = duckdb.connect()
    for t in ("archive", "recent"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}/**/*.parquet', hive_partitioning=true)")
    thr = "(SELECT max(open_time) FROM archive)"
    ts = lambda x: f"TIMESTAMP '{x}'"

    def hybrid(interval, offset, more=""):
        return f"""
      WITH a AS ({resample_sql("archive", interval, offset, f"open_time >= {ts(BEGIN)} - INTERVAL 1 HOUR AND open_time < least({ts(END)}, {thr}) + INTERVAL 1 HOUR{more}")}),
           r AS ({resample_sql("recent", interval, offset, f"open_time >= greatest({ts(BEGIN)}, {thr}) - INTERVAL 1 HOUR AND open_time <= {ts(END)} + INTERVAL 1 HOUR{more}")}),
           u AS (SELECT *, 1 AS pr FROM a UNION ALL SELECT *, 2 FROM r),
           k AS (SELECT *, row_number() OVER (PARTITION BY symbol, resample_time ORDER BY pr DESC) rn FROM u)
      SELECT * EXCLUDE (pr, rn) FROM k WHERE rn = 1 ORDER BY resample_time, symbol"""

    sqls = {
        "resample_60m_off15_archive": resample_sql("archive", 60, 15,
            f"open_time BETWEEN {ts(BEGIN)} AND TIMESTAMP '2024-01-19 23:00:00'") + " ORDER BY resample_time, symbol",
        "resample_60m_off15_recent": resample_sql("recent", 60, 15,
            f"open_time BETWEEN TIMESTAMP '2024-01-20 01:00:00' AND {ts(END)}") + " ORDER BY resample_time, symbol",
        "hybrid_60m_off15": hybrid(60, 15),
        "get_symbol_60m": hybrid(60, 0, " AND symbol = 'U3USDT'"),
        "clip_to_trading_range": """WITH r AS (SELECT symbol, min(open_time) f, max(open_time) l FROM archive WHERE volume > 0 GROUP BY 1)
            SELECT a.* FROM archive a JOIN r USING (symbol) WHERE a.open_time BETWEEN r.f AND r.l""",
        "find_gaps": """SELECT * FROM (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) p, open_time
            FROM archive) WHERE open_time - p > INTERVAL '15 minutes'""",
        "trading_range_dead": """SELECT symbol, min(open_time) FILTER (volume > 0) f, max(open_time) FILTER (volume > 0) l,
            sum(volume) v FROM archive GROUP BY 1""",
        "missing_days": """WITH d AS (SELECT DISTINCT symbol, CAST(open_time AS DATE) AS day FROM archive),
            s AS (SELECT symbol, min(day) d0, max(day) d1 FROM d GROUP BY 1),
            e AS (SELECT symbol, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
            SELECT * FROM e ANTI JOIN d USING (symbol, day)""",
    }
    out = {}
    for name, sql in sqls.items():
        def go(sql=sql):
            rel = con.sql(sql)
            (rel.to_arrow_table if hasattr(rel, "to_arrow_table") else rel.arrow)()
        try:
            out[name] = round(timed(go), 3)
        except Exception as e:  # noqa: BLE001 - report, keep the Spark numbers
            print(f"# duckdb {name} failed: {e}", file=sys.stderr)
    return out


if __name__ == "__main__":
    main()
