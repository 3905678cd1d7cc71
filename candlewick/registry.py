"""Registered queries (Spark callables) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, reads the driver tables through the
fixtures and returns a DataFrame. The oracle is the same computation as
DuckDB SQL over the same Parquet files; column names match one to one.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick import fixtures as fx
from candlewick.plans.store import BarStore, one_bar_per_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Whole fixture span: every bar lies inside.
ALL_BEGIN = "2024-01-01 00:00:00"
ALL_END = "2024-01-31 23:59:59"


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; bar times are naive UTC, so the session
    time zone is pinned to UTC before the plan is built."""
    def deco(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def dense_store(spark: SparkSession, sf_dir: str) -> BarStore:
    """Store whose recent tier is the whole dense bar table (archive empty)."""
    k1 = fx.dense_bars(spark, sf_dir).withColumn("market", F.lit(fx.MARKET))
    return BarStore(spark, frames={"recent": k1}, base_minutes=fx.BASE_MINUTES)


def tier_store(spark: SparkSession, sf_dir: str) -> BarStore:
    archive, recent = fx.tiers(spark, sf_dir)
    return BarStore(spark, frames={"archive": archive, "recent": recent}, base_minutes=fx.BASE_MINUTES)


# ---------------------------------------------------------------------- SQL helpers

RESAMPLE_VALUES_SQL = """
  arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
  sum(volume) AS volume, sum(quote_volume) AS quote_volume, CAST(sum(trade_num) AS INTEGER) AS trade_num,
  sum(taker_buy_base_asset_volume) AS taker_buy_base_asset_volume,
  sum(taker_buy_quote_asset_volume) AS taker_buy_quote_asset_volume,
  arg_min_null(avg_price, open_time) AS avg_price"""


def bucket_sql(interval: int, offset: int, col: str = "open_time") -> str:
    """Start of the bucket: buckets of ``interval`` minutes that start ``offset`` minutes past the hour."""
    step = f"INTERVAL '{interval} minutes'"
    hour = f"date_trunc('hour', {col} - INTERVAL '{offset} minutes') + INTERVAL '{offset} minutes'"
    return f"time_bucket({step}, {col}, {hour})"


def resample_sql(src: str, interval: int, offset: int, where: str = "TRUE", base: int = 15) -> str:
    return f"""
SELECT {bucket_sql(interval, offset)} AS resample_time, {RESAMPLE_VALUES_SQL}, symbol
FROM {src} WHERE {where}
GROUP BY symbol, resample_time
HAVING count(open_time) = {interval // base}"""


def ts(t) -> str:
    t = _dt.datetime.fromisoformat(t) if isinstance(t, str) else t
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


# ---------------------------------------------------------------------- A1/A2/A3/A4, Q1, W3, X1

for _iv, _off in ((60, 15), (60, 0), (30, 15), (15, 0), (60, 45)):
    def _make(iv=_iv, off=_off):
        def q(spark, sf_dir):
            return dense_store(spark, sf_dir).get_market(fx.MARKET, iv, off, ALL_BEGIN, ALL_END)
        return q
    register(
        f"get_market_{_iv}m_off{_off}",
        fx.with_sql(fx.K1_SQL, resample_sql("k1", _iv, _off, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ALL_END)}")
                    + "\nORDER BY resample_time, symbol"),
    )(_make())


# ---------------------------------------------------------------------- Q2 get_symbol, F1/F3, edge cases

SYMBOL = "U3USDT"


@register("get_symbol_60m_off0", fx.with_sql(fx.K1_SQL, resample_sql(
    "k1", 60, 0, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ALL_END)} AND symbol = '{SYMBOL}'")
    + "\nORDER BY resample_time, symbol"))
def q_get_symbol(spark, sf_dir):
    return dense_store(spark, sf_dir).get_symbol(fx.MARKET, SYMBOL, 60, 0, ALL_BEGIN, ALL_END)


@register("get_market_inverted_range", fx.with_sql(fx.K1_SQL, resample_sql(
    "k1", 60, 15, f"open_time BETWEEN {ts(ALL_END)} AND {ts(ALL_BEGIN)}")))
def q_inverted(spark, sf_dir):
    return dense_store(spark, sf_dir).get_market(fx.MARKET, 60, 15, ALL_END, ALL_BEGIN)


# ---------------------------------------------------------------------- Q4/Q5 tiers and the hybrid merge

def hybrid_sql(interval: int, offset: int, begin: str, end: str, clip: bool = False) -> str:
    r = "INTERVAL '1 hour'"
    thr = "(SELECT max(open_time) FROM archive)"
    a = resample_sql("archive", interval, offset,
                     f"open_time >= {ts(begin)} - {r} AND open_time < least({ts(end)}, {thr}) + {r}")
    b = resample_sql("recent", interval, offset,
                     f"open_time >= greatest({ts(begin)}, {thr}) - {r} AND open_time <= {ts(end)} + {r}")
    cols = "resample_time, open, high, low, close, volume, quote_volume, trade_num, " \
           "taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price, symbol"
    where = f" AND resample_time BETWEEN {ts(begin)} AND {ts(end)}" if clip else ""
    return fx.with_sql(fx.TIERS_SQL, f""",
a_res AS ({a}),
r_res AS ({b}),
u AS (SELECT *, 1 AS priority FROM a_res UNION ALL SELECT *, 2 AS priority FROM r_res),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, resample_time ORDER BY priority DESC) AS rn FROM u)
SELECT {cols} FROM ranked WHERE rn = 1{where}
ORDER BY resample_time, symbol""")


# straddling window: begin and end both fall inside the data, so the redundancy
# hours beyond each end show up unless clipped
STRADDLE_BEGIN = "2024-01-18 10:00:00"
STRADDLE_END = "2024-01-21 13:00:00"

for _name, _iv, _off, _b, _e, _clip in (
        ("hybrid_60m_off15", 60, 15, ALL_BEGIN, ALL_END, False),
        ("hybrid_30m_off0", 30, 0, ALL_BEGIN, ALL_END, False),
        ("hybrid_straddle_60m_off15", 60, 15, STRADDLE_BEGIN, STRADDLE_END, False),
        ("hybrid_straddle_60m_off15_clip", 60, 15, STRADDLE_BEGIN, STRADDLE_END, True)):
    def _make_h(iv=_iv, off=_off, b=_b, e=_e, clip=_clip):
        def q(spark, sf_dir):
            return tier_store(spark, sf_dir).get_market(fx.MARKET, iv, off, b, e, clip=clip)
        return q
    register(_name, hybrid_sql(_iv, _off, _b, _e, _clip))(_make_h())

ARCHIVE_END = "2024-01-19 23:00:00"
RECENT_BEGIN = "2024-01-20 01:00:00"


@register("get_market_archive_tier", fx.with_sql(fx.TIERS_SQL, resample_sql(
    "archive", 60, 15, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ARCHIVE_END)}")))
def q_archive_tier(spark, sf_dir):
    return tier_store(spark, sf_dir).get_market(fx.MARKET, 60, 15, ALL_BEGIN, ARCHIVE_END)


@register("get_market_recent_tier", fx.with_sql(fx.TIERS_SQL, resample_sql(
    "recent", 60, 15, f"open_time BETWEEN {ts(RECENT_BEGIN)} AND {ts(ALL_END)}")))
def q_recent_tier(spark, sf_dir):
    return tier_store(spark, sf_dir).get_market(fx.MARKET, 60, 15, RECENT_BEGIN, ALL_END)


# ---------------------------------------------------------------------- A2 completeness audit

@register("bucket_audit_60m_off15", fx.with_sql(fx.K1_SQL, f""",
b AS (SELECT symbol, {bucket_sql(60, 15)} AS resample_time, count(open_time) AS bar_count FROM k1 GROUP BY ALL)
SELECT symbol, count(*) FILTER (WHERE bar_count = 4) AS complete_buckets,
       count(*) FILTER (WHERE bar_count <> 4) AS partial_buckets, CAST(sum(bar_count) AS BIGINT) AS bars
FROM b GROUP BY symbol"""))
def q_bucket_audit(spark, sf_dir):
    from candlewick.operators.resample import bucket_audit
    return bucket_audit(fx.dense_bars(spark, sf_dir), 60, 15, fx.BASE_MINUTES)


# ---------------------------------------------------------------------- quality: W1, W6, A7, A8, J1, F8, A10, T3-T5, F11

from candlewick.operators import quality as Q  # noqa: E402


@register("find_gaps", fx.with_sql(fx.K1_SQL, """,
l AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev_open_time, open_time FROM k1)
SELECT symbol, prev_open_time, open_time, CAST(date_diff('minute', prev_open_time, open_time) AS BIGINT) AS gap_minutes
FROM l WHERE prev_open_time IS NOT NULL AND open_time - prev_open_time > INTERVAL '15 minutes'"""))
def q_find_gaps(spark, sf_dir):
    return Q.find_gaps(fx.dense_bars(spark, sf_dir), fx.BASE_MINUTES)


@register("missing_days", fx.with_sql(fx.K0_SQL, """,
d AS (SELECT DISTINCT symbol, CAST(open_time AS DATE) AS day FROM k0),
s AS (SELECT symbol, min(day) AS d0, max(day) AS d1 FROM d GROUP BY symbol),
e AS (SELECT symbol, CAST(unnest(generate_series(d0, d1, INTERVAL '1 day')) AS DATE) AS day FROM s)
SELECT symbol, day FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.symbol = e.symbol AND d.day = e.day)"""))
def q_missing_days(spark, sf_dir):
    return Q.missing_days(fx.event_bars(spark, sf_dir))


@register("trading_range", fx.with_sql(fx.K1_SQL, """
SELECT symbol, min(open_time) AS first_candle, max(open_time) AS last_candle FROM k1 WHERE volume > 0 GROUP BY symbol"""))
def q_trading_range(spark, sf_dir):
    return Q.trading_range(fx.dense_bars(spark, sf_dir))


@register("dead_symbols", fx.with_sql(fx.K1_SQL, """
SELECT symbol, sum(volume) AS total_volume FROM k1 GROUP BY symbol HAVING sum(volume) = 0"""))
def q_dead_symbols(spark, sf_dir):
    return Q.dead_symbols(fx.dense_bars(spark, sf_dir))


@register("clip_to_trading_range", fx.with_sql(fx.K1_SQL, """,
r AS (SELECT symbol, min(open_time) AS f, max(open_time) AS l FROM k1 WHERE volume > 0 GROUP BY symbol)
SELECT k1.* FROM k1 JOIN r USING (symbol) WHERE k1.open_time BETWEEN r.f AND r.l"""))
def q_clip(spark, sf_dir):
    return Q.clip_to_trading_range(fx.dense_bars(spark, sf_dir))


CLOSED_AT = _dt.datetime(2024, 1, 30, 12, 7, 30)


@register("closed_bars", fx.with_sql(fx.K1_SQL, """
SELECT * FROM k1 WHERE open_time < TIMESTAMP '2024-01-30 12:00:00'"""))
def q_closed_bars(spark, sf_dir):
    return Q.closed_bars(fx.dense_bars(spark, sf_dir), CLOSED_AT, fx.BASE_MINUTES)


@register("fetch_summary", fx.with_sql(fx.K1_SQL, """
SELECT symbol, count(*) AS num, min(open_time) AS begin_time FROM k1 GROUP BY symbol"""))
def q_fetch_summary(spark, sf_dir):
    return Q.fetch_summary(fx.dense_bars(spark, sf_dir))


# a page of 40 bars ending 12:00 spans 02:00-11:45: full unless a symbol was idle through
# a maintenance hour inside it, so the page size itself decides who needs another page
PAGE_END = _dt.datetime(2024, 1, 25, 12, 0, 0)
PAGE_START = _dt.datetime(2024, 1, 10, 0, 0, 0)
PAGE_LIMIT = 40


@register("next_page", fx.with_sql(fx.K1_SQL, f""",
p AS (SELECT * FROM k1 WHERE open_time >= {ts(PAGE_END)} - INTERVAL '{PAGE_LIMIT * 15} minutes' AND open_time < {ts(PAGE_END)}),
s AS (SELECT symbol, count(*) AS num, min(open_time) AS begin_time FROM p GROUP BY symbol)
SELECT symbol, num, begin_time, begin_time - INTERVAL '15 minutes' AS next_end_time
FROM s WHERE begin_time > {ts(PAGE_START)} AND num = {PAGE_LIMIT}"""))
def q_next_page(spark, sf_dir):
    page = Q.rest_page(fx.dense_bars(spark, sf_dir), PAGE_END, PAGE_LIMIT, fx.BASE_MINUTES)
    return Q.next_page(Q.fetch_summary(page), PAGE_START, PAGE_LIMIT, fx.BASE_MINUTES)


@register("backfill_plan", fx.with_sql(fx.K0_SQL, """,
w AS (SELECT symbol, max(open_time) + INTERVAL '15 minutes' AS watermark FROM k0 GROUP BY symbol),
n AS (SELECT max(open_time) + INTERVAL '15 minutes' AS now FROM k0)
SELECT symbol, watermark, CAST(date_diff('minute', watermark, now) AS BIGINT) AS gap_minutes,
       CASE WHEN date_diff('minute', watermark, now) <= 99 * 15 THEN 99
            WHEN date_diff('minute', watermark, now) <= 499 * 15 THEN 499 END AS page_size
FROM w, n"""))
def q_backfill_plan(spark, sf_dir):
    k0 = fx.event_bars(spark, sf_dir)
    step = _dt.timedelta(minutes=fx.BASE_MINUTES)
    now = k0.agg(F.max("open_time")).first()[0] + step
    wm = k0.groupBy("symbol").agg((F.max("open_time") + F.expr("INTERVAL 15 MINUTES")).alias("watermark"))
    return Q.backfill_plan(wm, now, fx.BASE_MINUTES)


@register("remediation_needed", fx.with_sql(fx.K0_SQL, """,
b AS (SELECT symbol, open_time, open_time + INTERVAL '15 minutes' AS batch_time FROM k0),
l AS (SELECT *, lag(batch_time) OVER (PARTITION BY symbol ORDER BY open_time) AS watermark FROM b)
SELECT symbol, open_time, batch_time, watermark,
       coalesce(date_diff('minute', watermark, batch_time) > 15, TRUE) AS needs_backfill FROM l"""))
def q_remediation(spark, sf_dir):
    return Q.remediation_needed(Q.bar_batches(fx.event_bars(spark, sf_dir), fx.BASE_MINUTES), fx.BASE_MINUTES)


@register("suspended_bars_idle_day", fx.with_sql(fx.K1_SQL, """,
t AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM k1 WHERE volume > 0),
w AS (SELECT symbol, prev + INTERVAL '1 microsecond' AS ws, open_time - INTERVAL '1 microsecond' AS we
      FROM t WHERE prev IS NOT NULL AND open_time - prev > INTERVAL '1 day')
SELECT * FROM k1 WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.symbol = k1.symbol AND k1.open_time BETWEEN w.ws AND w.we)"""))
def q_suspended(spark, sf_dir):
    k1 = fx.dense_bars(spark, sf_dir)
    return Q.suspended_bars(k1, Q.idle_windows(k1, 24 * 60))


# ---------------------------------------------------------------------- instruments: S6, S7, F4-F7, J4, J5, J7, Q3

from candlewick.operators import symbols as SY  # noqa: E402
from candlewick.sources import exchange as EX  # noqa: E402

INSTRUMENT_SELECT = ("market, symbol, status, base_asset, quote_asset, price_tick, lot_size, "
                     "min_notional_value, contract_type, margin_asset, pre_market")


def instruments(spark, sf_dir, market):
    return EX.parse_instruments(fx.exchange_info_docs(spark, sf_dir, market), market)


for _m, _cte in (("usdt_perp", "perp"), ("coin_perp", "coin"), ("usdt_spot", "spot")):
    register(f"parse_instruments_{_m}", fx.with_sql(fx.PART_SQL, f"SELECT {INSTRUMENT_SELECT} FROM {_cte}"))(
        (lambda m: (lambda spark, sf_dir: instruments(spark, sf_dir, m)))(_m))


@register("parse_funding", fx.with_sql(fx.PART_SQL, """
SELECT base || quote AS symbol, TRY_CAST(CASE WHEN no_rate THEN 'n/a' ELSE '0.000' || CAST(p_size AS VARCHAR) END AS DOUBLE) AS funding_rate
FROM pf"""))
def q_funding(spark, sf_dir):
    return EX.parse_funding(fx.funding_docs(spark, sf_dir))


from candlewick.schema import SPOT_STABLE_ASSETS, STABLECOINS  # noqa: E402

_STABLE_SQL = ", ".join(f"'{s}'" for s in STABLECOINS)
_SPOT_STABLE_SQL = ", ".join(f"'{a}USDT'" for a in SPOT_STABLE_ASSETS)
_LEV_SQL = ("(symbol LIKE '%UPUSDT' OR symbol LIKE '%DOWNUSDT' OR symbol LIKE '%BULLUSDT' OR symbol LIKE '%BEARUSDT')")

for _mt, _src, _pred in (
        ("usdt_perp", "perp", "quote_asset = 'USDT' AND contract_type IN ('PERPETUAL')"),
        ("usdt_deli", "perp", "quote_asset = 'USDT' AND contract_type IN ('CURRENT_QUARTER', 'NEXT_QUARTER')"),
        ("usdc_perp", "perp", "quote_asset = 'USDC' AND contract_type IN ('PERPETUAL')"),
        ("btc_perp", "perp", "quote_asset = 'BTC' AND contract_type IN ('PERPETUAL')"),
        ("coin_perp", "coin", "contract_type IN ('PERPETUAL')"),
        ("coin_deli", "coin", "contract_type IN ('CURRENT_QUARTER', 'NEXT_QUARTER')"),
        ("usdt_spot", "spot", f"quote_asset = 'USDT' AND symbol NOT IN ({_STABLE_SQL})"),
        ("usdc_spot", "spot", f"quote_asset = 'USDC' AND symbol NOT IN ({_STABLE_SQL})"),
        ("btc_spot", "spot", f"quote_asset = 'BTC' AND symbol NOT IN ({_STABLE_SQL})")):
    _market = {"perp": "usdt_perp", "coin": "coin_perp", "spot": "usdt_spot"}[_src]
    register(f"trading_symbols_{_mt}", fx.with_sql(
        fx.PART_SQL, f"SELECT {INSTRUMENT_SELECT} FROM {_src} WHERE status = 'TRADING' AND {_pred}"))(
        (lambda mt, m: (lambda spark, sf_dir: SY.trading_instruments(instruments(spark, sf_dir, m), mt)))(_mt, _market))


@register("usdt_symbols", fx.with_sql(fx.PART_SQL, "SELECT symbol FROM spot WHERE symbol LIKE '%USDT'"))
def q_usdt_symbols(spark, sf_dir):
    return SY.usdt_symbols(instruments(spark, sf_dir, "usdt_spot").select("symbol"))


@register("spot_symbols", fx.with_sql(fx.PART_SQL, f"""
SELECT symbol FROM spot WHERE symbol = 'JUPUSDT' OR (NOT {_LEV_SQL} AND symbol NOT IN ({_SPOT_STABLE_SQL}))"""))
def q_spot_symbols(spark, sf_dir):
    return SY.spot_symbols(instruments(spark, sf_dir, "usdt_spot").select("symbol"))


@register("tradable_universe", fx.with_sql(fx.PART_SQL, f"""
SELECT DISTINCT symbol FROM spot
WHERE symbol LIKE '%USDT' AND NOT ({_LEV_SQL} AND symbol <> 'JUPUSDT') AND symbol NOT IN ({_STABLE_SQL})
ORDER BY symbol"""))
def q_tradable(spark, sf_dir):
    return SY.tradable_universe(instruments(spark, sf_dir, "usdt_spot"))


@register("trading_members_usdt_perp", fx.with_sql(fx.PART_SQL, f"""
SELECT {INSTRUMENT_SELECT} FROM perp
WHERE symbol IN (SELECT symbol FROM perp WHERE status = 'TRADING' AND quote_asset = 'USDT' AND contract_type = 'PERPETUAL')"""))
def q_members(spark, sf_dir):
    inst = instruments(spark, sf_dir, "usdt_perp")
    return SY.members(inst, SY.trading_instruments(inst, "usdt_perp"))


@register("delisted_symbols", fx.with_sql(fx.TIERS_SQL, """
SELECT DISTINCT symbol FROM archive WHERE symbol NOT IN (SELECT symbol FROM recent)"""))
def q_delisted(spark, sf_dir):
    a, r = fx.tiers(spark, sf_dir)
    return SY.delisted(a, r)


@register("onboarded_symbols", fx.with_sql(fx.TIERS_SQL, """
SELECT DISTINCT symbol FROM recent WHERE symbol NOT IN (SELECT symbol FROM archive)"""))
def q_onboarded(spark, sf_dir):
    a, r = fx.tiers(spark, sf_dir)
    return SY.onboarded(a, r)


@register("symbols_at_archive_watermark", fx.with_sql(fx.TIERS_SQL, """
SELECT DISTINCT symbol FROM archive WHERE open_time = (SELECT max(open_time) FROM archive)"""))
def q_snapshot(spark, sf_dir):
    store = tier_store(spark, sf_dir)
    wm = store.archive_watermark(fx.MARKET)
    return SY.symbols_at(store.tier("archive", fx.MARKET), wm)


@register("symbols_at_recent_watermark", fx.with_sql(fx.TIERS_SQL, """
SELECT DISTINCT symbol FROM recent WHERE open_time = (SELECT max(open_time) FROM recent)"""))
def q_snapshot_recent(spark, sf_dir):
    # the recent watermark is the exclusive bound: last bar + one interval
    store = tier_store(spark, sf_dir)
    rec = store.tier("recent", fx.MARKET)
    wm = rec.agg(F.max("open_time")).first()[0] + _dt.timedelta(minutes=fx.BASE_MINUTES)
    return SY.symbols_at(rec, wm - _dt.timedelta(minutes=fx.BASE_MINUTES))


@register("get_instruments_usdt_spot", fx.with_sql(fx.PART_SQL, f"SELECT {INSTRUMENT_SELECT} FROM spot"))
def q_get_instruments(spark, sf_dir):
    frames = {"instruments": instruments(spark, sf_dir, "usdt_spot").unionByName(
        instruments(spark, sf_dir, "usdt_perp"))}
    return BarStore(spark, frames=frames).get_instruments("usdt_spot")


# ---------------------------------------------------------------------- calendar: X5-X8, X12

from candlewick.functions import timegrid as TG  # noqa: E402
from candlewick.functions.scalars import strip_zeros  # noqa: E402


def _nb_sql(iv_min: int) -> str:
    s = iv_min * 60
    day = "CAST(CAST(ts AS DATE) AS TIMESTAMP)"
    return (f"least({day} + to_seconds(CAST((floor((hour(ts) * 3600 + minute(ts) * 60) / {s}) + 1) * {s} AS BIGINT)), "
            f"{day} + INTERVAL '1 day')")


def _months_sql(expr: str) -> str:
    return f"((year({expr}) - 2019) * 12 + month({expr}) - 1)"


def _period_sql(expr: str, p: int) -> str:
    return f"DATE '2019-01-01' + to_months(CAST(floor({_months_sql(expr)} / {p}) * {p} AS INTEGER))"


def _lcp_sql(p: int) -> str:
    m = _months_sql("ts")
    k = f"(floor({m} / {p}) - 1 - CASE WHEN {m} % {p} = 0 AND day(ts) = 1 THEN 1 ELSE 0 END)"
    start = f"CAST(DATE '2019-01-01' + to_months(CAST({k} * {p} AS INTEGER)) AS DATE)"
    return start, k


_LCP_START, _LCP_K = _lcp_sql(1)


@register("calendar_functions", f"""
SELECT event_id, ts,
       {_nb_sql(15)} AS next_15m, {_nb_sql(7)} AS next_7m, {_nb_sql(480)} AS next_8h,
       strftime({_period_sql('ts', 3)}, '%Y-%m') AS period_3m,
       CASE WHEN {_LCP_K} >= 0 THEN {_LCP_START} END AS complete_start,
       CASE WHEN {_LCP_K} >= 0 THEN CAST({_LCP_START} + INTERVAL '1 month' AS DATE) END AS complete_end,
       CAST({_period_sql("CAST(ts AS DATE) - INTERVAL '30 days'", 1)} AS DATE) AS cutoff_30d,
       ts + INTERVAL '15 minutes' AS batch_time
FROM events""")
def q_calendar(spark, sf_dir):
    ev = fx.read_table(spark, sf_dir, "events")
    lcp = TG.latest_complete_period("ts", 1)
    return ev.select(
        "event_id", "ts",
        TG.next_boundary("ts", 15).alias("next_15m"), TG.next_boundary("ts", 7).alias("next_7m"),
        TG.next_boundary("ts", 480).alias("next_8h"), TG.period_label("ts", 3).alias("period_3m"),
        lcp["period_start"].alias("complete_start"), lcp["period_end"].alias("complete_end"),
        TG.period_cutoff("ts", 30, 1).alias("cutoff_30d"), TG.batch_time("ts", 15).alias("batch_time"))


@register("instrument_sizes_normalized", fx.with_sql(fx.PART_SQL, """
SELECT symbol,
       CASE WHEN contains(price_tick, '.') THEN regexp_replace(price_tick, '\\.?0+$', '') ELSE price_tick END AS price_tick,
       CASE WHEN contains(lot_size, '.') THEN regexp_replace(lot_size, '\\.?0+$', '') ELSE lot_size END AS lot_size
FROM perp"""))
def q_strip_zeros(spark, sf_dir):
    inst = instruments(spark, sf_dir, "usdt_perp")
    return inst.select("symbol", strip_zeros("price_tick").alias("price_tick"), strip_zeros("lot_size").alias("lot_size"))


# ---------------------------------------------------------------------- state and watermarks: K3, A5, A6, Q9, A9/Q8

from candlewick.plans.store import latest_state  # noqa: E402


def _state_log(spark, sf_dir):
    """One state write per symbol and day: '<symbol>_last_bar' -> that day's last bar time."""
    k1 = fx.dense_bars(spark, sf_dir)
    daily = k1.groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.max("open_time").alias("t"))
    return daily.select(F.concat("symbol", F.lit("_last_bar")).alias("key"), F.col("t").cast("string").alias("value"),
                        F.col("t").alias("updated_at"))


@register("state_latest", fx.with_sql(fx.K1_SQL, """
SELECT symbol || '_last_bar' AS key, CAST(max(open_time) AS VARCHAR) AS value, max(open_time) AS updated_at
FROM k1 GROUP BY symbol"""))
def q_state_latest(spark, sf_dir):
    return latest_state(_state_log(spark, sf_dir))


@register("state_keep_first", fx.with_sql(fx.K1_SQL, """,
d AS (SELECT symbol, max(open_time) AS t FROM k1 GROUP BY symbol, CAST(open_time AS DATE))
SELECT symbol || '_last_bar' AS key, CAST(min(t) AS VARCHAR) AS value, min(t) AS updated_at FROM d GROUP BY symbol"""))
def q_state_first(spark, sf_dir):
    return latest_state(_state_log(spark, sf_dir), keep_first=True)


@register("archive_watermark", fx.with_sql(fx.TIERS_SQL, f"""
SELECT '{fx.MARKET}' AS market, coalesce(max(open_time), TIMESTAMP '2009-01-03 00:00:00') AS watermark FROM archive"""))
def q_archive_watermark(spark, sf_dir):
    bars = tier_store(spark, sf_dir).tier("archive", fx.MARKET)
    return bars.agg(F.coalesce(F.max("open_time"), F.lit(SENTINEL_TIME).cast("timestamp_ntz")).alias("watermark")).select(
        F.lit(fx.MARKET).alias("market"), "watermark")


@register("ready_recent_watermark", fx.with_sql(fx.TIERS_SQL, f"""
SELECT '{fx.MARKET}' AS market, CAST(max(open_time) + INTERVAL '15 minutes' AS VARCHAR) AS ready FROM recent"""))
def q_ready(spark, sf_dir):
    """Recent watermark recorded per committed day, then read back as the API does."""
    _, rec = fx.tiers(spark, sf_dir)
    daily = rec.groupBy(F.to_date("open_time")).agg(F.max("open_time").alias("t"))
    log_df = daily.select(F.lit(f"{fx.MARKET}_recent_time").alias("key"),
                          (F.col("t") + F.expr("INTERVAL 15 MINUTES")).cast("string").alias("value"),
                          F.col("t").alias("updated_at"))
    last = log_df.agg(F.max("updated_at")).first()[0]
    store = BarStore(spark, frames={"state": log_df, "recent": rec}, as_of=last)
    return spark.createDataFrame([(fx.MARKET, store.ready(fx.MARKET))], "market string, ready string")


@register("table_counts", fx.with_sql(fx.TIERS_SQL, f"""
SELECT 'archive' AS "table", '{fx.MARKET}' AS market, count(*) AS "rows" FROM archive
UNION ALL SELECT 'recent', '{fx.MARKET}', count(*) FROM recent"""))
def q_table_counts(spark, sf_dir):
    return tier_store(spark, sf_dir).describe_tables()


@register("table_schema_recent")
def q_table_schema(spark, sf_dir):
    """Column names and true types of a stored table (Q8); no oracle, rows-only."""
    return tier_store(spark, sf_dir).table_schema("recent")


# ---------------------------------------------------------------------- maintenance round trips: K1, K2, K5-K8
# Each query writes into a fresh folder under the session's checkpoint root
# and returns what a reader sees afterwards.

from candlewick.session import own_job, scratch_path  # noqa: E402

BAR_SELECT = ("open_time, symbol, open, high, low, close, volume, quote_volume, trade_num, "
              "taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price")


def fresh_store(spark, name: str, **kw) -> BarStore:
    return BarStore(spark, scratch_path(spark, name), base_minutes=fx.BASE_MINUTES, **kw)


@register("write_archive_roundtrip", fx.with_sql(fx.K1_SQL, f"SELECT {BAR_SELECT} FROM k1"))
def q_write_archive(spark, sf_dir):
    store = fresh_store(spark, "archive-roundtrip")
    store.write_archive(fx.dense_bars(spark, sf_dir), fx.MARKET)
    return store.scan("archive", fx.MARKET)


@register("append_bars_conflict_keeps_stored", fx.with_sql(fx.TIERS_SQL, f"""
SELECT {BAR_SELECT} FROM archive
UNION ALL
SELECT {BAR_SELECT} FROM recent r
WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.open_time = r.open_time AND a.symbol = r.symbol)"""))
def q_append(spark, sf_dir):
    archive, recent = fx.tiers(spark, sf_dir)
    store = fresh_store(spark, "append")
    store.append_recent(archive, fx.MARKET)
    store.append_recent(recent, fx.MARKET)
    return store.scan("recent", fx.MARKET)


@register("rows_to_insert", fx.with_sql(fx.TIERS_SQL, f"""
SELECT {BAR_SELECT} FROM recent r
WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.open_time = r.open_time AND a.symbol = r.symbol)"""))
def q_rows_to_insert(spark, sf_dir):
    from candlewick.plans.store import rows_to_insert
    archive, recent = fx.tiers(spark, sf_dir)
    return rows_to_insert(recent, archive)


@register("replace_instruments_one_market", fx.with_sql(fx.PART_SQL, f"""
SELECT {INSTRUMENT_SELECT} FROM perp
UNION ALL SELECT {INSTRUMENT_SELECT} FROM spot WHERE status = 'TRADING'"""))
def q_replace_instruments(spark, sf_dir):
    store = fresh_store(spark, "instruments")
    perp, spot = instruments(spark, sf_dir, "usdt_perp"), instruments(spark, sf_dir, "usdt_spot")
    store.replace_instruments(perp, "usdt_perp")
    store.replace_instruments(spot, "usdt_spot")
    store.replace_instruments(SY.trading_instruments(spot, "usdt_spot").unionByName(
        spot.filter(F.col("status") == "TRADING")).distinct(), "usdt_spot")
    return store.instruments().select(*EX.INSTRUMENT_COLUMNS)


EXPORT_AS_OF = _dt.datetime(2024, 2, 10, 0, 0, 0)


def _exported_store(spark, sf_dir, name):
    store = fresh_store(spark, name)
    store.append_recent(fx.dense_bars(spark, sf_dir), fx.MARKET)
    info = store.export_period(fx.MARKET, as_of=EXPORT_AS_OF, retention_days=7)
    assert info and info["exported"], info
    return store


@register("export_period_archive", fx.with_sql(fx.K1_SQL, f"""
SELECT {BAR_SELECT} FROM k1 WHERE open_time >= TIMESTAMP '2024-01-01 00:00:00' AND open_time < TIMESTAMP '2024-02-01 00:00:00'"""))
def q_export(spark, sf_dir):
    return _exported_store(spark, sf_dir, "export").scan("archive", fx.MARKET)


@register("expire_recent_remaining", fx.with_sql(fx.K1_SQL, f"""
SELECT {BAR_SELECT} FROM k1 WHERE open_time >= TIMESTAMP '2024-01-19 00:00:00'"""))
def q_expire(spark, sf_dir):
    """Expiry at a period end of 2024-01-20: rows before 2024-01-19 go, the
    January partition is rewritten with the survivors."""
    store, k1 = fresh_store(spark, "expire"), fx.dense_bars(spark, sf_dir)
    store.append_recent(k1, fx.MARKET)
    store.write_archive(k1.filter(F.col("open_time") < F.lit(_dt.datetime(2024, 1, 20))), fx.MARKET)
    store.expire_recent(fx.MARKET, _dt.datetime(2024, 1, 20))
    return store.scan("recent", fx.MARKET)


@register("bootstrap_recent_seed", fx.with_sql(fx.K1_SQL, f"SELECT {BAR_SELECT} FROM k1"))
def q_bootstrap(spark, sf_dir):
    store = fresh_store(spark, "bootstrap")
    store.write_archive(fx.dense_bars(spark, sf_dir), fx.MARKET)
    store.bootstrap_recent(fx.MARKET, as_of=_dt.datetime(2024, 2, 15), days=30)
    assert store.tier("archive", fx.MARKET).isEmpty()
    return store.scan("recent", fx.MARKET)


# ---------------------------------------------------------------------- ingest: S3, S4, S5, S8, F9, F10, J8, J9, W2, X2, X3

from candlewick import fixture_files as FF  # noqa: E402
from candlewick.sources import bars as SB  # noqa: E402
from candlewick.sources import listing as SL  # noqa: E402

K0_SELECT = f"SELECT {BAR_SELECT} FROM k0"


@register("parse_rest_bars", fx.with_sql(fx.K0_SQL, K0_SELECT))
def q_rest(spark, sf_dir):
    return SB.parse_rest_bars(FF.rest_pages(spark, sf_dir))


@register("parse_stream_bars", fx.with_sql(fx.K0_SQL, K0_SELECT))
def q_stream_parse(spark, sf_dir):
    return SB.parse_stream_bars(FF.stream_messages(spark, sf_dir)).dropDuplicates(["open_time", "symbol"])


def _zip_root(spark, sf_dir):
    root = scratch_path(spark, "zips")
    FF.write_zip_archive(spark, sf_dir, root).count()
    return root


_ZIP_EXPECTED_SQL = fx.with_sql(fx.K0_SQL, """,
ld AS (SELECT symbol, max(CAST(open_time AS DATE)) AS day FROM k0 GROUP BY symbol)
SELECT open_time, symbol, open, high, low,
       CASE WHEN CAST(open_time AS DATE) = ld.day THEN close + 0.015625 ELSE close END AS close,
       volume, quote_volume, trade_num, taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price
FROM k0 JOIN ld USING (symbol)""")


@register("ingest_zip_csv", _ZIP_EXPECTED_SQL)
def q_zip(spark, sf_dir):
    return SB.ingest_zip_csv(spark, _zip_root(spark, sf_dir))


@register("verify_checksums", fx.with_sql(fx.K0_SQL, """,
ld AS (SELECT symbol, max(CAST(open_time AS DATE)) AS day FROM k0 GROUP BY symbol)
SELECT DISTINCT symbol, symbol || '-15m-' || strftime(open_time, '%Y-%m') || '.zip' AS file_name,
       length(symbol) % 2 = 0 AS verified FROM k0
UNION ALL
SELECT symbol, symbol || '-15m-' || strftime(day, '%Y-%m-%d') || '.zip', TRUE FROM ld"""))
def q_checksums(spark, sf_dir):
    v = SB.verify_checksums(spark, _zip_root(spark, sf_dir))
    return v.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("symbol"),
                    F.element_at(F.split("path", "/"), -1).alias("file_name"), "verified")


_MANIFEST_SQL = fx.K0_SQL + """,
days AS (SELECT DISTINCT symbol, CAST(open_time AS DATE) AS day FROM k0),
dkeys AS (
  SELECT 'data/futures/um/daily/klines/' || symbol || '/15m/' AS prefix, symbol,
         'data/futures/um/daily/klines/' || symbol || '/15m/' || symbol || '-15m-' || strftime(day, '%Y-%m-%d') || '.zip' AS zip,
         CAST(day AS TIMESTAMP) + INTERVAL '1 day' + INTERVAL '2 hours' AS last_modified, day
  FROM days),
mkeys AS (
  SELECT DISTINCT 'data/futures/um/monthly/klines/' || symbol || '/15m/' AS prefix, symbol,
         'data/futures/um/monthly/klines/' || symbol || '/15m/' || symbol || '-15m-' || strftime(day, '%Y-%m') || '.zip' AS zip,
         CAST(date_trunc('month', day) AS TIMESTAMP) + INTERVAL '1 month' + INTERVAL '2 hours' AS last_modified
  FROM days),
manifest AS (
  SELECT prefix, zip AS key, symbol, last_modified FROM dkeys
  UNION ALL SELECT prefix, zip || '.CHECKSUM', symbol, last_modified FROM dkeys
  UNION ALL SELECT prefix, zip, symbol, last_modified FROM mkeys
  UNION ALL SELECT prefix, zip || '.CHECKSUM', symbol, last_modified FROM mkeys)"""


def manifest(spark, sf_dir):
    return SL.parse_listing(FF.listing_pages(spark, sf_dir))


@register("parse_listing", fx.with_sql(_MANIFEST_SQL, "SELECT prefix, key, symbol, last_modified FROM manifest"))
def q_listing(spark, sf_dir):
    return manifest(spark, sf_dir)


MARKER_DAY = _dt.date(2024, 1, 15)
DAILY_START = _dt.date(2024, 1, 10)


@register("select_daily_checksums", fx.with_sql(_MANIFEST_SQL, f"""
SELECT prefix, key, symbol, last_modified FROM manifest
WHERE prefix LIKE '%/daily/%' AND key LIKE '%CHECKSUM'
  AND key > prefix || symbol || '-15m-{(MARKER_DAY - _dt.timedelta(days=1)).isoformat()}.zip.CHECKSUM'
  AND CAST(regexp_extract(key, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) >= DATE '{DAILY_START.isoformat()}'"""))
def q_select_daily(spark, sf_dir):
    m = manifest(spark, sf_dir).filter(F.col("prefix").contains("/daily/"))
    return SL.select_daily(m, MARKER_DAY, DAILY_START)


@register("select_monthly_checksums", fx.with_sql(_MANIFEST_SQL, """
SELECT prefix, key, symbol, last_modified FROM manifest
WHERE key LIKE '%CHECKSUM' AND substr(key, length(key) - 19, 7) BETWEEN '2023-12' AND '2024-01'"""))
def q_select_monthly(spark, sf_dir):
    return SL.select_monthly(manifest(spark, sf_dir), "2023-12", "2024-01")


@register("stale_or_missing", fx.with_sql(_MANIFEST_SQL, """,
ld AS (SELECT symbol, max(day) AS day FROM days GROUP BY symbol)
SELECT m.key, 'missing' AS reason FROM manifest m
WHERE m.key LIKE '%CHECKSUM' AND m.prefix LIKE '%/daily/%'
  AND NOT EXISTS (SELECT 1 FROM ld WHERE ld.symbol = m.symbol
                  AND m.key LIKE '%-' || strftime(ld.day, '%Y-%m-%d') || '.zip.CHECKSUM')"""))
def q_stale(spark, sf_dir):
    root = _zip_root(spark, sf_dir)
    local = (SB.listed_files(spark, root).filter(F.col("path").endswith(".CHECKSUM"))
             .select(F.element_at(F.split("path", "/"), -1).alias("file_name"),
                     F.col("modified").cast("timestamp_ntz").alias("local_mtime")))
    m = manifest(spark, sf_dir).filter(F.col("key").endswith("CHECKSUM"))
    return SL.stale_or_missing(m, local).select("key", "reason")


# ---------------------------------------------------------------------- streaming: T1, T2, T6, T7, T8
# Streams read files landed in the scratch folder and run with an
# availableNow trigger, so each query ends once the landed data is consumed.

from candlewick.streaming import bars as ST  # noqa: E402
from candlewick.streaming.batches import collect_batches  # noqa: E402
from candlewick.streaming.upserts import BucketUpserts  # noqa: E402

LANDING_CHUNK_DAYS = 5


def land_in_order(df: DataFrame, path: str) -> str:
    """Land ``df`` as one folder per 5-day slice of open_time, all written by one job, whose tasks
    put a file into each slice that they have rows of; ``slices_in_order`` streams them in event-time
    order as a live feed arrives."""
    days = F.floor(F.unix_micros(F.col("open_time").cast("timestamp")) / (86_400_000_000 * LANDING_CHUNK_DAYS))
    with own_job(df.sparkSession):
        df.withColumn("slice", days).write.partitionBy("slice").parquet(path)
    return path


def stream_in_order(spark, schema, path: str, start) -> None:
    """Run ``start(stream)`` once a landed slice, oldest first, each until it is consumed.

    The runs share one checkpoint, so together they are one stream whose files
    arrive slice by slice."""
    from candlewick.plans.store import partition_values
    for value in sorted(partition_values(spark, path, "slice"), key=int):
        # a glob that grows by one slice a run: earlier files are remembered by the checkpoint
        known = ",".join(v for v in partition_values(spark, path, "slice") if int(v) <= int(value))
        stream = spark.readStream.schema(schema).parquet(f"{path}/slice={{{known}}}")
        with own_job(spark):
            start(stream).awaitTermination()


def _stream_messages_landed(spark, sf_dir, bars=None):
    """Land the stream messages as several text files in one pass (no time order)."""
    path = scratch_path(spark, "landing-msgs")
    FF.stream_messages(spark, sf_dir, bars).repartition(8).write.text(path)
    return path


def _always_listed():
    """Symbols that ``live_update_with_backfill`` expects in every micro-batch."""
    return F.pmod(F.hash("symbol"), F.lit(5)) == 4


def bars_with_messages(spark, sf_dir):
    """The event bars less every third one of the always listed symbols, whose messages
    never come; each time slot keeps a bar."""
    k0 = fx.event_bars(spark, sf_dir).withColumn(
        "_lost", _always_listed() & (F.pmod(F.hash("open_time", "symbol"), F.lit(3)) == 0))
    seen = k0.filter(~F.col("_lost")).select("open_time", F.lit(True).alias("_seen")).distinct()
    return (k0.join(seen, "open_time", "left").filter(~F.col("_lost") | F.col("_seen").isNull())
            .select(*fx.BAR_COLUMNS))


@register("stream_closed_bars", fx.with_sql(fx.K0_SQL, K0_SELECT))
def q_stream_closed(spark, sf_dir):
    """T1 over landed messages, in no time order and some of them repeated, in several
    micro-batches; however late, none is dropped, and one a key is kept when read."""
    landing = _stream_messages_landed(spark, sf_dir)
    out, ck = scratch_path(spark, "stream-bars"), scratch_path(spark, "stream-bars-ck")
    ST.run_available_now(ST.closed_bar_stream(spark, landing, max_files_per_trigger=2).select(*fx.BAR_COLUMNS), out, ck)
    return one_bar_per_key(spark.read.parquet(out))


@register("stream_resample_60m_off15", fx.with_sql(fx.K1_SQL, resample_sql("k1", 60, 15) + """
AND resample_time + INTERVAL '60 minutes' <= (SELECT max(open_time) FROM k1)"""))
def q_stream_resample(spark, sf_dir):
    """Buckets come out once the watermark (latest bar, no delay) passes their end."""
    k1 = fx.dense_bars(spark, sf_dir)
    landing = land_in_order(k1, scratch_path(spark, "landing-bars"))
    out, ck = scratch_path(spark, "stream-resample"), scratch_path(spark, "stream-resample-ck")
    stream_in_order(spark, k1.schema, landing, lambda src: (
        ST.resample_stream(src, 60, 15, fx.BASE_MINUTES, delay="0 minutes").writeStream.format("parquet")
        .outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start(out)))
    return spark.read.parquet(out)


COMPLETE_BATCHES = fx.with_sql(fx.K1_SQL, f""",
n AS (SELECT count(DISTINCT symbol) AS total FROM k1),
c AS (SELECT open_time + INTERVAL '15 minutes' AS run_time, count(DISTINCT symbol) AS got FROM k1 GROUP BY 1)
SELECT {BAR_SELECT} FROM k1
WHERE open_time + INTERVAL '15 minutes' IN (SELECT run_time FROM c, n WHERE got = total)""")


def _always_listed_symbols(bars):
    return bars.select("symbol").distinct().withColumns(
        {"from_time": F.lit(None).cast("timestamp_ntz"), "to_time": F.lit(None).cast("timestamp_ntz")})


@register("collect_complete_batches", COMPLETE_BATCHES)
def q_collect(spark, sf_dir):
    """T2 + T8: a batch (time slot) is released from Spark's state only when every symbol listed
    at the slot has delivered its bar."""
    k1 = fx.dense_bars(spark, sf_dir)
    landing = land_in_order(k1, scratch_path(spark, "landing-batches"))
    listing = materialize(_always_listed_symbols(k1), "listed")
    out, ck = scratch_path(spark, "collected"), scratch_path(spark, "collected-ck")
    stream_in_order(spark, k1.schema, landing, lambda src: (
        collect_batches(src, listing, fx.BASE_MINUTES).filter("complete").select(*fx.BAR_COLUMNS).writeStream
        .format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)))
    return spark.read.schema(k1.select(*fx.BAR_COLUMNS).schema).parquet(out)


class FailsOnce:
    """A ``foreachBatch`` handler that dies before its first delivery of every batch id and is
    given each batch twice afterwards."""

    def __init__(self, handler):
        self.handler, self.seen = handler, set()

    def __call__(self, batch, batch_id):
        if batch_id not in self.seen:
            self.seen.add(batch_id)
            raise RuntimeError(f"the sink of batch {batch_id} died")
        self.handler(batch, batch_id)
        self.handler(batch, batch_id)


@register("collect_replayed_batches", fx.with_sql(fx.K1_SQL, f"SELECT {BAR_SELECT} FROM k1"))
def q_collect_replayed(spark, sf_dir):
    """The driver dies between a batch's release and its sink, once for every batch id,
    and every batch is delivered twice after that; all bars are stored once."""
    from pyspark.errors import StreamingQueryException
    k1 = fx.dense_bars(spark, sf_dir).select(*fx.BAR_COLUMNS)
    landing, store = scratch_path(spark, "landing-replay"), fresh_store(spark, "replay")
    with own_job(spark):
        k1.repartition(4, "symbol").write.parquet(landing)          # no slot is whole in one file
    live = ST.LiveUpdater(spark, store, fx.MARKET)
    sink, listing = FailsOnce(live), materialize(_always_listed_symbols(k1), "listed")
    while True:
        stream = spark.readStream.schema(k1.schema).option("maxFilesPerTrigger", 2).parquet(landing)
        try:
            with own_job(spark):
                (collect_batches(stream, listing, fx.BASE_MINUTES).writeStream.foreachBatch(sink)
                 .option("checkpointLocation", live.checkpoint).trigger(availableNow=True).start()).awaitTermination()
        except StreamingQueryException as e:
            if "died" not in str(e):
                raise
            continue
        break
    live.flush()
    return store.scan("recent", fx.MARKET)


@register("stream_resample_upserts", fx.with_sql(fx.K1_SQL, resample_sql("k1", 60, 15)))
def q_stream_upserts(spark, sf_dir):
    """T7 with late bars: files hold every symbol's bars in no time order, and each corrects the
    buckets that it touches; the result is the batch resample of everything."""
    k1, store = fx.dense_bars(spark, sf_dir).select(*fx.BAR_COLUMNS), fresh_store(spark, "upserts")
    landing = scratch_path(spark, "landing-upserts")
    with own_job(spark):
        k1.repartition(4, F.xxhash64("open_time", "symbol")).write.parquet(landing)
    merge = BucketUpserts(store, fx.MARKET, 60, 15)
    stream = spark.readStream.schema(k1.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    with own_job(spark):
        (stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_path(spark, "upserts-ck"))
         .trigger(availableNow=True).start()).awaitTermination()
    return merge.buckets().drop("period")


@register("stream_sink_recent", fx.with_sql(fx.K0_SQL, K0_SELECT))
def q_stream_sink(spark, sf_dir):
    """T6 + K9: closed bars appended to the recent tier per micro-batch, the
    watermark recorded after the bars."""
    landing = _stream_messages_landed(spark, sf_dir)
    store = fresh_store(spark, "sink-store")
    s = ST.closed_bar_stream(spark, landing, max_files_per_trigger=3)      # no delay: late bars come through
    q = (s.select(*fx.BAR_COLUMNS).writeStream.foreachBatch(ST.BarSink(store, fx.MARKET))
         .option("checkpointLocation", scratch_path(spark, "sink-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    return store.scan("recent", fx.MARKET)


# ---------------------------------------------------------------------- J2, F11 (declared windows), W2

@register("drop_dead_symbols", fx.with_sql(fx.K1_SQL, """
SELECT * FROM k1 WHERE symbol NOT IN (SELECT symbol FROM k1 GROUP BY symbol HAVING sum(volume) = 0)"""))
def q_drop_dead(spark, sf_dir):
    k1 = fx.dense_bars(spark, sf_dir)
    return Q.drop_symbols(k1, Q.dead_symbols(k1))


def declared_windows(spark, sf_dir):
    """A table of declared suspensions: every supplier's nation key names a user, whose
    symbol is suspended for the six hours that start at the supplier's key in hours
    after 2024-01-05; every seventh row has its ends swapped and counts for nothing."""
    sup = fx.read_table(spark, sf_dir, "supplier")
    start = F.timestamp_add("HOUR", F.col("s_suppkey") % 600, F.lit(_dt.datetime(2024, 1, 5)))
    end = F.timestamp_add("HOUR", F.lit(6), start)
    swapped = F.col("s_suppkey") % 7 == 0
    return sup.select(F.concat(F.lit("U"), F.col("s_nationkey").cast("string"), F.lit("USDT")).alias("symbol"),
                      F.when(swapped, end).otherwise(start).cast("timestamp_ntz").alias("start"),
                      F.when(swapped, start).otherwise(end).cast("timestamp_ntz").alias("end"))


@register("suspended_bars_declared", fx.with_sql(fx.K1_SQL, """,
w AS (SELECT 'U' || s_nationkey || 'USDT' AS symbol, TIMESTAMP '2024-01-05' + to_hours(CAST(s_suppkey % 600 AS INTEGER)) AS s,
             s_suppkey % 7 = 0 AS swapped FROM supplier)
SELECT * FROM k1 WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.symbol = k1.symbol AND NOT swapped
  AND k1.open_time BETWEEN w.s AND w.s + INTERVAL '6 hours')"""))
def q_suspended_declared(spark, sf_dir):
    """F11 with declared windows given as a table."""
    return Q.suspended_bars(fx.dense_bars(spark, sf_dir), declared_windows(spark, sf_dir))


@register("dedup_daily_wins", _ZIP_EXPECTED_SQL)
def q_dedup(spark, sf_dir):
    """W2 on its own: the raw zip rows (monthly plus the re-published days)
    reduced to one bar per key, the daily copy winning."""
    raw = SB.read_zip_csv(spark, _zip_root(spark, sf_dir))
    return SB.dedup_bars(raw)


# ---------------------------------------------------------------------- more edges of Q1/Q2/Q5

@register("get_market_20m_not_multiple_of_base", fx.with_sql(fx.K1_SQL, resample_sql(
    "k1", 20, 0, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ALL_END)}") + "\nORDER BY resample_time, symbol"))
def q_not_multiple(spark, sf_dir):
    """20-minute buckets over 15-minute bars: complete means floor(20/15) = 1 bar."""
    return dense_store(spark, sf_dir).get_market(fx.MARKET, 20, 0, ALL_BEGIN, ALL_END)


@register("get_market_60m_negative_offset", fx.with_sql(fx.K1_SQL, resample_sql(
    "k1", 60, -15, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ALL_END)}") + "\nORDER BY resample_time, symbol"))
def q_negative_offset(spark, sf_dir):
    """Offset -15 passes validation and behaves as offset 45."""
    return dense_store(spark, sf_dir).get_market(fx.MARKET, 60, -15, ALL_BEGIN, ALL_END)


def _hybrid_symbol_sql(symbol: str) -> str:
    sql = hybrid_sql(60, 15, ALL_BEGIN, ALL_END)
    return sql.replace("GROUP BY symbol, resample_time", f"AND symbol = '{symbol}'\nGROUP BY symbol, resample_time")


@register("hybrid_get_symbol_60m_off15", _hybrid_symbol_sql(SYMBOL))
def q_hybrid_symbol(spark, sf_dir):
    return tier_store(spark, sf_dir).get_symbol(fx.MARKET, SYMBOL, 60, 15, ALL_BEGIN, ALL_END)


# ---------------------------------------------------------------------- the historical load as one job

LOADED_SQL = """,
ld AS (SELECT symbol, max(CAST(open_time AS DATE)) AS day FROM k0 GROUP BY symbol),
src AS (
  SELECT open_time, symbol, open, high, low, close, volume, quote_volume, trade_num,
         taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price, 1 AS rank_
  FROM k0 WHERE length(symbol) % 2 = 0
  UNION ALL
  SELECT k0.open_time, k0.symbol, open, high, low, close + 0.015625, volume, quote_volume, trade_num,
         taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price, 2
  FROM k0 JOIN ld ON k0.symbol = ld.symbol AND CAST(k0.open_time AS DATE) = ld.day),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY rank_ DESC) AS rn FROM src)
      WHERE rn = 1),
r AS (SELECT symbol, min(open_time) AS f, max(open_time) AS l FROM d WHERE volume > 0 GROUP BY symbol)
SELECT open_time, symbol, open, high, low, close, volume, quote_volume, trade_num,
       taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price
FROM d JOIN r USING (symbol) WHERE open_time BETWEEN f AND l"""


@register("load_history_archive", fx.with_sql(fx.K0_SQL, LOADED_SQL))
def q_load_history(spark, sf_dir):
    """Landed zips (monthly files of odd-length symbols carry a wrong checksum
    and are skipped) -> verified, de-duplicated, clipped bars in the archive."""
    from candlewick.plans.load import load_history
    store = fresh_store(spark, "load-history")
    load_history(spark, _zip_root(spark, sf_dir), store, fx.MARKET)
    return store.scan("archive", fx.MARKET)


@register("load_history_incremental", f"SELECT *, 0 AS reopened FROM ({fx.with_sql(fx.K0_SQL, LOADED_SQL)})")
def q_load_incremental(spark, sf_dir):
    """The same zips in two loads, the daily files in the second, and a third load that
    finds nothing new: ``reopened`` counts the bars it read."""
    from candlewick.plans.load import load_history
    store, root = fresh_store(spark, "load-incremental"), _zip_root(spark, sf_dir)
    load_history(spark, f"{root}/monthly_klines", store, fx.MARKET)
    load_history(spark, root, store, fx.MARKET)
    again = load_history(spark, root, store, fx.MARKET).agg(F.count("*").cast("int").alias("reopened"))
    return store.scan("archive", fx.MARKET).crossJoin(F.broadcast(again))              # one row


@register("write_archive_late_bars", fx.with_sql(fx.K1_SQL, f"SELECT {BAR_SELECT} FROM k1"))
def q_archive_late(spark, sf_dir):
    """K1: every fiftieth bar comes after the archive was written and is merged into its period."""
    store, k1 = fresh_store(spark, "late-bars"), fx.dense_bars(spark, sf_dir).select(*fx.BAR_COLUMNS)
    late = F.pmod(F.hash("symbol", "open_time"), F.lit(50)) == 0
    store.write_archive(k1.filter(~late), fx.MARKET)
    store.write_archive(k1.filter(late), fx.MARKET)
    return store.scan("archive", fx.MARKET)


@register("archive_activity", fx.with_sql(fx.KT_SQL, """
SELECT symbol, min(CASE WHEN volume > 0 THEN open_time END) AS first_candle,
       max(CASE WHEN volume > 0 THEN open_time END) AS last_candle, sum(volume) AS total_volume FROM kt GROUP BY symbol"""))
def q_archive_activity(spark, sf_dir):
    """A7, A8 from the summaries that archive writes keep of several years of periods."""
    store, bars = fresh_store(spark, "activity"), fx.order_bars(spark, sf_dir)
    early = F.pmod(F.hash("symbol"), F.lit(2)) == 0
    store.write_archive(bars.filter(early), fx.MARKET)
    store.write_archive(bars.filter(~early), fx.MARKET)
    return store.activity(fx.MARKET)


@register("dead_symbols_in_page", fx.with_sql(fx.K1_SQL, f""",
p AS (SELECT * FROM k1 WHERE open_time >= {ts(PAGE_END)} - INTERVAL '{PAGE_LIMIT * 15} minutes' AND open_time < {ts(PAGE_END)})
SELECT symbol, sum(volume) AS total_volume FROM p GROUP BY symbol HAVING sum(volume) = 0"""))
def q_dead_in_page(spark, sf_dir):
    """A8 over one fetched page: symbols without a single trade in it."""
    return Q.dead_symbols(Q.rest_page(fx.dense_bars(spark, sf_dir), PAGE_END, PAGE_LIMIT, fx.BASE_MINUTES))


@register("instruments_decimal_view", fx.with_sql(fx.PART_SQL, """
SELECT symbol, TRY_CAST(price_tick AS DECIMAL(38,18)) AS price_tick, TRY_CAST(lot_size AS DECIMAL(38,18)) AS lot_size,
       TRY_CAST(min_notional_value AS DECIMAL(38,18)) AS min_notional_value
FROM spot"""))
def q_decimal_view(spark, sf_dir):
    """Stored text sizes as DECIMAL(38,18)."""
    return EX.instruments_as_decimal(instruments(spark, sf_dir, "usdt_spot")).select(
        "symbol", "price_tick", "lot_size", "min_notional_value")


@register("resampled_gaps_60m", fx.with_sql(fx.K1_SQL, f""",
r AS ({resample_sql("k1", 60, 0, f"open_time BETWEEN {ts(ALL_BEGIN)} AND {ts(ALL_END)}")}),
l AS (SELECT symbol, lag(resample_time) OVER (PARTITION BY symbol ORDER BY resample_time) AS prev_resample_time,
             resample_time FROM r)
SELECT symbol, prev_resample_time, resample_time,
       CAST(date_diff('minute', prev_resample_time, resample_time) AS BIGINT) AS gap_minutes
FROM l WHERE prev_resample_time IS NOT NULL AND resample_time - prev_resample_time > INTERVAL '60 minutes'"""))
def q_resampled_gaps(spark, sf_dir):
    """The integrity check run on resampled output: hours without a complete bucket."""
    hourly = dense_store(spark, sf_dir).get_market(fx.MARKET, 60, 0, ALL_BEGIN, ALL_END, order=False)
    return Q.find_gaps(hourly, 60, time_col="resample_time")


# ---------------------------------------------------------------------- several periods: K1, K6-K8, W5, X6, load

from candlewick.schema import SENTINEL_TIME  # noqa: E402
from candlewick.plans.joins import materialize  # noqa: E402
from candlewick.plans.load import archive_clipped  # noqa: E402

TRADE_SELECT = f"SELECT {BAR_SELECT} FROM kt"
LAST_MONTH = "(SELECT date_trunc('month', max(open_time)) FROM kt)"


def trades_split(spark, sf_dir):
    """(all order bars, start of their last month): bars of several years."""
    bars = fx.order_bars(spark, sf_dir)
    last = bars.agg(F.date_trunc("month", F.max("open_time")).cast("timestamp_ntz")).first()[0]
    return bars, last


def both_tiers(store):
    return store.scan("archive", fx.MARKET).unionByName(store.scan("recent", fx.MARKET)).distinct()


@register("write_archive_two_loads", fx.with_sql(fx.KT_SQL, f"""
SELECT open_time, symbol, open, high, low, close + CASE WHEN day(open_time) = 15 THEN 1e0 ELSE 0e0 END AS close, volume,
       quote_volume, trade_num, taker_buy_base_asset_volume, taker_buy_quote_asset_volume, avg_price FROM kt"""))
def q_two_loads(spark, sf_dir):
    """K1: odd days first, then even days and corrected 15ths of the same periods; no bar is
    lost and corrections replace what was stored, also in periods long closed."""
    store, bars = fresh_store(spark, "two-loads"), fx.order_bars(spark, sf_dir)
    odd = F.dayofmonth("open_time") % 2 == 1
    store.write_archive(bars.filter(odd), fx.MARKET)
    fixed = bars.filter(F.dayofmonth("open_time") == 15).withColumn("close", F.col("close") + 1.0)
    store.write_archive(bars.filter(~odd).unionByName(fixed), fx.MARKET)
    return store.scan("archive", fx.MARKET)


@register("export_into_partial_period", fx.with_sql(fx.KT_SQL, TRADE_SELECT))
def q_export_partial(spark, sf_dir):
    """K6, K7: the archive ends within the month that is exported and the recent tier
    starts before; both tiers together still hold every bar afterwards."""
    bars, last = trades_split(spark, sf_dir)
    store, middle = fresh_store(spark, "export-partial"), last - _dt.timedelta(days=12)
    store.write_archive(bars.filter(F.col("open_time") < F.lit(middle)), fx.MARKET)
    store.append_recent(bars.filter(F.col("open_time") >= F.lit(middle - _dt.timedelta(days=40))), fx.MARKET)
    info = store.export_period(fx.MARKET, as_of=last + _dt.timedelta(days=12), retention_days=7)
    assert info["exported"], info
    return both_tiers(store)


@register("export_leaves_recent", fx.with_sql(fx.KT_SQL, f"""
{TRADE_SELECT} WHERE open_time >= {LAST_MONTH} - INTERVAL '1 day'"""))
def q_export_recent(spark, sf_dir):
    """K7 after K6: what remains in the recent tier begins one day before the exported month's end."""
    bars, last = trades_split(spark, sf_dir)
    store = fresh_store(spark, "export-recent")
    store.append_recent(bars, fx.MARKET)
    store.export_period(fx.MARKET, as_of=last + _dt.timedelta(days=12), retention_days=7)
    return store.scan("recent", fx.MARKET)


@register("bootstrap_stale_archive", fx.with_sql(fx.KT_SQL, f"""
SELECT CASE WHEN open_time >= {LAST_MONTH} THEN 'recent' ELSE 'archive' END AS tier, {BAR_SELECT} FROM kt"""))
def q_bootstrap_stale(spark, sf_dir):
    """K8 with an archive that ended long before: its newest month moves whole, the rest stays."""
    bars, last = trades_split(spark, sf_dir)
    store = fresh_store(spark, "bootstrap-stale")
    store.write_archive(bars, fx.MARKET)
    store.bootstrap_recent(fx.MARKET, as_of=last + _dt.timedelta(days=400), days=30)
    return (store.scan("archive", fx.MARKET).withColumn("tier", F.lit("archive"))
            .unionByName(store.scan("recent", fx.MARKET).withColumn("tier", F.lit("recent"))))


@register("load_history_two_loads", fx.with_sql(fx.K1_SQL, f""",
r AS (SELECT symbol, min(open_time) AS f, max(open_time) AS l FROM k1 WHERE volume > 0 GROUP BY symbol)
SELECT {BAR_SELECT} FROM k1 JOIN r USING (symbol) WHERE open_time BETWEEN f AND l"""))
def q_load_two(spark, sf_dir):
    """The clip of two loads, the later half first, is the clip of one load of everything."""
    store, k1 = fresh_store(spark, "load-two"), fx.dense_bars(spark, sf_dir)
    half = F.col("open_time") < F.lit(_dt.datetime(2024, 1, 16, 12))
    archive_clipped(store, k1.filter(~half), fx.MARKET)
    archive_clipped(store, k1.filter(half), fx.MARKET)
    return store.scan("archive", fx.MARKET)


@register("latest_stored_period", fx.with_sql(fx.KT_SQL, f"""
SELECT '{fx.MARKET}' AS market, max(strftime(open_time, '%Y-%m')) AS latest, count(DISTINCT strftime(open_time, '%Y-%m')) AS periods
FROM kt"""))
def q_latest_period(spark, sf_dir):
    """The newest of several years of stored periods, read from the partition column alone."""
    store = fresh_store(spark, "latest")
    store.write_archive(fx.order_bars(spark, sf_dir), fx.MARKET)
    periods = store.tier("archive", fx.MARKET).select("period").distinct()
    out = periods.agg(F.max("period").alias("latest"), F.count("*").alias("periods"))
    assert out.first()["latest"] == store.latest_period("archive", fx.MARKET)
    return out.select(F.lit(fx.MARKET).alias("market"), "latest", "periods")


@register("archive_period_list", fx.with_sql(fx.KT_SQL, """,
m AS (SELECT symbol, min(CAST(open_time AS DATE)) AS a, max(CAST(open_time AS DATE)) AS b FROM kt GROUP BY symbol)
SELECT symbol, strftime(s, '%Y-%m') AS label, CAST(greatest(s, date_trunc('month', a)) AS DATE) AS period_start,
       CAST(s + INTERVAL '3 months' AS DATE) AS period_end
FROM (SELECT *, unnest(generate_series(CAST(date_trunc('quarter', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL '3 months')) AS s FROM m)"""))
def q_period_list(spark, sf_dir):
    """The quarters between each symbol's first and last bar, the first clipped to its start month."""
    days = fx.order_bars(spark, sf_dir).groupBy("symbol").agg(
        F.to_date(F.min("open_time")).alias("a"), F.to_date(F.max("open_time")).alias("b"))
    return (days.select("symbol", F.explode(TG.period_list("a", "b", 3)).alias("p"))
            .select("symbol", "p.label", "p.period_start", "p.period_end"))


@register("drop_dead_order_symbols", fx.with_sql(fx.KT_SQL, f"""
{TRADE_SELECT} WHERE symbol NOT IN (SELECT symbol FROM kt GROUP BY symbol HAVING sum(volume) = 0)"""))
def q_drop_dead_orders(spark, sf_dir):
    """J2 with symbols that never trade (customers in the last market segment have volume zero)."""
    bars = fx.order_bars(spark, sf_dir)
    return Q.drop_symbols(bars, Q.dead_symbols(bars))


@register("symbol_activity", fx.with_sql(fx.KT_SQL, """
SELECT symbol, min(CASE WHEN volume > 0 THEN open_time END) AS first_candle,
       max(CASE WHEN volume > 0 THEN open_time END) AS last_candle, sum(volume) AS total_volume FROM kt GROUP BY symbol"""))
def q_activity(spark, sf_dir):
    """A7 and A8 in one aggregate."""
    return Q.symbol_activity(fx.order_bars(spark, sf_dir))


@register("table_counts_all", fx.with_sql(fx.KT_SQL + "," + fx.PART_SQL, f"""
SELECT 'archive' AS "table", '{fx.MARKET}' AS market, count(*) AS "rows" FROM kt
UNION ALL SELECT 'recent', '{fx.MARKET}', count(*) FROM kt WHERE open_time >= {LAST_MONTH}
UNION ALL SELECT 'instruments', 'usdt_perp', count(*) FROM perp
UNION ALL SELECT 'state', NULL, 1"""))
def q_counts_all(spark, sf_dir):
    """A9 over every table of a store: both tiers, instruments and state."""
    bars, last = trades_split(spark, sf_dir)
    store = fresh_store(spark, "counts")
    store.write_archive(bars, fx.MARKET)               # records its watermark: one state row
    store.append_recent(bars.filter(F.col("open_time") >= F.lit(last)), fx.MARKET)
    store.replace_instruments(instruments(spark, sf_dir, "usdt_perp"), "usdt_perp")
    return store.describe_tables()


@register("live_update_with_backfill", fx.with_sql(fx.K0_SQL, f"SELECT {BAR_SELECT}, 0 AS open_ranges FROM k0"))
def q_live(spark, sf_dir):
    """T1, T2, T6, T8 with T3-T5: messages in no time order, some of which never come, go through
    the collector and the sink, with listing intervals under which every slot expects other
    symbols; REST pages that land in three calls answer the backfill requests. Every closed bar
    ends up in the recent tier, and no requested range stays open."""
    landing, store = _stream_messages_landed(spark, sf_dir, bars_with_messages(spark, sf_dir)), fresh_store(spark, "live")
    listing = materialize(bar_intervals(fx.event_bars(spark, sf_dir)), "listing")
    live = ST.LiveUpdater(spark, store, fx.MARKET)
    live.run(ST.closed_bar_stream(spark, landing, max_files_per_trigger=3), listing)
    live.flush()
    pages = materialize(FF.rest_pages(spark, sf_dir), "pages")
    for call in range(3):
        left = ST.serve_backfill(store, fx.MARKET, SB.parse_rest_bars(
            pages.filter(F.pmod(F.hash("value"), F.lit(3)) == call)), listing)
    ranges = left.agg(F.count("*").cast("int").alias("open_ranges"))
    return store.scan("recent", fx.MARKET).crossJoin(F.broadcast(ranges))          # one row


def bar_intervals(bars):
    """(symbol, from_time, to_time): listed from each bar's open to its close."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(fx.BASE_MINUTES))
    return bars.select("symbol", F.col("open_time").alias("from_time"), (F.col("open_time") + step).alias("to_time"))


@register("rejected_csv_lines", """
SELECT event_id, event_id || ',' || user_id || ',' || event_type AS line FROM events WHERE event_id % 3 <> 0""")
def q_rejects(spark, sf_dir):
    """S3: lines of zipped CSV that are no kline records come back whole, with their file."""
    ev = fx.read_table(spark, sf_dir, "events")
    good = F.concat(F.lit("1704067200000,1,1,1,1,1,1704068099999,1,1,1,1,"), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 3 == 0, good).otherwise(F.concat_ws(",", "event_id", "user_id", "event_type"))
    root = scratch_path(spark, "rejects")
    FF.write_zips(ev.select(F.concat(F.lit(f"{root}/daily_klines/X/X-15m-2024-01-"), F.date_format("ts", "dd"), F.lit(".zip"))
                            .alias("path"), F.col("ts").alias("open_time"), line.alias("line"),
                            F.lit(False).alias("header"), F.lit(True).alias("good_sum"))).count()
    return SB.rejected_lines(spark, root).select(F.split("line", ",")[0].cast("long").alias("event_id"), "line")


def _profile_sql() -> str:
    from candlewick.schema import BAR_SCHEMA
    rows = [(f.name, f.dataType.simpleString()) for f in BAR_SCHEMA.fields]
    return fx.with_sql(fx.TIERS_SQL, "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM recent" for c, t in rows)
        + f"\nUNION ALL SELECT 'market', 'string', count(*) FROM recent")


@register("table_profile_recent", _profile_sql())
def q_profile(spark, sf_dir):
    """Q8: columns and types of a stored table, with how many values each column holds."""
    return tier_store(spark, sf_dir).table_profile("recent")


@register("list_symbols", fx.with_sql(fx.PART_SQL, "SELECT DISTINCT symbol FROM perp"))
def q_list_symbols(spark, sf_dir):
    """Symbols from the common prefixes of a paged folder listing."""
    names = instruments(spark, sf_dir, "usdt_perp").select("symbol").distinct()
    prefix = F.concat(F.lit("<CommonPrefixes><Prefix>data/futures/um/daily/klines/"), "symbol", F.lit("/</Prefix></CommonPrefixes>"))
    pages = (names.groupBy(F.substring("symbol", 1, 3).alias("page"), F.pmod(F.hash("symbol"), F.lit(97)).alias("k"))
             .agg(F.array_join(F.collect_list(prefix), "").alias("body"))
             .select(F.concat(F.lit("<ListBucketResult><Prefix>data/futures/um/daily/klines/</Prefix>"), "body",
                              F.lit("</ListBucketResult>")).alias("value")))
    return SL.list_symbols(pages)


@register("manifest_local_paths", fx.with_sql(_MANIFEST_SQL, """
SELECT key, '/data/' || CASE WHEN prefix LIKE '%/daily/%' THEN 'daily' ELSE 'monthly' END || '_klines/' || symbol || '/'
       || split_part(key, '/', -1) AS local_path FROM manifest"""))
def q_local_paths(spark, sf_dir):
    return SL.with_local_path(manifest(spark, sf_dir), "/data").select("key", "local_path")
