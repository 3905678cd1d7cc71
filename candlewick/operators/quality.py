"""Bar audits and clean-ups: gaps, missing days, trading range, dead symbols,
clipping, closed bars, fetch summaries and backfill paging.

Per-symbol ordered steps work on symbol-days, not symbols, and per-symbol
summaries are joined back by plain joins that AQE broadcasts or splits, so one
hot symbol never lands in a single task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.timegrid import batch_time, next_boundary
from candlewick.plans.series import with_neighbour
from candlewick.schema import LONG_PAGE, SENTINEL_TIME, SHORT_PAGE


def _micros_between(later, earlier):
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def _minutes_between(later, earlier):
    """Whole minutes, for reports; comparisons use microseconds."""
    return (_micros_between(later, earlier) / F.lit(_MINUTE)).cast("long")


_MINUTE = 60_000_000


def find_gaps(bars: DataFrame, interval_minutes: int, time_col: str = "open_time") -> DataFrame:
    """Rows whose step from the previous row of the same symbol exceeds the
    interval (W1). Works on base bars (``open_time``) and on resampled output
    (``time_col="resample_time"``, where a gap is a missing complete bucket).

    One scan and one shuffle of the bars: a symbol-day's sorted times (bounded
    by a day's bars) give the gaps inside the day; gaps between days come from
    a window over one row a symbol-day.

    Columns: symbol, prev_<time_col>, <time_col>, gap_minutes.
    """
    prev, wide = f"prev_{time_col}", F.lit(int(interval_minutes) * _MINUTE)

    def step(a, b):
        return F.struct(a.alias("a"), b.alias("b"))

    def too_wide(s):
        return _micros_between(s["b"], s["a"]) > wide

    times = F.sort_array(F.collect_list(time_col))
    days = (bars.select("symbol", time_col).filter(F.col(time_col).isNotNull())
            .groupBy("symbol", F.to_date(time_col).alias("_day")).agg(times.alias("_t"))
            .select("symbol", "_day", F.col("_t")[0].alias("_first"), F.element_at("_t", -1).alias("_last"),
                    F.filter(F.zip_with(F.slice("_t", 1, F.size("_t") - 1), F.slice("_t", 2, F.size("_t")), step),
                             too_wide).alias("_steps")))
    before = F.lag("_last").over(Window.partitionBy("symbol").orderBy("_day"))
    edge = F.when(F.col("_before").isNotNull(), F.array(step(F.col("_before"), F.col("_first"))))
    steps = F.concat(F.filter(F.coalesce(edge, F.slice("_steps", 1, 0)), too_wide), "_steps")
    return (days.withColumn("_before", before).select("symbol", F.explode(steps).alias("_s"))
            .select("symbol", F.col("_s.a").alias(prev), F.col("_s.b").alias(time_col),
                    _minutes_between(F.col("_s.b"), F.col("_s.a")).alias("gap_minutes")))


def missing_days(bars: DataFrame) -> DataFrame:
    """Days without any bar between a symbol's first and last day.

    Expected days come from ``sequence`` over each symbol's span (one row per
    symbol-day), present days from a distinct projection; the anti join is on
    (symbol, day), so a hot symbol spreads over its days.
    """
    days = bars.select("symbol", F.to_date("open_time").alias("day"))
    span = days.groupBy("symbol").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    expected = span.select("symbol", F.explode(F.sequence("d0", "d1")).alias("day"))
    return expected.join(days.distinct(), ["symbol", "day"], "left_anti")


def trading_range(bars: DataFrame) -> DataFrame:
    """Per symbol the first and last bar with volume > 0."""
    return (bars.filter(F.col("volume") > 0).groupBy("symbol")
                .agg(F.min("open_time").alias("first_candle"), F.max("open_time").alias("last_candle")))


def symbol_activity(bars: DataFrame) -> DataFrame:
    """Trading range and total volume of every symbol in one aggregate (A7 with A8):
    (symbol, first_candle, last_candle, total_volume); a dead symbol has no range."""
    traded = F.when(F.col("volume") > 0, F.col("open_time"))
    return bars.groupBy("symbol").agg(F.min(traded).alias("first_candle"), F.max(traded).alias("last_candle"),
                                      F.sum("volume").alias("total_volume"))


def dead_symbols(bars: DataFrame) -> DataFrame:
    """Symbols whose total volume is zero."""
    return (bars.groupBy("symbol").agg(F.sum("volume").alias("total_volume"))
                .filter(F.col("total_volume") == 0))


def clip_to_trading_range(bars: DataFrame) -> DataFrame:
    """Keep bars inside their symbol's trading range.

    A symbol without any traded bar has no range, so the inner join also
    removes every dead symbol.
    """
    x = bars.join(trading_range(bars), "symbol")
    return (x.filter(F.col("open_time").between(F.col("first_candle"), F.col("last_candle")))
             .select(*[c for c in bars.columns]))


def drop_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Anti-membership: bars of symbols not listed in ``symbols``."""
    return bars.join(symbols.select("symbol").distinct(), "symbol", "left_anti")


def closed_bars(bars: DataFrame, now: _dt.datetime, interval_minutes: int) -> DataFrame:
    """Bars that are closed at ``now``: open_time before the current boundary (F8)."""
    current = next_boundary(F.lit(now), interval_minutes) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(int(interval_minutes)))
    return bars.filter(F.col("open_time") < current.cast("timestamp_ntz"))


def fetch_summary(bars: DataFrame) -> DataFrame:
    """Per symbol: bar count and earliest open_time of a fetched page (A10)."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("num"), F.min("open_time").alias("begin_time"))


def rest_page(bars: DataFrame, end: _dt.datetime, limit: int, interval_minutes: int) -> DataFrame:
    """What one REST page returns per symbol: bars in [end - limit*interval, end)."""
    start = end - _dt.timedelta(minutes=limit * interval_minutes)
    return bars.filter((F.col("open_time") >= F.lit(start)) & (F.col("open_time") < F.lit(end)))


def next_page(summary: DataFrame, start: _dt.datetime, limit: int, interval_minutes: int) -> DataFrame:
    """Symbols that need another page (T5): the page was full and did not reach
    ``start``. The next page ends one interval before the earliest bar."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(interval_minutes)))
    return (summary.filter((F.col("begin_time") > F.lit(start)) & (F.col("num") == F.lit(int(limit))))
                   .select("symbol", "num", "begin_time", (F.col("begin_time") - step).alias("next_end_time")))


def backfill_plan(watermarks: DataFrame, now: _dt.datetime, interval_minutes: int,
                  watermark_col: str = "watermark") -> DataFrame:
    """Page size for catching up from a watermark to ``now`` (T4): a gap of at
    most 99 intervals fetches 99 bars, at most 499 (or no data yet) fetches
    499, anything longer is refused (NULL page_size)."""
    wm = F.col(watermark_col)
    gap, micros = _minutes_between(F.lit(now), wm), _micros_between(F.lit(now), wm)
    short = micros <= F.lit(SHORT_PAGE * int(interval_minutes) * _MINUTE)
    long_ = (micros <= F.lit(LONG_PAGE * int(interval_minutes) * _MINUTE)) | (wm == F.lit(SENTINEL_TIME))
    size = F.when(short, F.lit(SHORT_PAGE)).when(long_, F.lit(LONG_PAGE))
    return watermarks.withColumn("gap_minutes", gap).withColumn("page_size", size)


def remediation_needed(batches: DataFrame, interval_minutes: int, batch_col: str = "batch_time",
                       watermark_col: str = "watermark") -> DataFrame:
    """Flag batches that arrive more than one interval after the watermark (T3):
    those need a backfill instead of a plain append."""
    lag = _micros_between(F.col(batch_col), F.col(watermark_col))
    return batches.withColumn("needs_backfill", F.coalesce(lag > F.lit(int(interval_minutes) * _MINUTE), F.lit(True)))


def bar_batches(bars: DataFrame, interval_minutes: int) -> DataFrame:
    """Per bar its batch (close) time and the previous batch of the same symbol
    as watermark: the input ``remediation_needed`` expects."""
    x = bars.select("symbol", "open_time", batch_time("open_time", interval_minutes).alias("batch_time"))
    return with_neighbour(x, ["symbol"], "open_time", "watermark", "prev", value="batch_time")


def suspended_bars(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Drop bars inside per-symbol suspension windows [start, end].

    ``windows`` has (symbol, start, end); rows with start after end are ignored. Windows are cut to the
    time of the bars and exploded into days, and bars meet the windows of their own
    symbol and day only, so neither a symbol with thousands of windows nor one with a
    third of all bars is compared with all of the other side.
    """
    span = bars.agg(F.min("open_time").alias("_low"), F.max("open_time").alias("_high"))          # one row
    w = (windows.filter(F.col("start") <= F.col("end")).crossJoin(F.broadcast(span))
         .select(F.col("symbol").alias("_ws"), F.greatest("start", "_low").alias("_w0"), F.least("end", "_high").alias("_w1"))
         .filter(F.col("_w0") <= F.col("_w1"))
         .select("_ws", "_w0", "_w1", F.explode(F.sequence(F.to_date("_w0"), F.to_date("_w1"))).alias("_wd")))
    cond = ((F.col("symbol") == F.col("_ws")) & (F.to_date("open_time") == F.col("_wd"))
            & F.col("open_time").between(F.col("_w0"), F.col("_w1")))
    return bars.join(w, cond, "left_anti").select(*[c for c in bars.columns])


def idle_windows(bars: DataFrame, min_idle_minutes: int) -> DataFrame:
    """Stretches between consecutive traded bars longer than ``min_idle_minutes``
    as (symbol, start, end) windows, start/end exclusive of the traded bars."""
    traded = bars.filter(F.col("volume") > 0).select("symbol", "open_time")
    g = find_gaps(traded, min_idle_minutes)
    one = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    return g.select("symbol", (F.col("prev_open_time") + one).alias("start"), (F.col("open_time") - one).alias("end"))
