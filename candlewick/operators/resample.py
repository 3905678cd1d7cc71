"""Resampling base bars to coarser intervals (the flagship read path).

Plan shape: one projection computes the bucket, then a two-phase
HashAggregate keyed by (symbol, bucket): a partial aggregate before the
shuffle and a final one after, so only one row per (symbol, bucket, map task)
crosses the network. A hot symbol spreads over its many buckets, so the
shuffle stays balanced. Completeness is a filter on the bar count.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.timegrid import bucket_start
from candlewick.schema import RESAMPLED_COLUMNS, SUM_COLUMNS

log = logging.getLogger(__name__)

VALUE_COLUMNS = [c for c in RESAMPLED_COLUMNS if c not in ("resample_time", "symbol")]


def required_bars(interval: int, base: int) -> int:
    """Bars a complete bucket holds. Floors like the source: base 5, interval 12 -> 2."""
    if interval <= 0 or base <= 0:
        raise ValueError("interval and base must be positive")
    if interval % base:
        log.warning("interval %s is not a multiple of base %s; complete buckets need %s bars",
                    interval, base, interval // base)
    return interval // base


def bucket_aggregates(time_col: str = "open_time") -> list:
    return [
        F.min_by("open", time_col).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time_col).alias("close"),
        *[F.sum(c).alias(c) for c in SUM_COLUMNS],
        # back to INT; under ANSI an overflow raises instead of wrapping
        F.sum("trade_num").cast("int").alias("trade_num"),
        # avg_price of the rolled-up bar is the first base bar's, not a re-computed mean
        F.min_by("avg_price", time_col).alias("avg_price"),
        F.count(time_col).alias("bar_count"),
    ]


def resample(bars: DataFrame, interval: int, offset: int = 0, base: int = 15,
             complete_only: bool = True, keep_count: bool = False) -> DataFrame:
    """Roll base bars up to ``interval`` minutes, buckets shifted by ``offset`` minutes.

    Per (symbol, bucket): open and avg_price of the first bar by time, close of
    the last, high max, low min, the volumes and trade count summed. Only
    complete buckets (``interval // base`` bars) survive unless
    ``complete_only`` is False. Filters on ``bars`` should be applied before
    this call so partial buckets at the range edges drop out.
    """
    need = required_bars(int(interval), int(base))
    keyed = bars.withColumn("resample_time", bucket_start("open_time", int(interval), int(offset)))
    out = keyed.groupBy("symbol", "resample_time").agg(*bucket_aggregates())
    if complete_only:
        out = out.filter(F.col("bar_count") == F.lit(need))
    cols = RESAMPLED_COLUMNS + (["bar_count"] if keep_count else [])
    return out.select(*cols)


def bucket_audit(bars: DataFrame, interval: int, offset: int = 0, base: int = 15) -> DataFrame:
    """Per symbol: buckets kept as complete and buckets dropped as partial."""
    need = required_bars(int(interval), int(base))
    per_bucket = resample(bars, interval, offset, base, complete_only=False, keep_count=True)
    complete = F.col("bar_count") == F.lit(need)
    return per_bucket.groupBy("symbol").agg(
        F.count_if(complete).alias("complete_buckets"),
        F.count_if(~complete).alias("partial_buckets"),
        F.sum("bar_count").alias("bars"),
    )


def merge_tiers(archive_resampled: DataFrame | None, recent_resampled: DataFrame | None) -> DataFrame | None:
    """One row per (symbol, resample_time); the recent tier wins every column.

    Both inputs are already aggregated, so the union is small. Precedence is
    explicit (priority 1 archive, 2 recent) and resolved per column with
    ``max_by``, which keeps the plan a hash aggregate.
    """
    parts = []
    if archive_resampled is not None:
        parts.append(archive_resampled.select(*RESAMPLED_COLUMNS, F.lit(1).alias("_priority")))
    if recent_resampled is not None:
        parts.append(recent_resampled.select(*RESAMPLED_COLUMNS, F.lit(2).alias("_priority")))
    if not parts:
        return None
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    merged = u.groupBy("symbol", "resample_time").agg(
        *[F.max_by(c, "_priority").alias(c) for c in VALUE_COLUMNS]
    )
    return merged.select(*RESAMPLED_COLUMNS)
