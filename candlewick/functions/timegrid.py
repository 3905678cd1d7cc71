"""Time-grid expressions: bar buckets, run boundaries and the archive calendar.

All helpers return ``Column`` expressions (JVM-side, codegen friendly) except
``parse_interval`` which validates plan-time parameters.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick.schema import PERIOD_ANCHOR

_INTERVAL_RE = re.compile(r"^\s*(\d+)\s*([mThH])\s*$")


def parse_interval(text: str) -> _dt.timedelta:
    """'15m' / '15T' -> 15 minutes, '1h' / '1H' -> 1 hour; anything else raises."""
    m = _INTERVAL_RE.match(str(text))
    if not m:
        raise ValueError(f"interval {text!r}: expected <n>m, <n>T, <n>h or <n>H")
    n, unit = int(m.group(1)), m.group(2)
    return _dt.timedelta(minutes=n) if unit in "mT" else _dt.timedelta(hours=n)


def minutes_of(text_or_minutes) -> int:
    if isinstance(text_or_minutes, int):
        return text_or_minutes
    return int(parse_interval(text_or_minutes).total_seconds() // 60)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_start(ts, interval_minutes: int, offset_minutes: int = 0) -> Column:
    """Start of the ``interval``-minute bucket holding ``ts``, buckets shifted by ``offset``.

    Equal to "truncate to the minute, then step back (minute(ts - offset) mod
    interval) minutes" whenever the interval divides an hour. A tumbling
    ``window`` keeps TIMESTAMP_NTZ input as NTZ and plans as a projection.
    """
    iv = int(interval_minutes)
    off = int(offset_minutes) % iv
    return F.window(_col(ts), f"{iv} minutes", f"{iv} minutes", f"{off} minutes").start


def batch_time(open_time, interval_minutes: int) -> Column:
    """Close time of a bar: the batch a streamed bar belongs to."""
    return _col(open_time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(interval_minutes)))


def next_boundary(ts, interval_minutes: int) -> Column:
    """Next multiple of ``interval`` counted from midnight, strictly after ``ts``.

    The grid restarts at every midnight, so an interval that does not divide a
    day is cut at the next midnight.
    """
    t = _col(ts)
    iv = int(interval_minutes) * 60
    day = F.to_timestamp_ntz(F.to_date(t))
    # seconds since midnight of the minute holding ts
    secs = F.hour(t) * 3600 + F.minute(t) * 60
    nxt = day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.floor(secs / iv) + 1) * iv).cast("decimal(18,6)"))
    midnight = day + F.make_dt_interval(F.lit(1))
    return F.least(nxt, midnight)


def _months_since(d: Column, anchor: _dt.date) -> Column:
    return (F.year(d) - anchor.year) * 12 + (F.month(d) - anchor.month)


def period_start(ts, period_months: int = 1, anchor: _dt.date = PERIOD_ANCHOR) -> Column:
    """First day (DATE) of the archive period holding ``ts``; periods of p months from ``anchor``."""
    p = int(period_months)
    if 12 % p:
        raise ValueError("period_months must divide 12")
    d = F.to_date(_col(ts))
    k = F.floor(_months_since(d, anchor) / p) * p
    return F.add_months(F.lit(anchor.replace(day=1)), k.cast("int"))


def period_label(ts, period_months: int = 1, anchor: _dt.date = PERIOD_ANCHOR) -> Column:
    """'YYYY-MM' label of the period holding ``ts`` (the ``period`` partition value)."""
    return F.date_format(period_start(ts, period_months, anchor), "yyyy-MM")


def period_cutoff(now, days_before: int, period_months: int = 1, start: _dt.date = PERIOD_ANCHOR) -> Column:
    """Start of the period boundary at or before ``now - days_before``.

    Every archive period ending at or before this date is complete and never
    receives bars again.
    """
    p = int(period_months)
    d = F.to_date(_col(now)) - F.lit(int(days_before))
    k = F.floor(_months_since(d, start) / p) * p
    return F.add_months(F.lit(start.replace(day=1)), k.cast("int"))


def latest_complete_period(ts, period_months: int = 1, start: _dt.date = PERIOD_ANCHOR) -> Column:
    """Struct(period_start DATE, period_end DATE exclusive) of the last closed period.

    A date exactly on a period boundary (first day of its first month) steps
    back one more period. Dates before ``start`` or with no closed period give
    NULL.
    """
    p = int(period_months)
    d = F.to_date(_col(ts))
    months = _months_since(d, start)
    on_boundary = (F.pmod(months, F.lit(p)) == 0) & (F.dayofmonth(d) == 1)
    k = F.floor(months / p) - 1 - F.when(on_boundary, 1).otherwise(0)
    first = F.add_months(F.lit(start.replace(day=1)), (k * p).cast("int"))
    value = F.struct(first.alias("period_start"), F.add_months(first, p).alias("period_end"))
    return F.when((d >= F.lit(start)) & (k >= 0), value)


def period_list(first, last, period_months: int = 1, anchor: _dt.date = PERIOD_ANCHOR) -> Column:
    """Array of struct(label, period_start DATE, period_end DATE exclusive): the archive
    periods from the one holding ``first`` to the one holding ``last``; the
    first one starts at the first day of ``first``'s month, not before."""
    p = int(period_months)
    month = F.trunc(F.to_date(_col(first)), "month")
    starts = F.sequence(period_start(first, p, anchor), period_start(last, p, anchor), F.expr(f"INTERVAL {p} MONTHS"))
    return F.transform(starts, lambda s: F.struct(
        F.date_format(s, "yyyy-MM").alias("label"), F.greatest(s, month).alias("period_start"),
        F.add_months(s, p).alias("period_end")))
