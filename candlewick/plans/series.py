"""Previous/next element of a time series without one task per series.

``Window.partitionBy(symbol)`` sends every bar of a symbol to one task; a hot
symbol holding a third of all rows would then sort a third of the data in a
single task. ``with_neighbour`` windows over (keys, day) instead, which
bounds a partition by one day of one symbol.

Day edges are handled without a join of the big table: a per-(keys, day)
summary (one row per symbol-day) is windowed per symbol over days to find
the value the neighbouring day contributes, and that value enters the
(keys, day) window as one sentinel row per day, placed just before the
day's first row (``prev``) or just after its last row (``next``). The big
table is shuffled once, for the window; only the small summary is shuffled
besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _one_micro():
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001).cast("decimal(18,6)"))


def with_neighbour(df: DataFrame, keys: list[str], ts: str, out: str, direction: str = "prev",
                   value: str | None = None) -> DataFrame:
    """Add ``out`` = the ``value`` column (default ``ts``) of the previous
    (``direction='prev'``) or next (``'next'``) row of the same ``keys`` by ``ts``.

    Equals ``lag``/``lead`` over ``partitionBy(keys).orderBy(ts)`` when ``ts``
    is unique per key.
    """
    if direction not in ("prev", "next"):
        raise ValueError("direction must be 'prev' or 'next'")
    value = value or ts
    prev = direction == "prev"
    chunk, real, val = "_nb_day", "_nb_real", "_nb_val"
    ts_type = df.schema[ts].dataType

    x = df.withColumn(chunk, F.to_date(F.col(ts))).withColumn(real, F.lit(True)).withColumn(val, F.col(value))

    edge = F.max_by(F.col(value), F.col(ts)) if prev else F.min_by(F.col(value), F.col(ts))
    days = df.groupBy(*keys, F.to_date(F.col(ts)).alias(chunk)).agg(edge.alias("_nb_edge"))
    dw = Window.partitionBy(*keys).orderBy(chunk)
    carry = (F.lag if prev else F.lead)("_nb_edge").over(dw)
    day_start = F.to_timestamp_ntz(F.col(chunk))
    at = day_start - _one_micro() if prev else F.to_timestamp_ntz(F.date_add(F.col(chunk), 1))
    sentinels = days.select(*keys, chunk, carry.alias(val), at.cast(ts_type).alias(ts), F.lit(False).alias(real))

    u = x.unionByName(sentinels, allowMissingColumns=True)
    w = Window.partitionBy(*keys, chunk).orderBy(ts)
    u = u.withColumn(out, (F.lag if prev else F.lead)(val).over(w))
    return u.filter(F.col(real)).drop(chunk, real, val)
