"""Scalar clean-ups used by the parsers (JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def avg_price(quote_volume="quote_volume", volume="volume") -> Column:
    """quote_volume / volume; NULL for a zero-volume bar (no error under ANSI)."""
    return F.try_divide(_col(quote_volume), _col(volume))


def epoch_to_time(epoch_text) -> Column:
    """Epoch text to TIMESTAMP_NTZ: the first 13 digits are read as milliseconds,
    so microsecond stamps and millisecond stamps land on the same instant."""
    ms = F.substring(_col(epoch_text).cast("string"), 1, 13).cast("bigint")
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def coerce_double(c) -> Column:
    """Numeric text to DOUBLE; anything unparsable becomes NULL."""
    return _col(c).try_cast("double")


def has_permission(permission_sets, name: str) -> Column:
    """True when any inner permission list contains ``name``."""
    return F.coalesce(
        F.exists(_col(permission_sets), lambda s: F.array_contains(s, F.lit(name))), F.lit(False)
    )


def filter_field(filters, filter_type: str, field: str) -> Column:
    """``field`` of the first element of ``filters`` whose filterType matches, else NULL."""
    hit = F.filter(_col(filters), lambda f: f["filterType"] == F.lit(filter_type))
    return F.get(hit, 0)[field]


def strip_zeros(decimal_text) -> Column:
    """'1.2300' -> '1.23', '5.000' -> '5', '100' stays '100'."""
    t = _col(decimal_text)
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
