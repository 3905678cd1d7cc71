"""candlewick: candlestick (kline) bar pipelines on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
keeps its work in JVM-side expressions, so Catalyst can push filters into
Parquet scans, prune columns and plan two-phase aggregations.
"""

from candlewick.schema import BAR_COLUMNS, BAR_SCHEMA, RESAMPLED_COLUMNS  # noqa: F401
from candlewick.session import build_session, checkpoint_root  # noqa: F401

__all__ = ["BAR_COLUMNS", "BAR_SCHEMA", "RESAMPLED_COLUMNS", "build_session", "checkpoint_root"]
