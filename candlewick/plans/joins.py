"""Intermediate tables under the shared checkpoint folder.

Joins of the library carry no broadcast decisions of their own: one plan for
every size, and AQE broadcasts or splits from the sizes it measures. Only joins of
bars with bars are sort merge joins throughout (``without_keys``): the planner takes
the bytes of a compressed file or of an exploded row for the size of the rows, which
may be a hundred times more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlewick.session import own_job, scratch_path


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Cut lineage: write ``df`` once as a Parquet table under the shared
    checkpoint folder and read it back. (A reliable ``checkpoint()`` computes
    its input twice, once for the action and once for the checkpoint files,
    unless the input is also cached.) The copy survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    with own_job(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def without_keys(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` are not in ``stored`` (both large): never a broadcast."""
    return rows.join(stored.select(*keys).hint("merge"), keys, "left_anti")
