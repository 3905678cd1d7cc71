"""Global running sums over an ordered table without a single-task window.

The table is range-partitioned on the order and written with its partition
number; per-partition totals (one row a partition) give every partition its
offset; a window inside each partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import fresh, written


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` plus ``sums``: new column -> column whose exclusive running sum it holds
    (the sum over all rows before the row in ``order``). Nulls count as zero.

    Rows equal in ``order`` are told apart by a random tie-breaker that is
    written before use, so that even rows which are all equal spread over the
    partitions; any order among them is as good as another.
    """
    tie, part = fresh(df, "tie"), fresh(df, "part")
    ranged, _ = written(df.withColumn(tie, F.rand(11))
                        .transform(lambda d: written(d, "ties")[0])
                        .repartitionByRange(*order, F.col(tie))
                        .withColumn(part, F.spark_partition_id()), "ranged")
    by_part = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(new) for new, c in sums.items()])
    # one row a partition
    offsets = totals.select(part, *[F.coalesce(F.sum(new).over(by_part), F.lit(0)).alias(new) for new in sums])
    before = Window.partitionBy(part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets), part)
            .withColumns({new: F.col(new) + F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0))
                          for new, c in sums.items()})
            .drop(tie, part))
