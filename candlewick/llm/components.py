"""Connected components of a link table by alternating star contraction.

Large-star / small-star (Kiveris et al., "Connected Components in MapReduce
and Beyond"): every round points each vertex at a smaller one through grouped
minima, until every edge leads from a vertex to its component's smallest
vertex. No group is ever collected; a hub's minimum is combined on the map
side and the join back on a hub is an ordinary shuffle join that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return (linked.union(low.select("u", F.col("low").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(vertex, root): every vertex of ``edges`` with its component's smallest vertex.

    Loops and repeated edges are allowed; edges with a null end are ignored;
    an empty table gives an empty result. Each round is written under the
    shared checkpoint folder, so a lost executor never replays earlier rounds.
    """
    spark = edges.sparkSession
    start = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
             .where(F.col("u").isNotNull() & F.col("v").isNotNull()))
    vertices, _ = written(start, "edges")
    now, path = written(_small_star(vertices.where(F.col("u") != F.col("v"))), "star")
    seen = _signature(now)
    while seen[0]:
        new, new_path = written(_small_star(_large_star(now)), "star")
        signature = _signature(new)
        drop(spark, path)
        now, path = new, new_path
        if signature == seen:
            break
        seen = signature
    loops = (vertices.select("u").union(vertices.select(F.col("v").alias("u"))).distinct()
             .join(now.select("u"), "u", "left_anti")
             .select(F.col("u").alias("vertex"), F.col("u").alias("root")))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(loops)
