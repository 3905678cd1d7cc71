"""Exact top-k search among binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is positive;
two vectors are as near as their codes differ in few bits (ties: smaller id).
A code is cut into segments of at most log2(number of codes) bits, so that a
probe meets a code on average, and every distinct code is indexed under each of its segments' values. A query probes
the segments' values at radius 0, then 1, and so on, segment by segment:
once all segments up to the j-th were probed at radius r (and the later ones
at r - 1), every code within ``segments * r + j`` bits has been met (pigeonhole),
so a query is done as soon as its k-th verified distance is no more than that.

A pair that several segments meet is verified once, by the first segment and
radius that meet it, so nothing has to be deduplicated; rounds only carry the
queries that are not done; pairs beyond a query's k-th distance are dropped
where they are verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import drop, written

TOP = 10
BITS = 64
QUERY_MODULUS = 20


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The vector's sign bits as a signed 64-bit number; missing and null values count
    as not positive."""
    weights = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)]
    return sum((F.when(F.get(vector, F.lit(i)) > 0, w).otherwise(F.lit(0).cast("long"))
                for i, w in enumerate(weights)), F.lit(0).cast("long"))


def _segments(codes: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    count = min(bits, max(1, math.ceil(bits / math.log2(max(2, codes)))))
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(code: Column, segment: tuple[int, int]) -> Column:
    shift, width = segment
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _flipped(probes: DataFrame, radius: int) -> DataFrame:
    """Every way to flip ``radius`` bits of ``value`` (``width`` bits), lowest bit first."""
    for i in range(1, radius + 1):
        lowest = F.lit(0) if i == 1 else F.col("bit") + 1
        probes = probes.withColumn("bit", F.explode(F.sequence(lowest, F.col("width") - (radius - i) - 1))) \
            .withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    return probes.drop("bit")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest codes of each query; Spark cuts each task's rows to k a query first."""
    order = Window.partitionBy("q").orderBy("distance", F.col("low").asc_nulls_last(), "code")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _first_meeting(segments: list[tuple[int, int]], radius: int) -> Column:
    """Whether no earlier probe met this pair: earlier segments differ in more than
    ``radius`` bits and later ones in no fewer."""
    out = F.lit(True)
    for j, segment in enumerate(segments):
        apart = F.bit_count(_part(F.col("q").bitwiseXOR(F.col("code")), segment))
        out &= F.when(F.col("segment") > j, apart > radius).otherwise(apart >= radius)
    return out


def top_codes(queries: DataFrame, index: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """(q, code, low, distance): for each distinct query code ``q`` the k nearest rows of
    ``index`` (code, low), by distance and then ``low``; all of them if there are fewer."""
    spark = index.sparkSession
    segments = _segments(index.count(), bits)
    count = len(segments)
    table = F.array(*[F.struct(F.lit(j).alias("segment"), F.lit(w).alias("width"), F.lit(s).alias("shift"))
                      for j, (s, w) in enumerate(segments)])

    def cut(code: str) -> Column:
        return F.expr(f"shiftrightunsigned({code}, shift) & (CASE WHEN width = 64 THEN -1L "
                      "ELSE shiftleft(1L, width) - 1 END)").alias("value")

    indexed, index_path = written(
        index.select("code", "low", F.inline(table)).select("segment", cut("code"), "code", "low"), "segments")
    # bound: the k-th distance met so far; beyond all bits while there are fewer than k hits
    best, best_path = written(queries.select(
        "q", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("low"),
        F.lit(bits + 1).alias("distance"), F.lit(1).alias("place"), F.lit(bits + 1).alias("bound")), "best")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done, radius, widest = [], 0, max(w for _, w in segments)
    while True:
        # dealt out evenly before each query is multiplied by its probes (by a hash of q: a
        # repartition by q itself would fold into the aggregate's and be coalesced)
        opened = best.groupBy("q").agg(F.first("bound").alias("bound")).repartition(spread, F.xxhash64("q"))
        probes = _flipped(
            opened.select("q", "bound", F.inline(table))
            .where((F.col("width") >= radius) & (count * radius + F.col("segment") <= F.col("bound")))
            .select("q", "bound", "segment", "width", cut("q")), radius).drop("width")
        # Spark cannot see how far the probes grow, so it must not broadcast them
        hits = (probes.join(indexed.hint("merge"), ["segment", "value"])
                .withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))))
                .where((F.col("distance") <= F.col("bound")) & _first_meeting(segments, radius))
                .select("q", "code", "low", "distance"))
        met = _best(best.select("q", "code", "low", "distance").union(hits), k)
        kth = Window.partitionBy("q")
        met = met.withColumn("bound", F.coalesce(F.max(F.when(F.col("place") == k, F.col("distance"))).over(kth),
                                                 F.lit(bits + 1)))
        met, met_path = written(met, "best")
        drop(spark, best_path)
        # all segments probed at this radius: every code within this many bits has been met
        proven = F.lit(bits + 1 if radius >= widest else count * (radius + 1) - 1)
        done.append(met.where(F.col("bound") <= proven))
        best, best_path = written(met.where(F.col("bound") > proven), "best")
        if best.isEmpty():
            break
        radius += 1
    drop(spark, index_path)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.where(F.col("code").isNotNull()).select("q", "code", "low", "distance")


def hamming_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP, vec_id: str = "vec_id",
                 vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for every row of ``queries`` the k rows of
    ``vectors`` whose codes are nearest, by distance and then id (null ids last).

    A row that is in both tables finds itself at distance zero. Null and short
    vectors have zero bits where values are missing, and queries with a null
    id have a null ``query_id``. Rows equal in id and code count once on
    either side. Vectors that share a code (a third of all rows, say) are one
    entry of the index with their k smallest ids, so no group is gathered.
    Other columns are not read; if either table is empty, so is the result;
    with fewer than k rows in all, all are returned.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), sign_code(F.col(vector), bits).alias("code")).distinct()
    asked, _ = written(queries.select(F.col(vec_id).alias("query_id"),
                                      sign_code(F.col(vector), bits).alias("q")).distinct(), "queries")
    by_id = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    members, _ = written(rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k), "members")
    index, _ = written(members.where("place = 1").select("code", F.col("id").alias("low")), "codes")
    near = top_codes(asked.select("q").distinct(), index, k, bits)
    ranked = (near.join(members.select("code", "id"), "code")
              .withColumn("rank", F.row_number().over(
                  Window.partitionBy("q").orderBy("distance", F.col("id").asc_nulls_last())))
              .where(F.col("rank") <= k))
    return (asked.join(ranked.select("q", "rank", F.col("id").alias("neighbor_id"), "distance"), "q")
            .select("query_id", "rank", "neighbor_id", "distance"))


def topk_of_every_20th(vectors: DataFrame, k: int = TOP) -> DataFrame:
    return hamming_topk(vectors, vectors.where(F.col("vec_id") % QUERY_MODULUS == 0), k)


ORACLE = f"""
WITH codes AS (SELECT DISTINCT vec_id, list_transform(range(1, {BITS} + 1), lambda i: coalesce(embedding[i] > 0, false)::INT) AS bits
  FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, {BITS} + 1), lambda i: abs(q.bits[i] - d.bits[i])))::INT AS distance
  FROM codes q, codes d WHERE q.vec_id % {QUERY_MODULUS} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id NULLS LAST)::INT AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= {TOP}
"""
