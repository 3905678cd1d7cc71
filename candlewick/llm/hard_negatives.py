"""Hard negatives by segment summary filtering.

Vectors are scaled to integers, so scores (inner products) are exact. Each
vector is cut into 1, 4 and 16 segments, and of every segment its mean and its
deviation are stored. With d components in a segment,

    d (mean_x mean_y - dev_x dev_y) <= <x, y> <= d (mean_x mean_y + dev_x dev_y)

(the means' share is exact, the rest is Cauchy-Schwarz), and the sum over the
segments bounds the score of a pair. Pairs that may still be wanted are bounded
with the next finer segments; what the finest lets through is scored exactly.

Anchors are taken in blocks of a bounded number of bytes. A block is broadcast
and all rows pass it, in tasks that keep the best of each window (a range of
scores) of each anchor. A hash-drawn slice of the rows passes first: its k-th
best scores are lower bounds of the final ones, so the pass over all rows
starts with sharp bounds and returns few rows an anchor, however many tasks
there are. Positives have one window; an anchor's negatives have one for each
positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import drop, written
from candlewick.session import scratch_path

ANCHOR_MODULUS, FLIP_MODULUS, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative scores from 80 to 100 percent of its positive.
LOW, HIGH = 80, 100
SCALE = 256
#: Segments of the summary levels.
LEVELS = (1, 4, 16)
#: One row in so many passes first; bytes of an anchor block; pairs bounded at a time;
#: candidates held before the best are cut out.
SLICE_OF, BLOCK_BYTES, PAIRS, HELD = 16, 4 << 20, 1 << 20, 100_000
#: Below this share of open pairs they are bounded one by one, otherwise as a block.
SPARSE = 1 / 16
#: Scores stay below this, so that percentages of them fit in 64 bits.
MOST = 1 << 56

_ROW = "vec_id long, label int, tie string, x array<long>, summary array<double>"
_HIT = "anchor int, place int, score long, tie string, vec_id long"


def _cuts(size: int, segments: int) -> np.ndarray:
    """Where segments begin and the last one ends; those of a finer level nest in a coarser one's."""
    segments = max(1, min(size, segments))
    return size * np.arange(segments + 1) // segments


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row the means of its segments, then their deviations, each times the
    square root of the segment's size: a bound is then a plain sum of products."""
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    edges, x = _cuts(x.shape[1], segments), x.astype(np.float64)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(spread)])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


@dataclass
class Rows:
    """Vectors with their stored summaries."""
    vec_id: pa.Array
    label: np.ndarray
    tie: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]
    norm: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table) -> Rows:
        columns = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                   for n, c in zip(batch.schema.names, batch.columns)}
        x, stored = (_matrix(columns[n]) for n in ("x", "summary"))
        levels, at = [], 0
        for segments in LEVELS:
            width = 2 * max(1, min(x.shape[1], segments))
            levels.append(stored[:, at:at + width])
            at += width
        return cls(columns["vec_id"], columns["label"].to_numpy(), columns["tie"].to_numpy(zero_copy_only=False).astype("S"),
                   x, levels, np.sqrt((levels[0] ** 2).sum(1)))


@dataclass
class Block:
    """Anchors and what their windows are open for: scores from ``low`` to ``high`` (anchors x windows)
    of the same label or of any other one."""
    rows: Rows
    same: bool
    low: np.ndarray
    high: np.ndarray
    keep: int


def _scores(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Exact inner products; in floating point where every sum stays below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if top < 1 << 53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return (a @ b.T if whole else np.einsum("ij,ij->i", a, b)).astype(np.int64)


def _possible(block: Block, low: np.ndarray, rows: Rows, at: np.ndarray, row: np.ndarray,
              level: int, whole: bool) -> np.ndarray:
    """Whether a level's bounds let pairs into any window of their anchor: all of ``at`` with all
    of ``row`` (``whole``), or one with one."""
    a, b = block.rows.levels[level][at], rows.levels[level][row]
    half = a.shape[1] // 2
    if whole:
        mean, spread = a[:, :half] @ b[:, :half].T, a[:, half:] @ b[:, half:].T
        size = block.rows.norm[at][:, None] * rows.norm[row]
    else:
        mean, spread = (np.einsum("ij,ij->i", a[:, s], b[:, s]) for s in (slice(half), slice(half, None)))
        size = block.rows.norm[at] * rows.norm[row]
    spread += 0.5 + 1e-12 * size                              # scores are integers; rounding is far below
    upper, lower, out = mean + spread, mean - spread, np.zeros(mean.shape, bool)
    for w in range(low.shape[1]):
        lo, hi = low[at, w], block.high[at, w]
        out |= (upper >= (lo[:, None] if whole else lo)) & (lower <= (hi[:, None] if whole else hi))
    return out


def _open_pairs(block: Block, low: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs that every level of summaries lets through."""
    at, row = np.flatnonzero((low <= block.high).any(1)), np.arange(len(rows.label))
    alive = (block.rows.label[at][:, None] == rows.label) == block.same
    for level in range(len(LEVELS)):
        a, r = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        at, row, alive = at[a], row[r], alive[np.ix_(a, r)]
        if alive.sum() < SPARSE * alive.size or not alive.size:
            i, j = np.nonzero(alive)
            i, j = at[i], row[j]
            for finer in range(level, len(LEVELS)):
                held = _possible(block, low, rows, i, j, finer, False)
                i, j = i[held], j[held]
            return i, j, _scores(block.rows.x[i], rows.x[j], False)
        alive &= _possible(block, low, rows, at, row, level, True)
    i, j = np.nonzero(alive)
    if len(i) < SPARSE * alive.size:
        return at[i], row[j], _scores(block.rows.x[at[i]], rows.x[row[j]], False)
    return at[i], row[j], _scores(block.rows.x[at], rows.x[row], True)[i, j]


class _Best:
    """The best candidates so far of each window, and the least score that still counts in it."""

    def __init__(self, block: Block):
        self.block, self.low = block, block.low.copy()
        self.hits, self.new = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "S1"), np.zeros(0, object)], []

    def add(self, batch: Rows, ids: np.ndarray, at: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        other = batch.tie[row] != self.block.rows.tie[at]                # an anchor is no candidate of its own
        for w in range(self.low.shape[1]):
            held = np.flatnonzero(other & (score >= self.low[at, w]) & (score <= self.block.high[at, w]))
            self.new.append([at[held] * self.low.shape[1] + w, score[held], batch.tie[row[held]], ids[row[held]]])
        if sum(len(n[0]) for n in self.new) > HELD:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """Each window's best, in order; full windows raise their least score."""
        window, score, tie, ids = (np.concatenate(c) for c in zip(self.hits, *self.new))
        order = np.lexsort((tie, -score, window))
        window = window[order]
        begins = np.flatnonzero(np.diff(window, prepend=-1))
        place = np.arange(len(window)) - np.repeat(begins, np.diff(np.append(begins, len(window))))
        best = order[place < self.block.keep]
        last = order[place == self.block.keep - 1]
        self.hits, self.new = [window[place < self.block.keep], score[best], tie[best], ids[best]], []
        full = window[place == self.block.keep - 1]
        self.low.ravel()[full] = np.maximum(self.low.ravel()[full], score[last])      # ties may win by id
        return self.hits


def _search(shared):
    """Task code: the best rows of a task for each window of the broadcast block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best, windows = _Best(block), block.low.shape[1]
        step = max(1, PAIRS // max(1, len(block.rows.label)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = Rows.read(batch.slice(start, step))
                ids = np.array(rows.vec_id.to_pylist(), object)
                best.add(rows, ids, *_open_pairs(block, best.low, rows))
        window, score, tie, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array((window // windows).astype(np.int32)), pa.array((window % windows).astype(np.int32)),
             pa.array(score), pa.array([t.decode() for t in tie], pa.string()), pa.array(ids, pa.int64())],
            ["anchor", "place", "score", "tie", "vec_id"])
    return run


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the summaries of all levels."""
    for batch in batches:
        x = _matrix(batch.column("x"))
        stored = np.hstack([summary(x, s) for s in LEVELS])
        ends = np.arange(0, stored.size + 1, stored.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(stored.ravel()))],
                                         ["vec_id", "label", "tie", "x", "summary"])


def _hex(value: Column) -> Column:
    """16 hex digits in the order of signed numbers."""
    return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def scaled_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, tie, x): usable rows, scaled, each distinct one once. ``tie`` orders them by
    vec_id (null last), then label and vector; shorter vectors are filled up with zeros."""
    number, x = F.col("vec_id"), F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
                          F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull()
                      & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.withColumn("label", F.when(number % FLIP_MODULUS == 0, (F.col("label") + 1) % LABELS)
                           .otherwise(F.col("label")))
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    tie = F.concat(F.when(number.isNull(), "1").otherwise("0"), _hex(F.coalesce(number, F.lit(0))),
                   _hex(F.col("label")), F.lpad(F.hex(F.xxhash64("x")), 16, "0"))
    return rows.withColumn("x", filled).distinct().select("vec_id", "label", tie.alias("tie"), "x")


def _best_of(rows: DataFrame, block: Block, spark: SparkSession) -> DataFrame:
    """(anchor, place, score, tie, vec_id, rank): the best of each window among ``rows``."""
    hits = rows.select("vec_id", "label", "tie", "x", "summary").mapInArrow(_search(spark.sparkContext.broadcast(block)), _HIT)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "tie")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.keep)


def _raised(block: Block, part: DataFrame, spark: SparkSession) -> Block:
    """The block with each window's least score raised to the k-th best in ``part``."""
    low = block.low.copy()
    found = _best_of(part, block, spark).where(F.col("rank") == block.keep).select("anchor", "place", "score").toArrow()
    at = found["anchor"].to_numpy(), found["place"].to_numpy()
    low[at] = np.maximum(low[at], found["score"].to_numpy())
    return Block(block.rows, block.same, low, block.high, block.keep)


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by 100; each has its best five
    other rows of the same label as positives, and for each of these the best five
    rows of other labels that score 80 to 100 percent of it (none if it scores
    below zero). Order: score, then smaller id.

    Rows with a null label or vector or a null or non-finite component take no
    part; a null id is no anchor and comes last in ties. Rows that are equal in
    all three columns count once; rows that share an id only are different rows.
    Missing components of shorter vectors are zero. Scores that may pass 56 bits
    raise. Other columns are not read; an empty table gives an empty result.
    A label that holds a third of all rows needs no care: rows stay where they
    are, and each task returns at most five a window.
    """
    spark = vectors.sparkSession
    plain, plain_path = written(scaled_rows(vectors, vec_id, vector, label), "scaled")
    path = scratch_path(spark, "summaries")
    first = F.pmod(F.xxhash64("tie"), F.lit(SLICE_OF)) == 0
    # every task gets an even share of the rows, in an order that labels have no part in
    (plain.repartition(F.col("tie")).mapInArrow(_store, _ROW).withColumn("first", first.cast("int"))
     .write.partitionBy("first").parquet(path))
    rows = spark.read.schema(_ROW + ", first int").parquet(path)
    drop(spark, plain_path)
    anchors = rows.where(F.col("vec_id") % ANCHOR_MODULUS == 0)
    count, width, top, low = rows.agg(F.count_if(F.col("vec_id") % ANCHOR_MODULUS == 0), F.max(F.size("x")),
                                      F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    if width and width * max(top, -low) ** 2 >= MOST:
        raise ValueError("an inner product may pass 56 bits")
    blocks = -(-count * 3 * 8 * max(1, width or 0) // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        of_block = Rows.read(anchors.where(F.pmod(F.xxhash64(F.lit("block"), "tie"), F.lit(blocks)) == b)
                             .drop("first").orderBy("tie").toArrow())
        size = len(of_block.label)
        everything = Block(of_block, True, np.full((size, 1), -MOST), np.full((size, 1), MOST), POSITIVES)
        everything = _raised(everything, rows.where("first = 1"), spark)
        near = _best_of(rows, everything, spark).toArrow()               # five an anchor at most
        near = near.append_column("positive", near["vec_id"]).select(["anchor", "rank", "score", "positive"])
        low, high = np.full((size, POSITIVES), MOST), np.full((size, POSITIVES), -MOST)
        at = near["anchor"].to_numpy(), near["rank"].to_numpy() - 1
        score = near["score"].to_numpy()
        low[at], high[at] = -(-LOW * score // 100), HIGH * score // 100
        windows = _raised(Block(of_block, False, low, high, NEGATIVES), rows.where("first = 1"), spark)
        near = near.append_column("anchor_id", of_block.vec_id.take(near["anchor"]))
        found = (_best_of(rows, windows, spark)
                 .join(F.broadcast(spark.createDataFrame(near)
                                   .select("anchor", (F.col("rank") - 1).cast("int").alias("place"), "positive",
                                           F.col("score").alias("positive_score"), "anchor_id")), ["anchor", "place"])
                 .select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                         F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        found, _ = written(found, "negatives")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
    drop(spark, path)
    return out


ORACLE = f"""
WITH rows AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {FLIP_MODULUS} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
anchors AS (SELECT * FROM rows WHERE vec_id % {ANCHOR_MODULUS} = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
    list_dot_product(a.x, r.x)::BIGINT AS score FROM anchors a, rows r WHERE a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
ranked AS (SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
