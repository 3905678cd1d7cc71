import math
import random

import numpy as np
import pytest

from candlewick.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        row = (vec_id, label, tuple(math.floor(256 * float(np.float32(v))) for v in vector))
        if row not in usable:
            usable.append(row)

    def best(anchor, candidates, keep):
        scored = [(-sum(a * b for a, b in zip(anchor[2], c[2])), c[0] is None, c[0] or 0, c[1], c) for c in candidates]
        return [(-s, c) for s, _, _, _, c in sorted(scored, key=lambda t: t[:4])[:keep]]

    out = []
    for anchor in usable:
        if anchor[0] is None or anchor[0] % 100:
            continue
        others = [r for r in usable if r != anchor]
        for score, positive in best(anchor, [r for r in others if r[1] == anchor[1]], 5):
            wanted = [(s, c) for s, c in best(anchor, [r for r in others if r[1] != anchor[1]], len(others))
                      if 80 * score <= 100 * s <= 100 * score][:5]
            out += [(anchor[0], positive[0], rank, c[0], score, s) for rank, (s, c) in enumerate(wanted, 1)]
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def cloud(seed, count, width, step, labels=3):
    """Clusters a label, components on a grid of ``step`` (coarse grids make ties)."""
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(count):
        label = 0 if rng.random() < 0.34 else rng.randrange(labels)
        rows.append((i * 4 if i % 3 else i * 25, [round((c + rng.gauss(0, 1)) / step) * step for c in centre[label]], label))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("seed,width,step", [(1, 64, 0.01), (2, 5, 0.5), (3, 1, 1.0), (4, 17, 0.25)])
def test_equals_brute_force(spark, seed, width, step):
    rows = cloud(seed, 250, width, step)
    assert got(spark, rows) == brute(rows)


def test_blocks_slices_and_early_cuts(spark, monkeypatch):
    rows = cloud(9, 300, 16, 0.1)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 5000)
    assert got(spark, rows) == brute(rows)


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (60, 50))
    for segments in (1, 4, 16, 50):
        s = hn.summary(x, segments)
        half = s.shape[1] // 2
        mean, spread = s[:, :half] @ s[:, :half].T, s[:, half:] @ s[:, half:].T
        assert (np.abs(x @ x.T - mean) <= spread + 1e-6).all()
        width = spread.mean()
        assert segments == 1 or width <= last + 1e-6
        last = width
    assert last < 1e-6                                   # a segment a component leaves no deviation


def test_summaries_filter_pairs(spark):
    """On vectors of different levels the bounds leave few pairs to be scored."""
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(-3, 4, (2000, 64)), axis=1) + rng.integers(-200, 200, (2000, 1))
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    rows = hn.Rows(None, np.arange(2000) % 5, np.arange(2000).astype("S8"), x, [hn.summary(x, s) for s in hn.LEVELS], norm)
    some = hn.Rows(None, rows.label[:20], rows.tie[:20], x[:20], [v[:20] for v in rows.levels], norm[:20])
    exact = x[:20] @ x.T
    kth = np.sort(np.where(some.label[:, None] == rows.label, exact, -(1 << 56)), axis=1)[:, -6:-5]
    block = hn.Block(some, True, kth, np.full((20, 1), hn.MOST), 5)
    at, row, score = hn._open_pairs(block, block.low, rows)
    assert (score == exact[at, row]).all()
    assert {(a, r) for a, r, s in zip(at, row, score) if s >= kth[a, 0]} == \
        {(a, r) for a in range(20) for r in range(2000) if rows.label[a] == rows.label[r] and exact[a, r] >= kth[a, 0]}
    assert len(at) < 0.1 * 20 * 400


def test_odd_rows(spark):
    rows = cloud(4, 60, 4, 0.5) + [
        (None, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 1), (100, None, 1), (200, [1.0], None),
        (300, [float("nan")] * 4, 0), (400, [float("inf"), 0.0, 0.0, 0.0], 0), (500, [None, 1.0, 1.0, 1.0], 2),
        (600, [2.0], 0), (700, [], 1), (800, [1.5, 0.5], 2), (0, [1.0, 1.0, 1.0, 1.0], 0), (0, [1.0, 1.0, 1.0, 1.0], 0)]
    assert got(spark, rows + rows[:30]) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 0)]) == [] and got(spark, [(100, [], 0), (1, [], 0), (2, [], 1)])
    extra = spark.createDataFrame([(100, [1.0], 0, 1, 2, "t"), (101, [1.0], 0, 1, 2, "t"), (102, [0.9], 1, 1, 2, "t")],
                                  SCHEMA + ", rank int, score long, tie string")
    assert [tuple(r)[:4] for r in hn.hard_negatives(extra).collect()] == [(100, 101, 1, 102)]


def test_scores_too_large_raise(spark):
    with pytest.raises(Exception, match="56 bits"):
        got(spark, [(100, [1e20], 0), (101, [1e20], 0)])
