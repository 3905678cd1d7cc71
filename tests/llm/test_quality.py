import numpy as np

from candlewick.llm import quality
from candlewick.llm.quality import estimate_prior, features, score_quality, train

SF = "/root/testdata/sf0.1"


def test_features():
    for text in (None, "", " \n\t "):
        assert not features(text).any()
    x = features("Ab ab ab\nab!\nab!")
    assert len(x) == quality.N_FEATURES and np.isfinite(x).all()
    assert np.isfinite(features("x" * 200_000)).all() and np.isfinite(features("word " * 50_000)).all()
    assert np.array_equal(features("a b"), features("a b"))


def clouds(rng, n, share):
    good = rng.random(n) < share
    x = rng.normal(size=(n, quality.N_FEATURES))
    x[good, 0] += 4
    return x, good


def test_prior_and_risk_without_negatives():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        unl, good = clouds(rng, 4000, share)
        pos = clouds(rng, 3000, 1.0)[0]
        assert abs(estimate_prior(pos, unl) - share) < 0.08
        fresh, truth = clouds(rng, 3000, share)
        right = (train(pos, unl).logits(fresh) > 0) == truth
        assert right.mean() > 0.88


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2), (1, None, 2), (None, "", 1), (3, "x " * 5000, None)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1), (3, 1)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    assert score_quality(docs.limit(0), labels).count() == 0


def plain_risk(rows_p, rows_u, w, prior):
    """(objective whose gradient is stepped along, whether it is the negated one), row by row."""
    import math
    a, b, c, d = w
    hidden = len(b)

    def z(x):
        return sum(c[j] * math.tanh(sum(x[i] * a[i][j] for i in range(len(x))) + b[j]) for j in range(hidden)) + d

    def soft(v):
        return max(v, 0) + math.log1p(math.exp(-abs(v)))

    zp, zu = [z(x) for x in rows_p], [z(x) for x in rows_u]
    as_positive = sum(soft(-v) for v in zp) / len(zp)
    unlabelled = sum(soft(v) for v in zu) / len(zu)
    if prior is None:
        return unlabelled + as_positive
    negative = unlabelled - prior * sum(soft(v) for v in zp) / len(zp)
    return negative + prior * as_positive if negative >= 0 else -negative


def slow_fit(pos, unl, prior, hidden, epochs, batch, rate=0.01, decay=1e-4, seed=5):
    """The same minimisation with plain lists and gradients by differences."""
    import math
    rng, n = np.random.default_rng(seed), pos.shape[1]
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    pos, unl = ((pos - mean) / scale).tolist(), ((unl - mean) / scale).tolist()
    flat = [*rng.normal(0, 1 / math.sqrt(n), (n, hidden)).ravel(), *[0.0] * hidden, *rng.normal(0, 1 / math.sqrt(hidden), hidden), 0.0]

    def shaped(v):
        return [v[i * hidden:(i + 1) * hidden] for i in range(n)], v[n * hidden:(n + 1) * hidden], v[(n + 1) * hidden:-1], v[-1]

    first, second, step, rounds = [0.0] * len(flat), [0.0] * len(flat), 0, max(1, len(unl) // batch)
    for epoch in range(epochs):
        slow = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        ps, us = np.array_split(rng.permutation(len(pos)), rounds), np.array_split(rng.permutation(len(unl)), rounds)
        for p_at, u_at in zip(ps, us):
            xp, xu, grads = [pos[i] for i in p_at], [unl[i] for i in u_at], []
            for k in range(len(flat)):
                up, down = flat.copy(), flat.copy()
                up[k] += 1e-5
                down[k] -= 1e-5
                grad = (plain_risk(xp, xu, shaped(up), prior) - plain_risk(xp, xu, shaped(down), prior)) / 2e-5
                held = k < n * hidden or (n + 1) * hidden <= k < len(flat) - 1
                grads.append(grad + (decay * flat[k] if held else 0))
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                flat[k] -= slow * (first[k] / (1 - 0.9 ** step)) / (math.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return flat


def test_risk_against_plain_python():
    rng = np.random.default_rng(8)
    pos, unl = rng.normal(1, 1, (12, 3)), rng.normal(0, 1, (24, 3))
    turned = 0
    for prior in (None, 0.4, 0.95):                    # at 0.95 the risk estimate falls below zero
        net = quality._fit(pos, unl, prior, hidden=2, epochs=4, batch=8)
        got = np.concatenate([np.ravel(w) for w in net.weights])
        want = slow_fit(pos, unl, prior, 2, 4, 8)
        assert np.allclose(got, want, atol=1e-4), prior
        turned += 1
    assert turned == 3


def test_prior_against_plain_python(monkeypatch):
    """Best bin by counting, with an ordering that is the first feature."""
    class First:
        def logits(self, x):
            return x[:, 0]

    monkeypatch.setattr(quality, "_fit", lambda *a, **k: First())
    rng = np.random.default_rng(4)
    pos = rng.normal(2, 1, (200, 2))
    unl = np.concatenate([rng.normal(2, 1, (120, 2)), rng.normal(-1, 1, (280, 2))])[rng.permutation(400)]
    p, u = sorted(pos[1::2, 0]), sorted(unl[1::2, 0])
    slack = (np.log(40) / 2) ** 0.5 * (len(p) ** -0.5 + len(u) ** -0.5)
    best = None
    for k in range(181):
        cut = float(np.quantile(p, 0.9 * k / 180))
        share_p, share_u = sum(v >= cut for v in p) / len(p), sum(v >= cut for v in u) / len(u)
        if best is None or (share_u + slack) / share_p < best[0]:
            best = ((share_u + slack) / share_p, share_u / share_p)
    assert abs(quality.estimate_prior(pos, unl) - best[1]) < 1e-9 and 0.2 < best[1] < 0.4
