"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web text train a small
network; negative labels are never used. The class prior of the unlabelled
text is estimated first: a positive-against-unlabelled model orders held-back
texts, and the smallest ratio of unlabelled to positive mass above any of its
thresholds bounds the share of positives (best-bin estimation, Garg et al.
2021). The network then minimises the non-negative unbiased risk (Kiryo et
al. 2017) with the logistic loss: prior * risk of positives as positive, plus
the risk of unlabelled text as negative less what positives among it must
contribute, never below zero. With that loss the score estimates the
probability of label 1.

Texts are described by about twenty proportions of their whole content, so a
score depends on the text alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import doc_remainder

#: Trusted positives and unlabelled texts that training reads at most (lowest id hash first).
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 6000, 9000
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
THRESHOLD = 0.7

_KIND = np.zeros(256, np.int64)                         # 0 other, then the groups below
for _group, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c",
                                 b"\n", b".,;:?'\"", b"!", b"|", b"-_/()[]{}<>", b"#$%&*+=@\\^`~", bytes(range(128, 256))), 1):
    _KIND[list(_chars)] = _group
_GROUPS = 12


def features(text: str | None) -> np.ndarray:
    """Proportions that describe a whole text; all zero for null, empty and wordless text."""
    words = (text or "").split()
    if not words:
        return np.zeros(N_FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(_KIND[raw], minlength=_GROUPS) / len(raw)
    n = len(words)
    counts = Counter(words)
    top = max(counts.values())
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    marked = sum(not w[-1].isalnum() for w in words)
    return np.array([
        *np.sqrt(shares), np.log1p(n) / 10, len(counts) / n, len(counts) / n ** 0.8, top / n, again / n,
        lengths.mean() / 10, lengths.std() / 10, min(1.0, lengths.max() / 100), (lengths <= 2).mean(),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, marked / n,
        sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n])


N_FEATURES = _GROUPS + 14


@dataclass
class Network:
    """One hidden layer over standardised features."""
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.stack([features(t) for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _softplus(z):
    return np.logaddexp(0.0, z)


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 60,
         batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the non-negative PU risk; without a prior on plain positive-against-unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    weights = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), np.zeros(hidden),
               rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = max(1, len(unl) // batch)
    for epoch in range(epochs):
        slow = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        p_rows, u_rows = np.array_split(rng.permutation(len(pos)), rounds), np.array_split(rng.permutation(len(unl)), rounds)
        for p_at, u_at in zip(p_rows, u_rows):
            if not len(p_at) or not len(u_at):
                continue
            x = np.concatenate([pos[p_at], unl[u_at]])
            h = np.tanh(x @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3]
            zp, zu, d = z[:len(p_at)], z[len(p_at):], np.zeros(len(x))
            share = prior if prior is not None else 0.0
            as_negative = _softplus(zu).mean() - share * _softplus(zp).mean()
            d[len(p_at):] = _sigmoid(zu) / len(zu)
            d[:len(p_at)] = -share * _sigmoid(zp) / len(zp)
            if prior is None:
                d[:len(p_at)] -= _sigmoid(-zp) / len(zp)
            elif as_negative >= 0:
                d[:len(p_at)] -= prior * _sigmoid(-zp) / len(zp)
            else:                              # the estimate fell below zero: step back from it
                d = -d
            dh = np.outer(d, weights[2]) * (1 - h * h)
            grads = [x.T @ dh + decay * weights[0], dh.sum(0), h.T @ d + decay * weights[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - slow * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Network(mean, scale, weights, 0.0 if prior is None else prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.01, most: float = 0.99) -> float:
    """Share of positives among unlabelled rows, by best-bin estimation on halves that
    the ordering model has not seen."""
    model = _fit(pos[::2], unl[::2], None, epochs=25)
    p, u = np.sort(model.logits(pos[1::2])), np.sort(model.logits(unl[1::2]))
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 181))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], least, most))


def train(pos: np.ndarray, unl: np.ndarray) -> Network:
    """Estimate the prior and minimise the non-negative risk. Without positives or
    unlabelled rows (fewer than four of either) every score is 0.5."""
    if len(pos) < 4 or len(unl) < 4:
        zero = np.zeros(N_FEATURES)
        return Network(zero, zero + 1, [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(())], 0.5)
    return _fit(pos, unl, estimate_prior(pos, unl))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> Network:
    """Train from rows that are not held out.

    Both samples are bounded and the same on every run: the trusted positives
    and the unlabelled documents with the lowest id hash. Only their feature
    rows reach the driver. Null ids and labels without a document are left out.
    """
    usable = docs.where(F.col(doc_id).isNotNull()
                        & (doc_remainder(F.col(doc_id), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER))
    ids = usable.select(F.col(doc_id).alias("doc_id")).withColumn("draw", F.xxhash64("doc_id"))
    trusted = (labels.where(F.col(label) == 1).select(F.col(doc_id).alias("doc_id")).distinct()
               .join(ids, "doc_id"))

    @F.pandas_udf("array<double>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    def sample(frame: DataFrame, most: int) -> np.ndarray:
        drawn = frame.select("draw", "doc_id").distinct().orderBy("draw", "doc_id").limit(most)
        rows = (usable.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                .join(F.broadcast(drawn), "doc_id")                       # at most ``most`` rows
                .select("draw", "doc_id", describe("text").alias("x"))
                .orderBy("draw", "doc_id", "x").limit(most).collect())
        return np.array([r.x for r in rows]).reshape(-1, N_FEATURES)

    return train(sample(trusted, SAMPLE_POSITIVE), sample(ids, SAMPLE_UNLABELLED))


def score_column(spark, model: Network, text: Column) -> Column:
    """Probability of good quality (0 to 1) of each text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)                          # a few hundred numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)))
    return run(text)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null, empty and wordless texts get the score of all-zero features. A null
    id counts as the empty string (remainder 0, so not held out) but is never
    trained on. Repeated rows come back as often as they went in; other
    columns are not read; an empty table gives an empty result; without
    trusted positives every score is 0.5.
    """
    model = fit(docs, labels, doc_id, text)
    return (docs.select(F.col(doc_id).alias("doc_id"),
                        (doc_remainder(F.col(doc_id), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER).alias("held_out"),
                        score_column(docs.sparkSession, model, F.col(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
