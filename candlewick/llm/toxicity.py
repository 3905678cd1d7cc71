"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is cut into windows of ``WINDOW_WORDS`` words. A window is the bag of
its words' character n-grams (3 to 5, a word's ends marked by a space). Each
n-gram hashes to a row of an embedding table; the rows' average goes through
a linear softmax over {clean, toxic}, and both are trained together by numpy
from a bounded sample of labelled texts. A text's score is that of its most
toxic window, so a few insults in a long text are not averaged away. A window
counts each n-gram once and averages over at least ``LEAST_GRAMS`` of them
(missing ones are zero vectors), so one repeated word is no louder alone than
among others. A misspelling
or a new inflection shares most n-grams with the words seen in training, and
so most of its vector.

Two classes make a window's logit a function of one number per n-gram row
(its embedding times the difference of the class weights), so scoring reads
one float32 table of ``2 ** bits`` entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import doc_remainder, fresh, give_back

#: Labelled clean and toxic texts that training reads at most (lowest id hash first).
SAMPLE = (3000, 1500)
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 0
THRESHOLD = 0.5
WINDOW_WORDS = 8
GRAM_LENGTHS = (3, 4, 5)
LEAST_GRAMS = 100
#: What a row's squared gradients count as before the first: rare rows move slowly.
CAUTION = 1e-3
BITS = 18
#: A toxic text trains on one of its worst 1 + windows / TOP_SHARE windows.
TOP_SHARE = 12
#: Characters hashed at a time (bounds the memory that a very long text takes).
CHUNK = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one space between and around words."""
    words = (text or "").lower().split()
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) \
        if words else np.zeros(0, np.uint32)


def _grams(codes: np.ndarray, bits: int):
    """(rows, starts) of the n-grams of each length; a space may only be at an n-gram's ends."""
    space = codes == 32
    hashed, inner = codes.astype(np.uint64), None
    for n in range(2, max(GRAM_LENGTHS) + 1):
        if len(codes) < n:
            return
        hashed = hashed[:-1] * _PRIME + codes[n - 1:]
        if n > 2:
            last = space[n - 2:-1]
            inner = last if inner is None else inner[:-1] | last
        if n in GRAM_LENGTHS:
            at = np.nonzero(~inner)[0]
            h = hashed[at]
            yield (((h ^ (h >> np.uint64(29))) * _PRIME) >> np.uint64(64 - bits)).astype(np.int32), at


def _windows(codes: np.ndarray) -> np.ndarray:
    """Window number of the word that each character starts or lies in."""
    return (np.cumsum(codes == 32) - 1) // WINDOW_WORDS


def _bag(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram rows of each window, window after window; where each window
    starts; how many rows it has."""
    codes = _codes(text)
    window = _windows(codes)
    parts = []
    for at in range(0, len(codes), CHUNK):
        # an n-gram belongs to the chunk that it starts in
        for rows, starts in _grams(codes[at:at + CHUNK + max(GRAM_LENGTHS) - 1], bits):
            own = np.searchsorted(starts, CHUNK)
            parts.append(window[at + starts[:own]] << bits | rows[:own])
    keys = np.concatenate(parts or [np.zeros(0, np.int64)])
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    spot = keys >> bits
    starts = np.concatenate(([0], np.nonzero(np.diff(spot))[0] + 1)) if len(keys) else spot
    return (keys & ((1 << bits) - 1)).astype(np.int32), starts, np.diff(np.append(starts, len(keys)))


def _means(table: np.ndarray, rows, starts, sizes) -> np.ndarray:
    return np.add.reduceat(table[rows], starts) / np.maximum(sizes, LEAST_GRAMS)


@dataclass
class SubwordModel:
    table: np.ndarray          # logit share of one n-gram row: embedding . (toxic - clean weights)
    bias: float
    bits: int

    def logit(self, text: str | None) -> float:
        """The highest window logit; a text without n-grams gets the bias alone."""
        rows, starts, sizes = _bag(text, self.bits)
        return self.bias + (float(_means(self.table, rows, starts, sizes).max()) if len(rows) else 0.0)

    def score(self, texts) -> np.ndarray:
        logits = np.array([self.logit(t) for t in texts], np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))


class _Trainer:
    """Embeddings and softmax under one Adagrad step."""

    def __init__(self, bits: int, dim: int, rate: float, rng: np.random.Generator):
        size = 1 << bits
        self.emb = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
        self.soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.sums = [np.full(size, CAUTION, np.float32), np.full_like(self.soft, 1e-8),
                     np.full_like(self.bias, 1e-8)]
        self.rate = rate

    def table(self) -> np.ndarray:
        return (self.emb @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32)

    def step(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        lengths = np.array([len(b) for b in bags])
        ids = np.concatenate(bags)
        frac = np.repeat(1.0 / np.maximum(lengths, LEAST_GRAMS), lengths).astype(np.float32)
        mean = np.add.reduceat(self.emb[ids] * frac[:, None], np.cumsum(lengths) - lengths)
        logits = mean @ self.soft + self.bias
        err = np.exp(logits - logits.max(1, keepdims=True))
        err /= err.sum(1, keepdims=True)
        err[np.arange(len(labels)), labels] -= 1
        err *= (weights / len(labels))[:, None].astype(np.float32)
        d_mean = np.repeat(err @ self.soft.T, lengths, axis=0) * frac[:, None]
        rows, back = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(back, d_mean[:, k], len(rows)) for k in range(d_mean.shape[1])],
                        1).astype(np.float32)
        d_soft, d_bias = mean.T @ err, err.sum(0)
        self.sums[0][rows] += (grad ** 2).mean(1)
        self.emb[rows] -= self.rate * grad / np.sqrt(self.sums[0][rows])[:, None]
        self.sums[1] += d_soft ** 2
        self.soft -= self.rate * d_soft / np.sqrt(self.sums[1])
        self.sums[2] += d_bias ** 2
        self.bias -= self.rate * d_bias / np.sqrt(self.sums[2])


def train(texts, labels, bits: int = BITS, dim: int = 8, warm: int = 2, epochs: int = 14,
          rate: float = 1.0, batch: int = 32, seed: int = 7) -> SubwordModel:
    """Train on a random window of each text first (``warm`` passes), then on a clean
    text's worst window and on one of a toxic text's worst (so that its quieter
    insults are learned too).

    A class weighs as the square root of its inverse share. With one class only the score is that class
    throughout; without any labelled text every score is near zero.
    """
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        only = 20.0 if len(labels) and labels[0] else -20.0
        return SubwordModel(np.zeros(1 << bits, np.float32), only, bits)
    bags = [_bag(t, bits) for t in texts]
    usable = np.array([i for i, b in enumerate(bags) if len(b[0])])
    model = _Trainer(bits, dim, rate, rng)
    weight = np.sqrt(len(labels) / (2.0 * np.bincount(labels, minlength=2)))
    for epoch in range(warm + epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), batch):
            pick, table = order[at:at + batch], model.table()
            chosen = []
            for i in pick:
                rows, starts, sizes = bags[i]
                if epoch < warm:
                    k = int(rng.integers(len(starts)))
                else:
                    means = _means(table, rows, starts, sizes)
                    top = 1 + len(means) // TOP_SHARE if labels[i] else 1
                    k = int(np.argpartition(-means, top - 1)[rng.integers(top)])
                chosen.append(rows[starts[k]:starts[k] + sizes[k]])
            model.step(chosen, labels[pick], weight[labels[pick]])
    return SubwordModel(model.table(), float(model.bias[1] - model.bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, doc_id: str = "doc_id",
        text: str = "text", label: str = "toxic") -> SubwordModel:
    """Train from labelled rows that are not held out.

    The sample is bounded: for each class the ``sample`` documents with the
    lowest id hash, fewer if there are fewer, so it is the same on every run.
    Null labels and ids without a document are left out; of a document
    labelled twice the higher label counts.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                          & (doc_remainder(F.col(doc_id), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
             .join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
             .withColumn("draw", F.xxhash64("doc_id")))
    texts, marks = [], []
    for value in (0, 1):
        drawn = known.where(F.col("label") == value).orderBy("draw", "doc_id").limit(sample[value])
        rows = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                .join(F.broadcast(drawn), "doc_id")             # at most sample[value] rows
                .orderBy("draw", "doc_id", F.xxhash64("text")).limit(sample[value]).select("text").collect())
        texts += [r.text for r in rows]
        marks += [value] * len(rows)
    return train(texts, marks)


def score_column(spark, model: SubwordModel, text: Column) -> Column:
    """Probability of toxicity (0 to 1) of each text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)          # one table of 2 ** bits numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.score(texts))
        give_back()
        return out
    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null, empty and wordless texts get the score of a text without n-grams
    (the bias). A null id counts as the empty string, whose remainder is
    zero, so it is held out. Repeated rows come back as often as they went
    in; other columns are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text)
    score = score_column(docs.sparkSession, model, F.col(text))
    return (docs.select(F.col(doc_id).alias("doc_id"),
                        (doc_remainder(F.col(doc_id), HELD_OUT_MODULUS) == HELD_OUT_REMAINDER).alias("held_out"),
                        score.alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; columns unchanged.

    Null and empty texts score the bias; repeated rows stay or go together; other
    columns are passed on whatever their names; an empty table stays empty."""
    score = fresh(docs, "toxicity")
    model = fit(docs, labels, doc_id=doc_id, text=text)
    return (docs.withColumn(score, score_column(docs.sparkSession, model, F.col(text)))
            .where(F.col(score) < THRESHOLD).drop(score))
