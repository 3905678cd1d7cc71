import zlib

import numpy as np

from candlewick.llm import toxicity
from candlewick.llm.toxicity import drop_toxic, score_toxicity, train

SF = "/root/testdata/sf0.1"


def slow_logit(model, text):
    """Window by window, n-gram by n-gram."""
    words = (text or "").lower().split()
    best = None
    for at in range(0, len(words), toxicity.WINDOW_WORDS):
        rows = set()
        for w in words[at:at + toxicity.WINDOW_WORDS]:
            marked = f" {w} "
            for n in toxicity.GRAM_LENGTHS:
                for i in range(len(marked) - n + 1):
                    codes = np.array([ord(c) for c in marked[i:i + n]], np.uint32)
                    by_length = dict(zip(toxicity.GRAM_LENGTHS, toxicity._grams(codes, model.bits)))
                    rows.add(int(by_length[n][0][-1]))
        if rows:
            mean = sum(float(model.table[r]) for r in rows) / max(len(rows), toxicity.LEAST_GRAMS)
            best = mean if best is None else max(best, mean)
    return model.bias + (best or 0.0)


def small_model():
    rng = np.random.default_rng(0)
    return toxicity.SubwordModel(rng.normal(size=1 << 12).astype(np.float32), -0.5, 12)


def test_logit_against_slow_and_chunks(monkeypatch):
    model = small_model()
    texts = [None, "", " \n", "a", "ab cd", "Die Straße é日本 x " * 30, "word " * 500]
    want = [slow_logit(model, t) for t in texts]
    assert np.allclose([model.logit(t) for t in texts], want)
    monkeypatch.setattr(toxicity, "CHUNK", 17)
    assert np.allclose([model.logit(t) for t in texts], want)


def test_unseen_misspellings():
    rng = np.random.default_rng(1)
    plain = ["the", "house", "walks", "green", "table", "often", "river", "stone", "under", "lamp"]
    def text(bad):
        words = [plain[i] for i in rng.integers(0, 10, 40)]
        for b in bad:
            words[int(rng.integers(0, 40))] = b
        return " ".join(words)
    texts = [text([["idiot", "worthless"][k % 2]]) for k in range(150)] + [text([]) for _ in range(150)]
    model = train(texts, [1] * 150 + [0] * 150, bits=14)
    assert model.score([text(["idiott"]), text(["worthles"]), text(["idiots"])]).min() > 0.5
    assert model.score([text([]) for _ in range(30)]).max() < 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (zlib.crc32(str(got.doc_id[0]).encode()) % 5) == 0
    tp = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert tp / (got.toxic == 1).sum() > 0.88
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() / (got.toxic == 0).sum() < 0.04


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (None, "", 1.0), (3, "x " * 5000, None)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 4 and max(r.score for r in got) < 0.01 and [r.held_out for r in got if r.doc_id is None] == [True]
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert score_toxicity(docs.limit(0), labels).count() == 0
