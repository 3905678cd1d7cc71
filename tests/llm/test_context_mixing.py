import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import context_mixing as cm

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_of(rows):
    """(n_tokens, n_known, train_tokens, base_score) of each row, word by word."""
    def tokens(text):
        return "".join(" " if c in SPACE else c for c in lowered(text)).split(" ") + ["\n"]

    words = [[w for w in tokens(t) if w] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, words) if not held_out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
            for ws in words]


M32 = (1 << 32) - 1


LETTERS = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))


def slow_contexts(data, i):
    """The three context hashes and the gate's kind of the symbol at ``i``, byte by byte."""
    h, word, inside, out = 0, 77, True, []
    for lag in range(1, 9):
        b = data[i - lag] + 1 if i >= lag else 0
        if lag <= 5:
            h = (h + b) * 0x9E3779B1 & M32
            h ^= h >> 15
            if lag in (3, 5):
                out.append((h + lag) * 0x85EBCA6B & M32)
        inside = inside and b > 0 and b - 1 in LETTERS
        if inside:
            word = (word + b) * 0x9E3779B1 & M32
    out.append((word ^ word >> 15) * 0xC2B2AE35 & M32)
    before = data[i - 1] if i else None
    kind = 0 if before is None else 1 if before in LETTERS else 2 if chr(before) in SPACE else 3
    return [c ^ c >> 13 for c in out], kind


def slow_path(code, data, i, s, sizes):
    """(slots, gate without trust, bit) of each decision of symbol ``s`` at place ``i``."""
    contexts, kind = slow_contexts(data, i)
    index = (data[i - 1] + 1 if i else 0) * (cm.END + 1) + s
    for depth in range(code.length[index]):
        at = code.first[index] + depth
        yield ([(c ^ int(code.hashed[at])) & (n - 1) for c, n in zip(contexts, sizes)],
               (kind * cm.DEPTHS + min(depth, cm.DEPTHS - 1)) * cm.TRUSTS, int(code.bit[at]))


def predicted(model, weights, slots, gate):
    """(inputs, row of the weights, probability of branch 1)."""
    steps = [int(model.odds[k][s]) for k, s in enumerate(slots)]
    gate += (steps[-1] != 0) + (abs(steps[-1]) > cm.LITTLE)
    x = [v / cm.STEP for v in steps]
    return x, gate, 1 / (1 + math.exp(-sum(weights[k, gate] * v for k, v in enumerate(x))))


def slow_cost(model, text):
    """Nats of a text, decision by decision; weights move after 128, 256, ... symbols."""
    data, weights = lowered(text).encode(), model.weights.astype(float).copy()
    edges, size = [], cm.FIRST_BLOCK
    while not edges or edges[-1] <= len(data):
        edges.append((edges[-1] if edges else 0) + size)
        size = min(cm.MOST_BLOCK, size * 2)
    cost, pending = 0.0, []
    for i, s in enumerate([*data, cm.END]):
        if i == edges[0]:
            count = Counter(g for g, _, _ in pending)
            for gate, x, error in pending:
                weights[:, gate] += min(cm.RATE, cm.FAR / count[gate]) * error * np.array(x)
            pending.clear()
            edges.pop(0)
        for slots, gate, bit in slow_path(model.code, data, i, s, [len(o) for o in model.odds]):
            x, gate, p = predicted(model, weights, slots, gate)
            cost -= math.log(p if bit else 1 - p)
            pending.append((gate, x, bit - p))
    return cost


def texts_of(seed, count=40):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "über", "x1", "日本", "a-b", "\x00"]
    return ["".join(rng.choice(words) + rng.choice(" \n\t,.  ") for _ in range(rng.randrange(120))) for _ in range(count)]


SIZES = [1 << 16, 1 << 17, 1 << 17]


def small_model(texts):
    pairs, tables = np.zeros((cm.END + 1) ** 2), [np.zeros(n * 2, np.int32) for n in SIZES]
    for batch in cm._count_words([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]):
        if batch.column("pair").null_count == 0:
            np.add.at(pairs, batch.column("pair").to_numpy(), batch.column("f").to_numpy())
    code = cm.Code.of(pairs.reshape(cm.END + 1, -1))
    for _, _, *stretch in cm._stretches(pa.array(texts, pa.string())):
        cm._count_into(tables, code, *stretch)
    weights = np.random.default_rng(1).uniform(0.1, 0.5, (cm.PREDICTORS, cm.GATES))
    return cm.Model(code, [cm._odds(t.reshape(-1, 2)) for t in tables], weights), tables


def costs(model, texts):
    out, reader = np.zeros(len(texts)), cm.Reader(model)
    for first, n, *stretch in cm._stretches(pa.array(texts, pa.string())):
        out[first:first + n] += reader.cost(first, n, *stretch)
    return out


def test_counts_and_costs_equal_one_by_one():
    texts = texts_of(1) + ["", "The cat sat. " * 300]
    model, tables = small_model(texts)
    slow = [Counter() for _ in range(cm.PREDICTORS)]
    for t in texts:
        data = lowered(t).encode()
        for i, s in enumerate([*data, cm.END]):
            for slots, _, bit in slow_path(model.code, data, i, s, SIZES):
                for k, slot in enumerate(slots):
                    slow[k][slot * 2 + bit] += 1
    for table, want in zip(tables, slow):
        assert {int(i): int(table[i]) for i in np.flatnonzero(table)} == want
    some = [*texts_of(2, 12), "", *texts[-3:]]
    assert np.allclose(costs(model, some), [slow_cost(model, t) for t in some], rtol=1e-4)


def grams_of(texts, run=None):
    """(contexts, kind, last, symbol) of all grams and how often they occur, and how many grams there were."""
    out, grams = Counter(), 0
    for _, _, *stretch in cm._stretches(pa.array(texts, pa.string()), run):
        for symbols, last, contexts, kind, times in cm._grams(*stretch):
            for s, b, *c, k, n in zip(symbols, last, *contexts, kind, times):
                out[*map(int, c), int(k), int(b), int(s)] += int(n)
            grams += len(symbols)
    return out, grams


def test_equal_symbols_in_equal_contexts_are_taken_once(monkeypatch):
    """The scans once looked up every occurrence, at the cost of all of them."""
    texts = texts_of(14, 60) + ["", None, "a", "\n", "the cat sat " * 3000, "é" * 9, "日本" * 40]
    want = Counter()
    for t in texts:
        data = lowered(t).encode()
        for i, s in enumerate([*data, cm.END]):
            contexts, kind = slow_contexts(data, i)
            want[*contexts, kind, data[i - 1] + 1 if i else 0, s] += 1
    got, grams = grams_of(texts, cm.GRAM_RUN)
    assert got == want and grams < sum(want.values()) / 5
    twice, again = grams_of(texts * 2, cm.GRAM_RUN)
    assert twice == Counter({g: 2 * n for g, n in want.items()})
    assert again < grams + len(texts)                    # what stands before a text may tell its first symbols apart
    assert grams_of(texts, 50)[0] == want
    monkeypatch.setattr(cm, "GRAM_PIECE", 100)
    assert grams_of(texts)[0] == want
    monkeypatch.setattr(cm, "PAIR_BITS", 9)              # stretches are halved until their pairs fit
    assert grams_of(texts, cm.GRAM_RUN)[0] == want


def test_long_texts_in_stretches(monkeypatch):
    long = " ".join(texts_of(3, 200))
    model, tables = small_model([long, "", None, "the"])
    whole = costs(model, [long, "", None, "the"])
    monkeypatch.setattr(cm, "TEXT_RUN", 5000)
    again = small_model([long, "", None, "the"])[1]
    assert all((a == b).all() for a, b in zip(again, tables))
    assert np.allclose(costs(model, [long, "", None, "the"]), whole, rtol=2e-2)
    assert costs(model, ["the", "the", None])[0] == pytest.approx(whole[3])


def test_symbols_are_a_distribution():
    """At any place the probabilities of all symbols add up to one."""
    model, _ = small_model(texts_of(4))
    for data in (b"", b"the ca", "ü".encode()[:1]):
        total = 0.0
        for s in range(cm.END + 1):
            p = 1.0
            for slots, gate, bit in slow_path(model.code, data, len(data), s, SIZES):
                one = predicted(model, model.weights, slots, gate)[2]
                p *= one if bit else 1 - one
            total += p
        assert total == pytest.approx(1)


def test_blocks_add_up(spark):
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, (9, 3, cm.BLOCK * 2))
    rows = [(p, 0, part, bytearray(cm._packed(counts[part, p]))) for part in range(9) for p in range(3)]
    merged, _ = cm._merged(spark.createDataFrame(rows, cm._TABLES), 2)
    got = {r.predictor: cm._unpacked(bytes(r.counts)) for r in merged.collect()}
    assert sorted(got) == [0, 1, 2] and all((got[p] == counts[:, p].sum(0)).all() for p in range(3))


def slow_seen(texts, code, tables):
    """How often decisions of kind, depth and levels occur, decision by decision."""
    out = Counter()
    for t in texts:
        data = lowered(t).encode()
        for i, s in enumerate([*data, cm.END]):
            for slots, gate, bit in slow_path(code, data, i, s, SIZES):
                spot = gate // cm.TRUSTS
                for table, slot in zip(tables, slots):
                    own, other = table[slot * 2 + bit] - 1, table[slot * 2 + 1 - bit]
                    said = max(-127, min(127, round(math.log((own + cm.PRIOR) / (other + cm.PRIOR)) * cm.STEP)))
                    level = sum(abs(said) >= e for e in cm._EDGES)
                    spot = spot * cm.LEVELS + len(cm._EDGES) + (level if said > 0 else -level)
                out[spot] += 1
    return out


def test_fit_sees_every_decision():
    texts = texts_of(8) + ["", "The cat sat. " * 700]
    model, tables = small_model(texts)
    seen = np.zeros(cm.SEEN, np.int64)
    for _, _, *stretch in cm._stretches(pa.array(texts, pa.string())):
        cm._see(seen, model.code, [cm._levels(t.reshape(-1, 2)) for t in tables], *stretch)
    assert {int(i): int(seen[i]) for i in np.flatnonzero(seen)} == slow_seen(texts, model.code, tables)


def test_fit_costs_least():
    rng = np.random.default_rng(9)
    seen = np.zeros(cm.SEEN, np.int64)
    spots = rng.integers(0, 4 * cm.DEPTHS * cm.LEVELS ** cm.PREDICTORS, 5000)
    seen[spots] = rng.integers(1, 1000, len(spots))
    level = np.array([spots // cm.LEVELS ** k % cm.LEVELS for k in (2, 1, 0)])
    word = abs(cm._MIDDLE[level[2]])
    row = spots // cm.LEVELS ** 3 * cm.TRUSTS + (word > 0) + (word > cm.LITTLE)

    def cost(weights):
        t = sum(w[row] * cm._MIDDLE[v] / cm.STEP for w, v in zip(weights, level))
        held = cm.HOLD / 2 * ((weights - cm.START) ** 2).sum()
        return (seen[spots] * np.log1p(np.exp(-t))).sum() + held

    best = cm._fit(seen)
    least = cost(best)
    assert least < cost(np.full_like(best, cm.START))
    for _ in range(20):
        assert cost(best + rng.normal(0, 0.01, best.shape)) > least
    assert (cm._fit(np.zeros(cm.SEEN, np.int64)) == cm.START).all()


def test_first_weights_come_from_all_training_texts(spark):
    """Texts above 8,192 bytes and more than 256 texts once had no part in the first weights."""
    texts = texts_of(10, 300) + [" ".join(texts_of(seed, 60)) for seed in (11, 12)] + [None]
    assert max(len(t or "") for t in texts) > 8192
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = docs.mapInArrow(cm._count_words, "word string, pair int, f long").groupBy("word", "pair").sum("f").toDF("word", "pair", "f")
    got = cm.train(docs, counts)
    whole = [np.zeros(len(o) * 2, np.int32) for o in got.odds]
    seen = np.zeros(cm.SEEN, np.int64)
    stretches = [stretch for _, _, *stretch in cm._stretches(pa.array(texts, pa.string()))]
    for stretch in stretches:
        cm._count_into(whole, got.code, *stretch)
    for stretch in stretches:
        cm._see(seen, got.code, [cm._levels(t.reshape(-1, 2)) for t in whole], *stretch)
    assert seen.sum() == whole[0].sum()
    assert np.allclose(got.weights, cm._fit(seen))


def test_numbers_of_names():
    names, words = ["b", "", " ", "é", "zz"], ["é", "a", "b", "zzz", "zz"]
    for some in (words, words[:1], []):
        got = cm._numbers(pa.array(names, pa.large_string()), pa.array(some, pa.large_string()))
        assert got.tolist() == [some.index(n) if n in some else -1 for n in names]
    assert cm._numbers(pa.array([], pa.large_string()), pa.array(words, pa.large_string())).tolist() == []


def test_base_columns(spark, monkeypatch):
    monkeypatch.setattr(cm, "HEAD_WORDS", 3)             # the others meet their counts in the join
    rows = list(enumerate(texts_of(7, 60))) + [(None, None), (None, ""), (3, "the " * 9), (3, "the " * 9), (61, "w" * 5000 + " new")]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, row int, score double")
    got = cm.score_language(docs).collect()
    want = base_of(rows)
    assert len(got) == len(rows)
    key = sorted((str(i), held_out(i), a, b, c, round(d, 6)) for (i, _), (a, b, c, d) in zip(rows, want))
    assert key == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    twice = [r.score for r in got if r.doc_id == 3 and r.n_tokens == 10]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])


def test_pairs_in_pieces(monkeypatch):
    texts = [*texts_of(13, 30), "", "", "a", None, "é" * 50]
    want = Counter()
    for t in texts:
        data = lowered(t).encode()
        want.update((data[i - 1] + 1 if i else 0) * (cm.END + 1) + s for i, s in enumerate([*data, cm.END]))
    buf, starts = cm.joined(pa.array(texts, pa.string()))
    for size in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(cm, "PAIR_RUN", size)
        got = cm._pairs(buf, starts)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want


def test_head_takes_whole_levels(spark, monkeypatch):
    counts = {"a": 1000, "b": 1000, "c": 40, "d" * 300: 5000, "e": 7, "f": 1}
    words = spark.createDataFrame(list(counts.items()), "word string, f long")
    for most, want in ((1, ""), (2, "ab"), (3, "abc"), (4, "abce"), (9, "abcef")):
        monkeypatch.setattr(cm, "HEAD_WORDS", most)
        assert {r["word"]: r["f"] for r in cm._head(words).to_pylist()} == {w: counts[w] for w in want}


def test_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cm.score_language(docs).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    held = got[got.held_out]
    # learned from one megabyte; single bytes would cost 4.4 bits, pairs 3.3
    assert held.bits_per_byte.mean() < 2.6
    assert got[~got.held_out].bits_per_byte.mean() < held.bits_per_byte.mean()


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cm.score_language(docs).count() == 0
    unseen = next(i for i in range(100) if held_out(i))
    row, = cm.score_language(spark.createDataFrame([(unseen, "ab")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0) and row.score < 0
