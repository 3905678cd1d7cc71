import random

import numpy as np
import pytest

from candlewick.llm import decontam
from candlewick.llm.decontam import contaminated_pairs, drop_contaminated, greedy_string_tiling, words_of

SF = "/root/testdata/sf0.001"


def slow_tiling(p, t, least):
    """Greedy string tiling by trying every pair of starts each time."""
    mp, mt, tiles = [x < 0 for x in p], [x < 0 for x in t], []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        mp[i:i + n] = mt[j:j + n] = [True] * n


@pytest.mark.parametrize("seed", range(60))
def test_tiling_against_slow(seed):
    rng = random.Random(seed)
    p = [rng.randint(1, rng.choice([3, 30, 300])) for _ in range(rng.randint(0, 60))]
    t = [rng.randint(1, 30) for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 4)):
        a = rng.randint(0, max(0, len(p) - 1)) if p else 0
        t += p[a:a + rng.randint(1, 50)] + ([-1] if rng.random() < .5 else [])
    got = greedy_string_tiling(np.array(p, np.int64), np.array(t, np.int64), 5)
    want = slow_tiling(p, t, 5)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
    cover_p, cover_t = [], []
    for i, j, n in got:
        assert p[i:i + n] == t[j:j + n] and n >= 5
        cover_p += range(i, i + n)
        cover_t += range(j, j + n)
    assert len(set(cover_p)) == len(cover_p) and len(set(cover_t)) == len(cover_t)


def slow_pairs(docs, items):
    out = set()
    for d, text in docs:
        dw = words_of(text)
        for i, item in items:
            iw = words_of(item)
            if len(iw) < 5 or not {tuple(iw[k:k + 5]) for k in range(len(iw) - 4)} & \
                    {tuple(dw[k:k + 5]) for k in range(len(dw) - 4)}:
                continue
            number = {w: k for k, w in enumerate(dict.fromkeys(iw + dw))}
            tiles = slow_tiling([number[w] for w in iw], [number[w] for w in dw], 5)
            covered = sum(n for _, _, n in tiles)
            if covered >= 0.5 * len(iw):
                out.add((d, i, len(iw), covered))
    return out


def test_query_against_slow(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = docs.where("length(text) < 6000")
    want = slow_pairs([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in contaminated_pairs(small, bench).collect()}
    assert got == want and want


def test_reordered_and_partial(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))          # noqa: E731
    item = [word() for _ in range(40)]
    fill = [word() for _ in range(30)]
    texts = {1: fill + item[20:] + fill + item[:20] + fill,       # two halves swapped
             2: fill + item[:19] + fill,                          # under half
             3: [w.upper() + "," for w in item],                  # other case and marks
             4: [x for w in item for x in (w, "zz")],             # every word apart
             5: fill * 3}
    rows = [(k, " ".join(v), "x") for k, v in texts.items()] + [(None, " ".join(item), "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "too short"), (11, None)], "item_id long, text string")
    for block in (2_000_000, 1):                                  # one block, or one item a block
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        got = contaminated_pairs(docs, bench).collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 3] and {r.item_id for r in got} == {9}
        kept = drop_contaminated(docs, bench)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 8] and kept.columns == docs.columns
    tiles = [r.tiles for r in got if r.doc_id == 1][0]
    assert sorted((t.item_word, t.length) for t in tiles) == [(0, 20), (20, 20)]
    assert contaminated_pairs(docs.limit(0), bench).count() == 0
    assert contaminated_pairs(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == 8


def test_short_and_unspaced_items_and_int_ids(spark):
    han = "".join(chr(0x4e00 + 37 * k % 900) for k in range(24))
    docs = spark.createDataFrame([(1, "see the Lazy dog again, today"), (2, f"前{han[12:]}中{han[:12]}后"), (3, "lazy dog, once again"),
                                  (4, "lazy dog again lazy dog again"), (5, "the dog"), (6, han[:8])], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "lazy dog again"), (8, han), (9, "dog"), (10, "the dog"), (7, "lazy dog again")],
                                  "item_id int, text string")
    got = [(r.doc_id, r.item_id, r.item_words, [tuple(t) for t in r.tiles]) for r in contaminated_pairs(docs, bench).collect()]
    assert sorted(got) == [(1, 7, 3, [(2, 0, 3)])] * 2 + [(2, 8, 24, [(1, 12, 12), (14, 0, 12)])] + [(4, 7, 3, [(0, 0, 3)])] * 2 \
        or sorted(got) == [(1, 7, 3, [(2, 0, 3)])] * 2 + [(2, 8, 24, [(14, 0, 12), (1, 12, 12)])] + [(4, 7, 3, [(0, 0, 3)])] * 2
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [3, 5, 6]


def test_very_long_text(spark):
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item}"), (2, long)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.covered_words) for r in contaminated_pairs(docs, bench).collect()] == [(1, "a", 30)]
