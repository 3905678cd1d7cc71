import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candlewick.llm.components import connected_components
from candlewick.llm.simhash import bucket_links, fingerprint, keep_one, simhash_components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows):
    """rows: (doc_id, fingerprint); the smallest id reachable over links of <= 3 bits."""
    label = list(range(len(rows)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for k in range(i):
            if bin(rows[i][1] ^ rows[k][1]).count("1") <= 3:
                label[root(i)] = root(k)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d e a b c", "Ä ß x y\x1cz",
                                  "word " * 3000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_is_spark_xxhash64(spark):
    got = spark.createDataFrame([("ab cd ef",)], "t string").select(F.xxhash64("t")).first()[0]
    assert fingerprint("AB cd  ef") == got % (1 << 64)


def test_bucket_links_connect_all_near_pairs():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 700:                      # mostly inside block 2, some visible flips
        x = base ^ (int(rng.integers(0, 1 << 16)) << 32)
        fps.add(x ^ (1 << int(rng.integers(0, 32))) if rng.random() < .3 else x)
    arr = np.array(sorted(fps), np.uint64)
    variant = base & ~(0xFFFF << 32)
    a, b = bucket_links(2, variant, arr)
    parent = {int(x): int(x) for x in arr}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        assert bin(x ^ y).count("1") <= 3
        parent[root(x)] = root(y)
    for i, x in enumerate(arr.tolist()):
        for y in arr.tolist()[:i]:
            d = x ^ y
            visible = bin(d & ~(0xFFFF << 32)).count("1")
            hidden = bin(d & (0xFFFF << 32)).count("1")
            if visible + hidden <= 3 and (hidden <= 1 or visible == 0):
                if visible == 0 and hidden > 1 and (x & ~(0xFFFF << 32)) != variant:
                    continue
                assert root(x) == root(y)


def test_components_of_planted_distances(spark):
    """Fingerprints at every pattern of one to four differing bits, through the links."""
    from candlewick.llm.simhash import component_map
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63)) * 2
        rows.append((n, base)); n += 1
        for k in (1, 2, 3, 4):
            same_block = rng.random() < .5
            bits = rng.choice(16, k, replace=False) + 16 * int(rng.integers(0, 4)) if same_block \
                else rng.choice(64, k, replace=False)
            rows.append((n, base ^ sum(1 << int(b) for b in bits))); n += 1
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in component_map(df, "doc_id", "fp").collect()}
    assert [got[f] for _, f in signed] == slow_components(rows)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(rows, slow_components(rows))}
    got = simhash_components(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b c d", "y"), (5, "a b c d", None),
            (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.fingerprint == "0" * 16, r.component_id) for r in simhash_components(df).collect())
    assert got == [(-1, False, 5), (-1, True, 1), (1, True, 1), (2, True, 1), (2, True, 1), (5, False, 5)]
    kept = sorted(tuple(r) for r in keep_one(df).collect())
    assert kept == [(1, None, "x"), (5, "a b c d", None)]
    assert keep_one(df).columns == df.columns
    assert simhash_components(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_keep_one_matches_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.component_id for r in simhash_components(docs).collect()}
    kept = keep_one(docs.union(docs)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
