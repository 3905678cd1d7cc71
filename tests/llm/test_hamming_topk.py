import random

import pytest

from candlewick.llm.hamming_topk import _segments, hamming_topk, topk_of_every_20th

SF = "/root/testdata/sf0.001"


def code(vector, bits=64):
    return sum(1 << i for i, x in enumerate((vector or [])[:bits]) if x is not None and x > 0)


def slow(rows, queries, k, bits=64):
    """rows, queries: (id, vector) -> sorted (query, rank, neighbour, distance)."""
    known, out = {(d, code(v, bits)) for d, v in rows}, []
    for q, c in {(d, code(v, bits)) for d, v in queries}:
        near = sorted((bin(c ^ x).count("1"), d is None, d or 0) for d, x in known)[:k]
        out += [(q, n + 1, None if no else d, dist) for n, (dist, no, d) in enumerate(near)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "neighbor_id", "distance").collect()), key=str)


@pytest.mark.parametrize("codes,bits", [(0, 64), (1, 64), (2, 64), (500, 64), (10**9, 64), (10**30, 64), (9, 7)])
def test_segments_cover_the_code(codes, bits):
    parts = _segments(codes, bits)
    assert sum(w for _, w in parts) == bits and all(w > 0 for _, w in parts)
    assert [s for s, _ in parts] == [sum(w for _, w in parts[:i]) for i in range(len(parts))]


def test_query_against_slow(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert got(topk_of_every_20th(vectors)) == slow(rows, [r for r in rows if r[0] % 20 == 0], 10)


@pytest.mark.parametrize("bits,k,n", [(12, 3, 150), (64, 4, 60), (8, 50, 20)])
def test_random_codes(spark, bits, k, n):
    rng = random.Random(bits)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(bits)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(hamming_topk(df, df.where("vec_id < 12"), k, bits=bits)) == slow(rows, rows[:12], k, bits)


def test_odd_rows(spark):
    rng = random.Random(3)
    same = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, same, "x") for i in range(40)] + [(40, None, "x"), (41, [], "x"), (42, [1.0, None], "x"), (None, same, "x"),
                                                   (7, same, "x"), (7, [-x for x in same], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance string")
    plain = [(a, b) for a, b, _ in rows]
    for k in (5, 100):
        assert got(hamming_topk(df, df.where("vec_id in (0, 7, 40)"), k)) == \
            slow(plain, [r for r in plain if r[0] in (0, 7, 40)], k)
    assert hamming_topk(df.limit(0), df).count() == 0 and hamming_topk(df, df.limit(0)).count() == 0
