import hashlib
import math
import re
from collections import Counter

import pytest

from candlewick.llm.mixing import SEED, mix_documents, mix_words, source_plan

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^ \t\n\v\f\r]+")


def slow_targets(sizes):
    """sizes: source -> words. Clamp and share again until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        if not free:
            return {s: 2.0 * sizes[s] for s in order}
        level = (1.5 * total - sum(2 * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in clamped else level * weight[s] for s in order}
        clamped |= over


def slow_mix(rows):
    """rows: (doc_id, text, source) -> Counter of (doc_id, size, source_size, target, taken)."""
    sized = [(d, len(WORD.findall(t or "")), s) for d, t, s in rows]
    sizes = Counter()
    for d, n, s in sized:
        sizes[s] += n
    targets, out = slow_targets(sizes), Counter()
    for source, size in sizes.items():
        target = targets[source]
        whole = math.floor(target / size) if size else 0
        rest, before = target - whole * size, 0
        draw = lambda d: hashlib.md5(f"{SEED}:{'' if d is None else d}".encode()).hexdigest()[:16]
        mine = sorted((draw(d), d is not None, d or 0, n) for d, n, s in sized if s == source)
        for _, known, d, n in mine:
            taken = (whole + (before + n / 2 < rest)) * n
            out[(d if known else None, n, size, round(target, 6), taken)] += 1
            before += n
    return out


def counted(df):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_query_against_slow(docs):
    assert counted(mix_words(docs)) == slow_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_targets_and_caps(docs):
    rows = mix_words(docs).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.longest / 2 + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * rows["size"].sum()) < 1e-3


def test_odd_rows(spark):
    rows = [(1, "a b c", None, 1), (None, "x", "s", 2), (2, None, "s", 3), (3, "", "empty", 4)] \
        + [(9, "one two three", "copies", 5)] * 40 + [(k, "w " * k, "big", 6) for k in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert counted(mix_words(df)) == slow_mix([r[:3] for r in rows])
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    want = Counter()
    for r in mix_words(df).collect():
        if r["size"]:
            want[r.doc_id] += r.taken // r["size"]
    got = Counter(r.doc_id for r in mixed.collect())
    assert {k: v for k, v in got.items() if k != 9} == {k: v for k, v in want.items() if v and k != 9}
    assert 0 <= got[9] <= 80
    assert mix_words(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


def test_documents_follow_words(docs):
    want = {r.doc_id: r.taken // r["size"] for r in mix_words(docs).where("taken > 0").collect()}
    assert Counter(r.doc_id for r in mix_documents(docs).select("doc_id").collect()) == Counter(want)
    assert mix_documents(docs).dtypes == docs.dtypes


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mix_words(df).collect()} == {(0, 0.0)}
    assert source_plan(df.selectExpr("source", "0L AS size")).count() == 2
