"""Every stage on its own input against brute force, and the run as a whole."""
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from candlewick.llm.mixing import mix_words
from candlewick.llm.toxicity import score_toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_decontam import slow_pairs  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402
from test_token_files import ids_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output rows of each stage."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "token_output":
            assert after.dtypes == before.dtypes


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(after) == ids(score_toxicity(before, labels).where("score < 0.5"))
    assert 0 < after.count() < before.count()


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in before.collect()]
    assert ids(after) == sorted(set(slow_components(rows)))


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in slow_pairs([(r.doc_id, r.text) for r in before.collect()], items)}
    assert ids(after) == [d for d in ids(before) if d not in bad]


def test_mixing(stages):
    before, after = stages["mixing"]
    want = Counter({r.doc_id: r.taken // r["size"] for r in mix_words(before).where("taken > 0").collect()})
    assert Counter(ids(after)) == want


def test_token_output(stages):
    before, after = stages["token_output"]
    rows = sorted((tuple(r) for r in after.collect()), key=lambda r: r[1])
    texts = {r.doc_id: r.text for r in before.collect()}
    assert [r[0] for r in rows] == ids(before)
    start = 0
    for doc_id, at, n, _ in rows:
        assert (at, n) == (start, len(ids_of(texts[doc_id])))
        start += n


def test_run(spark, stages):
    want = sorted(tuple(r) for r in stages["token_output"][1].collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
