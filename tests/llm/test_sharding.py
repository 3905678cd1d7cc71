import zlib

from candlewick.llm.prefix import running
from candlewick.llm.sharding import shard_by_bytes, sharding_digest, write_shards
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def slow(rows, shards):
    """rows: (doc_id, text) -> sorted (doc_id, size, crc, shard, slot)."""
    laid = sorted((d is not None, d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    total, before, out, slots = sum(r[2] for r in laid), 0, [], {}
    for _, d, size, crc in laid:
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        before += size
        out.append((d, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=key)


def test_against_slow(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(shard_by_bytes(docs, 24)) == sorted(slow(rows, 24), key=key)
    sizes = [r.b for r in shard_by_bytes(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    longest = max(len(t.encode()) + 8 for _, t in rows)
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * longest


def test_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (1, "é"), (2, "x" * 100000), (7, "same")] + [(7, "same")] * 50
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, shard string")
    assert got(shard_by_bytes(df, 5)) == sorted(slow(rows, 5), key=key)
    assert sharding_digest(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("slot", F.lit("x"))
    back = write_shards(docs, str(tmp_path / "out"), 6)
    assert sorted(r.row.text for r in back.collect()) == sorted(r.text for r in docs.collect())
    want = {(r.doc_id, r.shard, r.slot) for r in shard_by_bytes(docs, 6).collect()}
    assert {(r.row.doc_id, r.shard, r.slot) for r in back.collect()} == want


def test_running_over_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(2).cast("long").alias("v"))
    assert sorted(r.s for r in running(df, [F.col("k")], {"s": "v"}).collect()) == [2 * i for i in range(500)]
