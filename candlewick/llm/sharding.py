"""Contiguous shards of equal byte size from global prefix sums.

Documents in doc_id order are laid end to end; a document goes to the shard in
which its middle byte falls when the whole length is cut at equal targets. So
shards are contiguous in doc_id order and each boundary is off its target by
at most half a document. The prefix sums come from per-partition totals
(:mod:`candlewick.llm.prefix`); only ids and sizes are shuffled, never texts,
and everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import written
from candlewick.llm.prefix import running

#: What a document takes besides its text (its id).
ROW_BYTES = 8


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 text; null counts as empty (0)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                   carry_row: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot[, row]), one row per input row.

    ``shard`` is 0 to ``shards`` - 1 and never falls along doc_id order (null
    ids first); ``slot`` counts 0, 1, 2, ... within a shard in the same order.
    Rows with one id are ordered by size and crc32, equal rows in any order.
    Null and empty texts have size ``ROW_BYTES``. With fewer documents than
    shards, or one document larger than a target, some shards stay empty; a
    document is never split. ``row`` holds the whole input row as a struct if
    ``carry_row`` asks for it, so other columns may have any name; without it
    they are not read. An empty table gives an empty result.
    """
    thin = docs.select(F.col(doc_id).alias("doc_id"), byte_size(F.col(text)).alias("size"),
                       text_crc32(F.col(text)).alias("text_crc32"), F.lit(1).cast("long").alias("one"),
                       *([F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")] if carry_row else []))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed, _ = written(running(thin, order, {"bytes_before": "size", "rows_before": "one"}), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    cut = placed.withColumn("shard", F.least(
        F.expr(f"(2 * bytes_before + size) * {shards} div {2 * total}"), F.lit(shards - 1)).cast("int"))
    first = cut.groupBy("shard").agg(F.min("rows_before").alias("first_row"))      # one row a shard
    return (cut.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("rows_before") - F.col("first_row")).alias("slot"), *(["row"] if carry_row else [])))


def write_shards(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each shard's rows in slot order under ``path/shard=<n>/`` and read them
    back as (row, slot, shard), ``row`` being the input row."""
    (shard_by_bytes(docs, shards, doc_id, text, carry_row=True).select("row", "slot", "shard")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    return docs.sparkSession.read.parquet(path)


def sharding_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    return shard_by_bytes(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


_CRC_TABLE = """(SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[],
    lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)))"""

ORACLE = f"""
WITH tbl AS {_CRC_TABLE},
texts AS (SELECT DISTINCT text, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT text, list_transform(range(length(h) // 2), lambda i:
    ((strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16
     + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT) AS bs FROM texts),
crcs AS (SELECT text, xor(list_reduce([4294967295::BIGINT] || bs,
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, tbl),
sized AS (SELECT doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT + {ROW_BYTES} AS size, text_crc32
  FROM documents d JOIN crcs c ON d.text IS NOT DISTINCT FROM c.text),
laid AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o - 1 AS row
  FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least((2 * before + size) * 24 // (2 * total), 23)::INT AS shard FROM laid)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""
