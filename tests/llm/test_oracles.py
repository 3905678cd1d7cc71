"""The corpus queries that SQL can express against DuckDB, and the shape of all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from candlewick.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in LLM_QUERIES}
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries()) and set(LLM_ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = LLM_QUERIES[name](spark, SF)
    want = con.execute(LLM_ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_digest_columns(spark):
    want = {
        "op1_simhash": "doc_id fingerprint component_id", "op2_quality": "doc_id held_out score predicted",
        "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op6_token_output": "doc_id start n_tokens ids_crc32", "op7_mixing": "doc_id size source_size target taken",
        "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op10_toxicity": "doc_id held_out score predicted"}
    types = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "size": "bigint", "shard": "int",
             "slot": "bigint", "grown_shard": "int", "text_crc32": "bigint", "start": "bigint", "n_tokens": "bigint",
             "ids_crc32": "bigint", "target": "double", "taken": "bigint", "source_size": "bigint", "component_id": "bigint"}
    for name, columns in want.items():
        got = dict(LLM_QUERIES[name](spark, SF).dtypes)
        assert list(got)[:len(columns.split())] == columns.split(), name
        for column in columns.split():
            kind = "bigint" if column.startswith("n_") else types.get(column, "string")
            assert got[column] == kind, (name, column, got[column])
