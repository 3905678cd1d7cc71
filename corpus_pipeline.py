"""The corpus pipeline: five stages over ``documents``, each an operator of ``candlewick.llm``.

A stage takes (spark, docs, sf_dir), works on every row that the stage before
it kept, and returns the rows it keeps with the columns of ``documents``; the
last one returns what its token files hold. Stages are written as Parquet and
read again, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.common import drop, table, written
from candlewick.llm.decontam import drop_contaminated
from candlewick.llm.mixing import mix_documents
from candlewick.llm.queries import tokenizer_path
from candlewick.llm.simhash import keep_one
from candlewick.llm.token_files import token_digest
from candlewick.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source meets its target."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order; a row (doc_id, start, n_tokens, ids_crc32) a document."""
    return token_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Trained models, fingerprints and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
