"""Registered queries of the corpus operators and the SQL of those that SQL can express.

Each query applies its operator, with production parameters, to the whole of
its table; digest columns are derived here from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import hamming_topk, mixing, sharding
from candlewick.llm.collocations import ORACLE as COLLOCATIONS, collocations
from candlewick.llm.common import table
from candlewick.llm.context_mixing import score_language
from candlewick.llm.decontam import contaminated_pairs
from candlewick.llm.hard_negatives import ORACLE as HARD_NEGATIVES, hard_negatives
from candlewick.llm.pii import pii_digest
from candlewick.llm.quality import score_quality
from candlewick.llm.secret_scan import secrets_digest
from candlewick.llm.simhash import simhash_components
from candlewick.llm.token_files import token_digest
from candlewick.llm.toxicity import score_toxicity


def tokenizer_path() -> str:
    """The vocabulary file of the installed public tokenizers (same place on every machine)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.topk_of_every_20th(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_token_output": op6_token_output,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_lm_scoring": op13_lm_scoring,
}

LLM_ORACLES: dict[str, str] = {
    "op3_hamming_topk": hamming_topk.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_collocations": COLLOCATIONS,
}
