"""The corpus queries, with the parameters that production uses, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm._store import table
from seqloom.llm.filter_audit import ORACLE as FILTER_SQL
from seqloom.llm.filter_audit import audit
from seqloom.llm.hard_negatives import ORACLE as NEGATIVES_SQL
from seqloom.llm.hard_negatives import integer_vectors, mine, relabelled
from seqloom.llm.html_crf import extract_main_text
from seqloom.llm.lsa import find_leaks
from seqloom.llm.pieces import encode_samples
from seqloom.llm.quality import quality_posteriors
from seqloom.llm.secrets import secret_digests
from seqloom.llm.simhash import simhash_components
from seqloom.llm.suffixes import ORACLE as REPEATS_SQL
from seqloom.llm.suffixes import remove_repeats
from seqloom.llm.syncmers import edit_fingerprints
from seqloom.llm.token_table import encoded_digests
from seqloom.llm.tokens import count_tokens
from seqloom.llm.toolcalls import ORACLE as TOOL_CALL_SQL
from seqloom.llm.toolcalls import conversation_calls


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, max_bits=3)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_calls(table(spark, sf_dir, "conversations"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(integer_vectors(table(spark, sf_dir, "embeddings"))))


def op13_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts, "op2_simhash": op2_simhash, "op3_main_text": op3_main_text, "op4_decontamination": op4_decontamination, "op5_secrets": op5_secrets, "op6_sampled_pieces": op6_sampled_pieces, "op7_quality": op7_quality, "op8_syncmers": op8_syncmers, "op9_tool_calls": op9_tool_calls, "op10_suffix_dedup": op10_suffix_dedup, "op11_filter_audit": op11_filter_audit, "op12_hard_negatives": op12_hard_negatives, "op13_token_table": op13_token_table}

ORACLES: dict[str, str] = {"op9_tool_calls": TOOL_CALL_SQL, "op10_suffix_dedup": REPEATS_SQL, "op11_filter_audit": FILTER_SQL, "op12_hard_negatives": NEGATIVES_SQL}
