"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bm25_wand, chat_format, collocations, embedding_pq, minhash_super, packing, permuterm, quality_compression,
               rule_votes, source_mixing, token_binary, token_counts, toxicity_fm)
from .common import held_out, saved
from ..session import scratch_path
from .oracle import ORACLE_SQL  # noqa: F401
from .tokenizing import BYTE_BPE, PIECE_BPE, WORD_BPE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_compression.fit_compression(docs, labels, "quality")
    scored = quality_compression.score_quality(docs.select("doc_id", "text"), model, 0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_binary.write_token_files(_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_binary.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25_wand.search(docs, asked, k=10)


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    written = saved(chat_format.format_conversations(rows.unionByName(extra), BYTE_BPE), "chat")
    return chat_format.read_conversations(written, BYTE_BPE)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_power_of_two(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=2, max_length=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_super.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


#: Target shares of tokens; a number is an exponent on the observed shares.
MIX = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.7}


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = source_mixing.fit_topics(docs)
    return source_mixing.mix(docs, MIX, model).select("doc_id", "lang", "source", "topic", "tokens", "probability")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity_fm.fit_factor_machine(docs, labels, "toxic")
    scored = toxicity_fm.score_toxicity(docs.select("doc_id", "text"), model, 0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.spelling_variants(permuterm.word_counts(_table(spark, sf_dir, "documents")), ratio=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=10, top=2000, absorb=50)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = rule_votes.quality_votes(_table(spark, sf_dir, "documents"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_top_documents": op3_top_documents,
    "op4_vector_duplicates": op4_vector_duplicates,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_source_mix": op9_source_mix,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}
