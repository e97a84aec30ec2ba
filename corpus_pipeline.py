"""A training-corpus pipeline of the library's operators over ``documents``.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and works on all rows its predecessor kept. Every stage but the last
returns the columns of documents. ``run`` writes each stage's rows as Parquet
and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import minhash_super, packing, quality_compression, source_mixing, toxicity_fm
from epispark.llm.common import saved
from epispark.llm.tokenizing import WORD_BPE

#: Toxicity as op10. Quality below op1's 0.7: as many bad documents found, half as many good ones lost (README).
QUALITY_LEAST, TOXICITY_MOST = 0.5, 0.3
#: Numbers rows while near copies are looked for.
ROW = "_row"
#: Target shares of tokens; a number is an exponent on the observed shares.
MIX = {"source": 0.8, "lang": 0.9, "topic": 0.95}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Null and empty texts have a score as well, repeated rows and ids one each;
    an empty table gives no rows; other columns are kept as they are."""
    model = quality_compression.fit_compression(docs, _labels(spark, sf_dir), "quality")
    scored = quality_compression.score_quality(docs, model, QUALITY_LEAST)
    return scored.where("predicted = 1").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject; rows are
    treated as in ``quality``."""
    model = toxicity_fm.fit_factor_machine(docs, _labels(spark, sf_dir), "toxic")
    scored = toxicity_fm.score_toxicity(docs, model, TOXICITY_MOST)
    return scored.where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id.

    Every row is a document: of repeated rows one stays, and rows without an
    id stay only if no copy has one. Texts without words are no copies of each
    other, so all of them stay. An empty table gives no rows."""
    rows = saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = minhash_super.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), words=5, percent=80)
    groups = rows.select(ROW, "doc_id").join(found.select(F.col("doc_id").alias(ROW), "component_id"), ROW)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(f"first.{ROW}"), ROW, "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic; a
    null source or language is a category of its own, repeated rows are drawn
    apart."""
    return source_mixing.mix(docs, MIX, source_mixing.fit_topics(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, a sequence each; a null or empty text is
    the end id alone."""
    packed = packing.pack_power_of_two(docs, WORD_BPE, end_id=2, max_length=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "bucket", "sequence_id",
                         "offset", "ids")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", pack)]

#: Trained classifiers and a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
