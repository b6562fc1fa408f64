"""Documents through five stages of corpus preparation.

Each stage takes (spark, docs, sf_dir), where docs are all rows that the stage before
kept, and returns rows with the columns of ``documents``; the last returns tokens.
``run`` applies the stages in order and writes each result to the shared folder, so
that lineage stays short and a lost executor repeats only its own tasks.

Defined cases: a null or empty text has no words and goes in the first stage; rows with
a null id pass the second and third stage and are encoded; a row repeated whole stays
once; further columns pass through up to the last stage; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decon, neardup, pii, quality
from sluice.staging import spread, stage

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their own and of their host."""
    judged = quality.apply_rules(docs)
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decon.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by tags; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are little-endian unsigned 32-bit integers."""
    made = bpe.round_trip(docs.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("pii", without_personal_data),
    ("byte_bpe", token_ids),
]

#: SQL has no near-duplicate components or merges; tests/llm/test_queries.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
