"""From raw documents to token files: quality, near-duplicates, benchmark passages, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import decontaminate, mixing, rules, simhash, subwords, token_orc
from vecloom.llm.text import crc_mod
from vecloom.session import scratch_path, snapshot

#: The model is fitted to the same labels as the operator's query.
HELD_OUT = (4, 2)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    n, held = HELD_OUT
    model = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", n) != held))
    return rules.keep_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one of the least id."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target: a document stays away, or has a row as often as it is taken."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document lies in them: ``(doc_id, start, n_tokens, ids_crc32)``."""
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(docs, path, subwords.load(TOKENIZER))
    return token_orc.token_index(token_orc.read_tokens(spark, path))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("mix", mixture), ("tokens", tokens)]

#: The classifier and the subset sums can't be written in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = snapshot(stage(spark, docs, sf_dir), name)
    return docs
