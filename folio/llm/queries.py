"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same.

Each callable takes (spark, sf_dir). The contracts' columns come first; more may follow.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import credentials, embed_dedup, media, minhash, mixing, pii, recompression, spm, token_counts, toxicity
from folio.llm.common import table
from folio.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

#: Tokenizer files, by environment or as installed.
TOKENIZER = os.environ.get("FOLIO_TOKENIZER", "byte_bpe_50k.json")
PIECES = os.environ.get("FOLIO_PIECES", "piece_bpe_32k.model")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.media_features(stored).drop("broken", "dct_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "evidence")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit().alias("over_limit"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_media, op2_toxicity, op3_token_counts, op4_embedding_dedup, op5_mixing, op6_minhash_dedup, op7_substring_dedup, op8_pii, op9_secrets, op10_sentencepiece)}
