"""A training corpus from raw documents: five stages, each of them one operator over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. What it returns is written as Parquet in the shared folder and read
again as the next one's documents. All but the last return the columns that they got.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import credentials, minhash, mixing, queries, spm, toxicity
from folio.llm.common import checkpoint, remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores under its cut; it learns from this run's own documents and labels. Null and empty texts and
    all rows stay where there is nothing to learn from; rows that repeat score alike; an empty table gives an empty one."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, machine)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows that repeat an id with another text, and rows without an id, are documents of their own, told apart by a hash of id and text. Rows
    equal in both are one. Null and blank texts are near nothing and stay, once for each id. An empty table gives an empty one.
    """
    repeated = checkpoint(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").select("doc_id", F.lit(True).alias("_again")))
    if repeated.isEmpty():
        kept = minhash.dedup(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    # A null id is one of those told apart by text; the join leaves it out.
    told = F.when(F.coalesce("_again", F.col("doc_id").isNull()), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(F.col("doc_id"))
    rows = docs.join(repeated, "doc_id", "left").withColumn("_row", told)
    kept = minhash.dedup(rows, doc_id="_row").where("kept").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, ``n_chars``, where there is one, that of the text as it is now. Null and empty texts, repeated rows and an
    empty table stay what they are."""
    masked = credentials.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; null and blank texts hold no words of it. An empty table gives an empty one."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of every document of the mix; none for null and empty texts, as often as rows repeat."""
    return spm.encode(docs, public_tokenizers.path(queries.PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", one_of_each_group),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither a trained classifier nor balanced sampling, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    """The last stage's rows, read from its table; the tables of the stages before are removed once the next one is written."""
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
