"""From documents to a training corpus: quality, near-duplicates, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of ``documents``; the last returns token ids. Each stage has its operator's defined results
for null, empty, repeated and extra values, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.llm import minhash, mixing, quality, secrets, sentencepiece_bpe
from methylspark.llm.queries import tokenizer_path
from methylspark.llm.tables import DOCUMENTS, Written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs.select(*DOCUMENTS))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, 0.8 or more alike."""
    return minhash.keep_one(docs.select(*DOCUMENTS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind."""
    return secrets.redact(docs.select(*DOCUMENTS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, so that sources meet their targets."""
    docs, sources = docs.select(*DOCUMENTS), F.array("source")
    mixed, _ = mixing.mix(docs, sources)
    return mixing.take(docs, sources, mixed)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, lang, n_tokens, ids, text_sha256, decoded_sha256)``."""
    path, carry = tokenizer_path("piece_bpe_32k.model"), ("doc_id", "source", "lang", "text_sha256")
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sentencepiece_bpe.round_trip(marked, path, carry=carry).select(
        "doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
        "text_sha256", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", keep_good), ("minhash_near_dedup", keep_one),
          ("secret_scan", hide_secrets), ("mixture", mix), ("sentencepiece", tokenize)]

#: Signatures, mixing and byte-pair merges have no SQL form; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``; what each one keeps is written to the shared folder."""
    keep = Written(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
