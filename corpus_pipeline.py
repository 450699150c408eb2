"""From documents to token ids: toxic texts and near copies go, personal data is masked, sources are mixed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillgood.llm import bpe, jaccard, mixing, pii, toxicity
from stillgood.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents, then rejects every text that scores 0.3 or more."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard of 0.8 or more on five words, the smallest id stays."""
    return jaccard.one_per_component(docs, n=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars``, if there is one, follows a changed text.

    Null texts and texts without personal data stay as they are; every row stays, repeated ones too.
    """
    found = pii.find(docs, keep=True)
    text = pii.redact(F.col("row.text"), F.col("spans"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (little-endian unsigned 32-bit integers) of every text, and proof that they decode to it."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return ids.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("encode", encode_texts),
]
#: The learned stages are not SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
