"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, brown, dedup, infill, jaccard, mixing, passages, pii, records, search, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.integers("embedding").alias("vector"))
    found = topk.top_k(rows, "vec_id", "vector", F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda r: F.concat_ws(":", r["start"].cast("string"), r["stop"].cast("string")))
    return found.select(F.col("id").alias("doc_id"), "component_id", F.concat_ws(",", spans).alias("spans"))


def op4_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 5 == 1
    model, counts = brown.fit(docs, ~held_out("doc_id"))
    found = brown.score(docs, model, counts)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Rules of the host lists: verdict, host (with its subdomains), beginning of the path.
RULES = (
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
)


def op5_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(_table(spark, sf_dir, "pages"), RULES).drop("trust", "distrust")


def op6_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *(F.size(pii.of_kind(F.col("exact"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.listed(F.col("exact")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(_table(spark, sf_dir, "documents"))
    found = search.search(index, _table(spark, sf_dir, "benchmark"), "item_id", k=10)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    seed = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cut = infill.split_form(docs, seed)
    return cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    path = scratch_path(spark, "records")
    records.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary, end_id=2)
    return records.read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {q.__name__: q for q in (op1_mix_sources, op2_topk_threshold, op3_compact_windows, op4_class_bigrams, op5_url_links, op6_pii_boosted, op7_byte_bpe, op8_multi_index_dedup, op9_jaccard_join, op10_toxicity,
                                   op11_hybrid_search, op12_fill_in_middle, op13_token_records)}
