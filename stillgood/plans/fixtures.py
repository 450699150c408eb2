"""Requests, answers and decisions derived from the given tables.

Every frame is a plain projection, aggregate or join of whole tables, so the
work of each registered query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scores import epoch_us, expires_us
from ..functions.text import cache_key
from ..operators.history import requests_with_history, turn_pairs
from ..operators.knn import knn_join
from ..operators.rates import api_rate
from ..operators.ranking import topk

BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
MINUTE_US = 60_000_000
DAY_US = 86_400_000_000

# Word lists and thresholds suited to the invented vocabulary of the tables.
FIXTURE_VOLATILE = ("now", "the")
FIXTURE_SLOW = ("ing", "tion")
FIXTURE_PHRASES = ("thing", "tionen", "eaux")
FIXTURE_CONFIG = C.CacheConfig(
    fixed_threshold=0.40,
    busy_threshold=0.35, normal_threshold=0.40, quiet_threshold=0.45,
    floor_threshold=0.35, rate_seconds=3600,
)
CLASSES = ("Slow-Moving", "Static", "Volatile")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_category(event_type: Column) -> Column:
    return (
        F.when(event_type == "signup", C.STATIC)
        .when(event_type.isin("purchase", "view"), C.SLOW)
        .otherwise(C.VOLATILE)
    )


def label_category(label: Column) -> Column:
    return F.when(label <= 3, C.STATIC).when(label <= 6, C.SLOW).otherwise(C.VOLATILE)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed request log: one request per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        epoch_us(F.col("ts")).alias("at_us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        event_category(F.col("event_type")).alias("true_category"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision log with a source per event, spread over all six outcomes."""
    k = F.col("k")
    source = (
        F.when(k <= 9, C.REDIS_HIT).when(k <= 39, C.CACHE_HIT_FAST).when(k <= 49, C.CACHE_HIT_VERIFIED)
        .when(k <= 74, C.GEMINI_API).when(k <= 97, C.GEMINI_VOLATILE).otherwise(C.ERROR)
    )
    guess = F.when(F.col("user_id") % 3 == 0, C.SLOW).otherwise(F.col("true_category"))
    return events(spark, sf_dir).withColumn("source", source).withColumns(
        {
            "predicted_category": F.when(F.col("source") == C.GEMINI_VOLATILE, C.VOLATILE)
            .when(F.col("source").isin(C.GEMINI_API, C.CACHE_HIT_FAST), guess),
            "latency": F.col("value"),
            "admission": F.when(
                F.col("source") == C.GEMINI_API,
                F.when(F.col("value") < 40, "admitted").when(F.col("value") < 80, "blocked").otherwise("error"),
            ),
            "rewritten": (F.col("event_type") == "view") & (F.col("value") > 20),
        }
    )


def with_rate(log: DataFrame) -> DataFrame:
    return api_rate(log, F.col("source").isin(C.GEMINI_API, C.GEMINI_VOLATILE), "at_us", 3600)


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored answer per document; copies share a key."""
    category = (
        F.when(F.col("lang") == "en", C.STATIC).when(F.col("lang").isin("fr", "de"), C.SLOW).otherwise(C.VOLATILE)
    )
    cached = F.lit(BASE_US) + F.col("doc_id") * MINUTE_US
    return table(spark, sf_dir, "documents").select(
        cache_key(F.col("text")).alias("entry_key"),
        F.col("text").alias("query"),
        F.concat_ws(":", "source", "lang").alias("answer"),
        category.alias("category"),
        cached.alias("cached_us"),
        expires_us(cached, category).alias("expires_us"),
        "doc_id",
    )


def document_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer table holding the newest entry of every key."""
    newest = topk(document_entries(spark, sf_dir), ["entry_key"], [F.desc("cached_us")], 1)
    return newest.drop("rank", "doc_id")


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_with_history(table(spark, sf_dir, "conversations"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(table(spark, sf_dir, "conversations"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as requests and as entries of a leave-one-out search."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("req_id"), F.col("vec_id").alias("entry_key"),
        F.col("vec_id").alias("skip_key"), "embedding", "label",
    )


def neighbours(spark: SparkSession, sf_dir: str, k: int = 5, **options) -> DataFrame:
    """Each vector's nearest others."""
    v = vectors(spark, sf_dir)
    return knn_join(v, v, k, **options)


def add_scores(candidates: DataFrame, request: Column, entry: Column) -> DataFrame:
    """Stand-in pair scores: a mix of similarity and the two ids."""
    j = F.pmod(request * 31 + entry * 17, F.lit(10))
    return candidates.withColumns(
        {
            "rerank_score": F.round(2 * F.col("similarity") + j / 50.0, 6),
            "logit_ab": (j - 3).cast("double"),
            "logit_ba": (j - 4).cast("double"),
            "answer_relevance": F.round(5 * F.col("similarity"), 6),
        }
    )


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_scores(neighbours(spark, sf_dir), F.col("req_id"), F.col("entry_key"))


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic tier: one entry per vector; part of the categories is missing."""
    text = F.concat(F.lit("vec "), F.col("vec_id").cast("string"))
    category = F.when(F.col("label") <= 3, C.STATIC).when(F.col("label") <= 6, C.SLOW)
    return table(spark, sf_dir, "embeddings").select(
        cache_key(text).alias("entry_key"),
        text.alias("query"),
        F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("answer"),
        category.alias("category"),
        F.lit(BASE_US).alias("cached_us"),
        expires_us(F.lit(BASE_US), category).alias("expires_us"),
        "embedding",
        F.col("vec_id").alias("x_vec_id"),
    )


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tier as a write log: signups and purchases store their answer at once."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase"))
    at = F.col("at_us") + 1
    answer = F.when(F.col("k") == 0, F.lit("")).otherwise(F.concat(F.lit("stored "), F.col("event_id").cast("string")))
    return e.select(
        cache_key(F.col("key")).alias("entry_key"),
        at.alias("cached_us"),
        expires_us(at, F.col("true_category")).alias("expires_us"),
        answer.alias("answer"),
        F.col("true_category").alias("category"),
        F.col("event_id").alias("seq"),
    )


def event_requests(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Requests of the flagship cascade: every event, with its user's vector; dealt by user into ``parts``, if given."""
    e = with_rate(decisions(spark, sf_dir))
    e = e if parts is None else e.repartition(parts, "user_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    own = cache_key(F.concat(F.lit("vec "), F.col("user_id").cast("string")))
    return e.join(v, "user_id").select(
        F.col("event_id").alias("req_id"),
        F.col("key").alias("query"),
        "at_us", "rate",
        F.col("true_category").alias("label"),
        F.when(F.col("k") != 13, F.round(0.4 + F.col("k") / 200.0, 4)).alias("confidence"),
        "embedding",
        own.alias("skip_key"),
    )


def event_scores(candidates: DataFrame) -> DataFrame:
    user = F.split("query", ":")[0].cast("long")
    return add_scores(candidates, user, F.col("entry_x_vec_id"))


def judge_reply(signal: Column, prompt: Column) -> Column:
    """Stand-in judge: a score spelled out from the prompt's length."""
    step = F.when(signal == "reusability", 1).when(signal == "confidence", 7).otherwise(13)
    score = F.pmod(F.length(prompt) * step, F.lit(101)) / 100.0
    return F.concat(F.lit("Score: "), score.cast("string"))


def probabilities(embedding: Column) -> Column:
    """Class probabilities from the first three dimensions."""
    powers = [F.exp(4.0 * embedding[i].cast("double")) for i in range(3)]
    total = powers[0] + powers[1] + powers[2]
    return F.array(*[p / total for p in powers])


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("Question"),
        label_category(F.col("label")).alias("Temporal_Category"),
        "embedding",
    )


def successor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector next to the one with the following id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return v.join(after, "vec_id")


