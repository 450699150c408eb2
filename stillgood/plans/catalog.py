"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores, text, vectors
from ..functions.plugins import Plugins
from ..operators import (
    admission, history, knn, lifetime, lookup, memo, metrics, ranking, replay, store,
)
from ..session import scratch_path, written
from ..sources import io
from ..streaming import streams
from . import fixtures as X
from .answer_cache import AnswerCache
from .cascade import cascade, prototype_cascade, resolve_context

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENT_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- sources and sinks -------------------------------------------------------

@register
def scan_requests(spark, sf_dir):
    path = scratch_path(spark, "requests.csv")
    docs = X.table(spark, sf_dir, "documents")
    io.write_results(
        docs.select(
            F.col("text").alias("query"), F.col("lang").alias("primary_category"),
            F.col("source").alias("ground_truth_2026"),
        ),
        path,
    )
    return io.scan_requests(spark, path)


@register
def scan_labelled(spark, sf_dir):
    path = scratch_path(spark, "labelled") + ".csv"
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), C.STATIC).when(
        F.col("quality") == 1, C.SLOW
    ).otherwise(C.VOLATILE)
    rows = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id")
    io.write_results(rows.select(F.col("text").alias("Question"), label.alias("Temporal_Category")), path)
    return io.scan_labelled(spark, path)


@register
def scan_lines(spark, sf_dir):
    path = scratch_path(spark, "lines.txt")
    X.table(spark, sf_dir, "documents").select("text").write.text(path)
    return io.scan_lines(spark, path)


@register
def scan_conversations(spark, sf_dir):
    path = scratch_path(spark, "requests.json")
    X.conversation_requests(spark, sf_dir).select("query", "history").write.json(path)
    last = history.last_context(F.col("history"))
    return io.scan_conversations(spark, path).select(
        "query", F.size("history").cast("long").alias("n_history"),
        last["query"].alias("last_query"), last["response"].alias("last_response"),
    )


@register
def scan_cache(spark, sf_dir):
    return _stored_cache(spark, sf_dir).groupBy("category").agg(
        F.count("*").alias("entries"), F.min("cached_us").alias("oldest_us"), F.max("cached_us").alias("newest_us")
    )


@register
def sink_results(spark, sf_dir):
    path = scratch_path(spark, "results.csv")
    rows = X.decisions(spark, sf_dir).select("event_id", "true_category", "source", "latency")
    io.write_results(rows, path)
    return io.read_csv(spark, path, "event_id long, true_category string, source string, latency double")


@register
def sink_checkpoint(spark, sf_dir):
    rows = X.decisions(spark, sf_dir).select("event_id", "source", "predicted_category", "latency")
    _, as_json = io.write_checkpoint(rows, scratch_path(spark, "results"))
    schema = "event_id long, source string, predicted_category string, latency double"
    return spark.read.schema(schema).json(as_json)


@register
def sink_summary(spark, sf_dir):
    path = scratch_path(spark, "summary.json")
    io.write_summary(metrics.evaluation_summary(X.decisions(spark, sf_dir)), path)
    sources = ", ".join(
        f"{s}: long"
        for s in (*C.HIT_SOURCES, C.GEMINI_API, C.GEMINI_VOLATILE, C.ERROR)
    )
    metric_names = (
        "effective_hit_rate_percent", "api_reduction_percent", "staleness_rate_percent", "cache_integrity",
        "ttl_category_accuracy_percent", "cache_hit_latency_ms", "gemini_latency_ms", "speedup_factor",
    )
    fields = ", ".join(f"{m}: double" for m in metric_names)
    schema = (
        f"timestamp string, total_queries_tested long, metrics struct<{fields}>, "
        f"gate3 struct<admitted: long, blocked: long, total: long>, source_breakdown struct<{sources}>"
    )
    return spark.read.schema(schema).json(path).select(
        "total_queries_tested", "metrics.*", "gate3.*", "source_breakdown.*"
    )


# -- text and history --------------------------------------------------------

@register
def cache_key(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.col("text")).alias("entry_key"))


@register
def needs_context(spark, sf_dir):
    users = X.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", text.needs_context(F.col("text")).alias("needs_context"))


@register
def history_text(spark, sf_dir):
    return X.conversation_requests(spark, sf_dir).select(
        "conv_id", "turn", text.history_text(F.col("history")).alias("history_text")
    )


@register
def rewrite_prompt(spark, sf_dir):
    return X.conversation_requests(spark, sf_dir).select(
        "conv_id", "turn", text.rewrite_prompt(F.col("query"), F.col("history")).alias("prompt")
    )


@register
def rewrite_prompt_strict(spark, sf_dir):
    return X.conversation_requests(spark, sf_dir).select(
        "conv_id", "turn", text.rewrite_prompt_strict(F.col("query"), F.col("history")).alias("prompt")
    )


@register
def rewrite_apply(spark, sf_dir):
    rewriter = Plugins(rewriter=lambda prompt: F.upper(prompt))
    return resolve_context(X.conversation_requests(spark, sf_dir), rewriter).select(
        "conv_id", "turn", "query", "rewritten"
    )


@register
def chat_messages(spark, sf_dir):
    return (
        X.conversation_requests(spark, sf_dir)
        .select("conv_id", "turn", F.posexplode(text.chat_messages(F.col("query"), F.col("history"))).alias("pos", "m"))
        .select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")
    )


@register
def lifetime_keywords(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", text.lifetime_keywords(F.col("text"), X.FIXTURE_VOLATILE, X.FIXTURE_SLOW).alias("category")
    )


@register
def lifetime_ttl(spark, sf_dir):
    label = F.col("true_category")
    return X.events(spark, sf_dir).select(
        "event_id", scores.label_seconds(label).alias("ttl_seconds"),
        scores.label_display(label).alias("ttl_display"),
        scores.expires_us(F.col("at_us"), label, C.CLASSIFIER_LIFETIMES).cast("double").alias("expires_us"),
    )


@register
def judge_prompts(spark, sf_dir):
    return (
        X.conversation_pairs(spark, sf_dir)
        .select("conv_id", "turn", F.explode(text.judge_prompts(F.col("query"), F.col("response"))).alias("p"))
        .select("conv_id", "turn", "p.signal", "p.prompt")
    )


@register
def text_clip(spark, sf_dir):
    t = F.col("text")
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", text.clip_relevance(t).alias("for_relevance"), text.clip_report(t).alias("for_report"),
        text.clip_listing(t).alias("for_listing"),
    )


@register
def cacheability_filter(spark, sf_dir):
    blocked = text.uncacheable(F.col("text"), X.FIXTURE_PHRASES)
    return X.table(spark, sf_dir, "documents").select("doc_id", blocked.alias("blocked"))


@register
def parse_score(spark, sf_dir):
    raw = F.concat(F.lit("Score "), F.col("value").cast("string"), F.lit(" / "), (F.col("k") / 100.0).cast("string"))
    return X.events(spark, sf_dir).select("event_id", text.parse_score(raw).alias("score"))


# -- vectors, scores, predicates ---------------------------------------------

@register
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return (
        X.table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode(vectors.l2_normalize(scaled)).alias("pos", "x"))
        .select("vec_id", F.col("pos").cast("long").alias("pos"), vectors.rounded(F.col("x")).alias("x"))
    )


@register
def cosine_pairs(spark, sf_dir):
    similarity = vectors.cosine(F.col("embedding"), F.col("next_embedding"))
    return X.successor_pairs(spark, sf_dir).select("vec_id", vectors.rounded(similarity).alias("similarity"))


@register
def pyfs_score(spark, sf_dir):
    ab = (F.col("l_quantity") - 25) / 10
    ba = (F.col("l_discount") - 0.05) * 40
    return (
        X.table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", scores.pyfs(ab, ba).alias("p"))
        .select(
            "l_orderkey", "l_linenumber",
            *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in ("score", "mu", "nu", "pi", "neutral")],
        )
    )


@register
def dynamic_threshold(spark, sf_dir):
    rated = X.with_rate(X.decisions(spark, sf_dir))
    return rated.select("event_id", "rate", scores.dynamic_threshold(F.col("rate")).alias("threshold"))


@register
def fast_accept(spark, sf_dir):
    near = X.neighbours(spark, sf_dir, k=1)
    return near.select(
        "req_id", "entry_key", scores.fast_accept(F.col("similarity"), 0.40).alias("accepted")
    )


@register
def floor_accept(spark, sf_dir):
    near = X.neighbours(spark, sf_dir, k=1)
    return near.filter(scores.floor_accept(F.col("similarity"), 0.35)).select("req_id", "entry_key", "similarity")


@register
def verify_pair(spark, sf_dir):
    best = ranking.best_candidate(X.scored_candidates(spark, sf_dir))
    nu = scores.pyfs(F.col("logit_ab"), F.col("logit_ba"))["nu"]
    return best.select(
        "req_id", "entry_key", F.round(nu, 6).alias("nu"),
        scores.verify_pair(F.col("rerank_score"), nu, F.col("answer_relevance")).alias("verified"),
    )


@register
def admission_score(spark, sf_dir):
    k = F.col("k")
    verdict = scores.admission(
        F.when(k < 95, k / 100.0), F.pmod(k * 7, F.lit(101)) / 100.0, F.pmod(k * 13, F.lit(101)) / 100.0, 0.5
    )
    return X.events(spark, sf_dir).select("event_id", verdict.alias("v")).select("event_id", "v.*")


@register
def volatile_bypass(spark, sf_dir):
    bypass = F.col("true_category") == C.VOLATILE
    return X.events(spark, sf_dir).select(
        "event_id", bypass.alias("bypass"),
        F.when(~bypass, text.cache_key(F.col("key"))).alias("lookup_key"),
    )


@register
def confidence_gate(spark, sf_dir):
    gated = scores.confidence_gate(X.probabilities(F.col("embedding")), X.CLASSES)
    return (
        X.table(spark, sf_dir, "embeddings").select("vec_id", gated.alias("g"))
        .select("vec_id", "g.label", F.round("g.confidence", 6).alias("confidence"), "g.stage")
    )


@register
def fail_safe_label(spark, sf_dir):
    labelled = X.table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, C.STATIC).otherwise(C.SLOW).alias("label"),
        (0.5 + F.col("toxic") / 4.0).alias("confidence"),
    )
    rows = X.table(spark, sf_dir, "documents").select("doc_id").join(labelled, "doc_id", "left")
    safe = scores.fail_safe_label(F.col("label"), F.col("confidence"))
    return rows.select("doc_id", safe.alias("s")).select("doc_id", "s.*")


@register
def prob_map(spark, sf_dir):
    one_hot = scores.prob_map(C.CLASSES, label=X.label_category(F.col("label")))
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(one_hot).alias("class", "prob"))


# -- joins -------------------------------------------------------------------

@register
def exact_lookup(spark, sf_dir):
    e = X.events(spark, sf_dir)
    requests = e.select("event_id", "at_us", text.cache_key(F.col("key")).alias("entry_key"))
    return lookup.asof_lookup(requests, X.event_writes(spark, sf_dir)).select(
        "event_id", "hit", "answer", "category", F.col("cached_us").cast("double").alias("cached_us")
    )


@register
def exact_lookup_snapshot(spark, sf_dir):
    """Documents as requests, one day after the base time, against the stored table."""
    requests = X.table(spark, sf_dir, "documents").select(
        "doc_id", text.cache_key(F.col("text")).alias("entry_key"), F.lit(X.BASE_US + 4 * X.DAY_US).alias("at_us")
    )
    return lookup.exact_lookup(requests, X.document_cache(spark, sf_dir)).select("doc_id", "hit", "answer", "category")


def _stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document answers as a table that was written before."""
    stored = store.KeyedTable(spark, scratch_path(spark, "cache"))
    stored.merge(0, X.document_cache(spark, sf_dir))
    return stored.read()


def _ranked(df):
    return df.select("req_id", F.col("rank").cast("long").alias("rank"), "entry_key", "similarity")


@register
def knn_join(spark, sf_dir):
    return _ranked(X.neighbours(spark, sf_dir))


@register
def knn_join_cells(spark, sf_dir):
    return _ranked(X.neighbours(spark, sf_dir, method="cells"))


def _probed(spark, sf_dir):
    measured = F.col("req_id") % 100 == 0
    return X.neighbours(spark, sf_dir, method="probes", target_recall=0.9, measured=measured)


@register
def knn_join_approx(spark, sf_dir):
    """Per request: neighbours found, whether their similarities are the true ones, whether all of them reach a recall of 0.9."""
    found = written(_probed(spark, sf_dir), "probed")
    v = X.vectors(spark, sf_dir)
    reached = knn.recall(found, X.neighbours(spark, sf_dir)).first()["recall"]
    pairs = found.join(v.select("req_id", F.col("embedding").alias("a")), "req_id")
    pairs = pairs.join(v.select("entry_key", F.col("embedding").alias("b")), "entry_key")
    true = F.abs(vectors.cosine(F.col("a"), F.col("b")) - F.col("similarity")) <= 0.000001
    rows = pairs.select("req_id", true.alias("ok")).groupBy("req_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("true_similarity"))
    return rows.withColumn("recall_reached", F.lit(reached is not None and reached >= 0.9))


@register
def knn_recall(spark, sf_dir):
    """Share of all exact neighbours that the probes found."""
    return knn.recall(_probed(spark, sf_dir), X.neighbours(spark, sf_dir))


@register
def nearest_one(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return knn.nearest_one(v, v, 0.35).select("req_id", "entry_key", "similarity")


@register
def memo_score_join(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    scored = memo.memo_score(docs, ["text"], lambda t: F.round(F.length(t) / (F.length(F.regexp_replace(t, " ", "")) + 1), 6))
    return scored.select("doc_id", "score")


@register
def memo_score_batches(spark, sf_dir):
    """The same scores from a kept table: texts of the first batch are not scored again in the second."""
    docs = X.table(spark, sf_dir, "documents")
    scorer = lambda t: F.round(F.length(t) / (F.length(F.regexp_replace(t, " ", "")) + 1), 6)
    kept = memo.ScoreTable(spark, scratch_path(spark, "scores"), capacity=10**9)
    kept.score(docs.filter("lang = 'en'"), ["text"], scorer, batch=0)
    return kept.score(docs, ["text"], scorer, batch=1).select("doc_id", "score")


@register
def label_vs_prediction(spark, sf_dir):
    truth = X.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("truth"))
    said = X.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("predicted")
    )
    return truth.join(said, "doc_id").select("doc_id", "truth", "predicted", (F.col("truth") == F.col("predicted")).alias("correct"))


@register
def evict_anti_join(spark, sf_dir):
    cache = _stored_cache(spark, sf_dir)
    return store.remove_entries(cache, store.evicted(cache, 100)).select("entry_key")


# -- aggregations ------------------------------------------------------------

def _over_decisions(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(X.decisions(spark, sf_dir))


for _name, _fn in {
    "decision_counters": metrics.decision_counters,
    "live_stats": metrics.live_stats,
    "effective_hit_rate": metrics.effective_hit_rate,
    "staleness_rate": metrics.staleness_rate,
    "stale_served_rate": metrics.stale_served_rate,
    "label_accuracy": metrics.label_accuracy,
    "category_breakdown": metrics.category_breakdown,
    "latency_summary": metrics.latency_summary,
    "latency_percentiles": lambda d: metrics.latency_percentiles(metrics.latency_histogram(d)),
    "source_breakdown": metrics.source_breakdown,
    "admission_integrity": metrics.admission_integrity,
    "batch_throughput": metrics.batch_throughput,
    "cost_summary": metrics.cost_summary,
}.items():
    _over_decisions(_name, _fn)


@register
def cache_sizes(spark, sf_dir):
    return store.table_sizes(X.document_cache(spark, sf_dir), X.event_writes(spark, sf_dir).select("entry_key").distinct())


@register
def wrong_hits(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings")
    rows = X.decisions(spark, sf_dir).select(
        "true_category", "source", "user_id", "k",
        F.col("user_id").cast("string").alias("ground_truth"), F.col("k").cast("string").alias("cached_response"),
    )
    rows = rows.join(v.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("truth_vector")), "user_id")
    rows = rows.join(v.select(F.col("vec_id").alias("k"), F.col("embedding").alias("served_vector")), "k")
    return metrics.wrong_hits(metrics.wrong_hit_rows(rows, 0.05))


@register
def classification_report(spark, sf_dir):
    return metrics.classification_report(X.table(spark, sf_dir, "labels"), "quality", "toxic")


@register
def one_vs_rest_counts(spark, sf_dir):
    return metrics.one_vs_rest_counts(X.table(spark, sf_dir, "labels"), "quality", "toxic")


@register
def class_weights(spark, sf_dir):
    weights = metrics.class_weights(X.table(spark, sf_dir, "embeddings"), "label")
    return weights.select("label", "n", F.round("weight", 6).alias("weight"))


@register
def policy_ablation(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    c = X.scored_candidates(spark, sf_dir)
    near = c.filter("rank = 1").select("req_id", F.col("entry_key").alias("near_key"), F.col("similarity").alias("near_sim"))
    best = ranking.best_candidate(c).withColumn("nu", scores.pyfs(F.col("logit_ab"), F.col("logit_ba"))["nu"])
    served = v.select(F.col("entry_key").alias("near_key"), F.col("label").alias("near_label"))
    rows = (
        v.select("req_id", "label").join(near, "req_id").join(best.drop("similarity", "entry_key", "rank"), "req_id")
        .join(served, "near_key")
    )
    fast = scores.fast_accept(F.col("near_sim"), 0.40)
    verified = scores.verify_pair(F.col("rerank_score"), F.col("nu"), F.col("answer_relevance"))
    stable = F.col("label") <= 6
    policies = {
        "full": stable & (fast | verified),
        "no_context": stable & (fast | verified) & (F.col("label") > 0),
        "no_lifetime": fast | verified,
        "no_verification": stable & (fast | (F.col("rerank_score") > 0.70)),
        "cosine_only": scores.floor_accept(F.col("near_sim"), 0.35),
    }
    return metrics.policy_ablation(rows, policies, F.col("near_label") != F.col("label"))


@register
def threshold_sweep(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    near = X.neighbours(spark, sf_dir, k=1).select("req_id", F.col("entry_key").alias("near_key"), "similarity")
    served = v.select(F.col("entry_key").alias("near_key"), F.col("label").alias("near_label"))
    rows = v.select("req_id", "label").join(near, "req_id").join(served, "near_key")
    return metrics.threshold_sweep(rows, "similarity", F.col("near_label") != F.col("label"))


@register
def baseline_policy(spark, sf_dir):
    """Flat one-day lifetime and flat cosine cut-off next to per-class lifetimes."""
    e = X.events(spark, sf_dir)
    storable = F.col("true_category") != C.VOLATILE
    flat = replay.ttl_replay(e, "key", "at_us", F.lit(X.DAY_US), "event_id")
    tiered = replay.ttl_replay(
        e.filter(storable), "key", "at_us", scores.label_seconds(F.col("true_category")) * 1_000_000, "event_id"
    )
    near = X.neighbours(spark, sf_dir, k=1)

    def line(rows: DataFrame, policy: str, hit) -> DataFrame:
        return rows.agg(F.lit(policy).alias("policy"), F.count_if(hit).alias("hits"))

    return (
        line(flat, "flat_24h", F.col("hit")).unionByName(line(tiered, "per_class", F.col("hit")))
        .unionByName(line(near, "flat_cosine", F.col("similarity") >= 0.35))
    )


# -- windows, order, table maintenance ---------------------------------------

@register
def history_last3(spark, sf_dir):
    return (
        X.conversation_requests(spark, sf_dir)
        .select("conv_id", "turn", F.posexplode("history").alias("pos", "m"))
        .select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("m.query").alias("past_query"), F.col("m.response").alias("past_response"))
    )


@register
def last_context(spark, sf_dir):
    last = history.last_context(F.col("history"))
    return X.conversation_requests(spark, sf_dir).select(
        "conv_id", "turn", last["query"].alias("last_query"), last["response"].alias("last_response")
    )


@register
def api_rate_60s(spark, sf_dir):
    return X.with_rate(X.decisions(spark, sf_dir)).select("event_id", "rate")


@register
def best_candidate(spark, sf_dir):
    best = ranking.best_candidate(X.scored_candidates(spark, sf_dir))
    return best.select("req_id", "entry_key", F.col("rank").cast("long").alias("rank"), "rerank_score")


@register
def topk_candidates(spark, sf_dir):
    scored = X.scored_candidates(spark, sf_dir).drop("rank")
    top = ranking.topk(scored, ["req_id"], [F.desc("answer_relevance"), F.asc("entry_key")], 3)
    return top.select("req_id", F.col("rank").cast("long").alias("rank"), "entry_key", "answer_relevance")


@register
def dedup_keep_first(spark, sf_dir):
    return ranking.dedup_keep_first(X.table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id")


@register
def stratified_split(spark, sf_dir):
    return ranking.stratified_split(X.table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "is_test")


@register
def stratified_folds(spark, sf_dir):
    folds = ranking.stratified_folds(X.table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return folds.select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


@register
def recent_log(spark, sf_dir):
    judged = X.decisions(spark, sf_dir).filter(F.col("admission").isNotNull())
    return ranking.recent(judged, "at_us", "event_id").select("event_id", "at_us", "admission")


@register
def cache_upsert(spark, sf_dir):
    cache = X.document_cache(spark, sf_dir)
    later = F.col("cached_us") + X.DAY_US
    fresh = X.document_entries(spark, sf_dir).filter("category = 'Static'").select(
        "entry_key", "query", F.concat(F.lit("new "), "answer").alias("answer"), "category",
        later.alias("cached_us"), (F.col("expires_us") + X.DAY_US).alias("expires_us"),
    )
    return store.upsert(cache, fresh).select("entry_key", "answer", "cached_us", "expires_us")


@register
def evict_oldest(spark, sf_dir):
    return store.evict(_stored_cache(spark, sf_dir), 100).select("entry_key", "cached_us")


@register
def cache_clear(spark, sf_dir):
    """Entries of the stored table before and after clearing it."""
    stored = store.KeyedTable(spark, scratch_path(spark, "cache"))
    stored.merge(0, X.document_cache(spark, sf_dir))
    before = written(stored.read().agg(F.count("*").alias("entries")), "sizes")
    stored.clear()
    after = stored.read().agg(F.count("*").alias("entries"))
    return before.withColumn("version", F.lit(0)).unionByName(after.withColumn("version", F.lit(1)))


@register
def exact_refresh(spark, sf_dir):
    return store.refresh_entries(_cascade(spark, sf_dir)).select(
        "entry_key", "answer", "category", "cached_us", "expires_us"
    )


# -- cascade, replay, streams ------------------------------------------------

def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    dynamic = C.CacheConfig(
        busy_threshold=0.35, normal_threshold=0.40, quiet_threshold=0.45, rate_seconds=3600
    )
    return cascade(
        X.event_requests(spark, sf_dir), X.event_writes(spark, sf_dir), X.vector_entries(spark, sf_dir),
        dynamic, score_candidates=X.event_scores, exact_is_log=True,
    )


@register
def cascade_batch(spark, sf_dir):
    return _cascade(spark, sf_dir).select(
        "req_id", "source", "category", "confidence", "answer", "similarity", "rerank_score",
        "answer_relevance", "mu", "nu", "pi", "cached_category",
    )


@register
def cascade_prototype(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings")
    entries = X.vector_entries(spark, sf_dir)
    query = F.concat(F.lit("vec "), F.col("vec_id").cast("string"))
    at = F.lit(X.BASE_US + X.DAY_US)
    requests = v.select(
        F.col("vec_id").alias("req_id"), query.alias("query"), "embedding", at.alias("at_us"),
        text.cache_key(query).alias("skip_key"),
    )
    keyed = v.filter("label < 2").select(
        text.cache_key(query).alias("entry_key"), F.lit(X.BASE_US).alias("cached_us"),
        F.when(F.col("label") == 1, F.lit(X.BASE_US + X.MINUTE_US)).alias("expires_us"),
        F.concat(F.lit("keyed "), F.col("vec_id").cast("string")).alias("answer"), F.lit("static").alias("category"),
    )

    def add(found: DataFrame) -> DataFrame:
        return X.add_scores(found, F.col("req_id"), F.col("entry_x_vec_id"))

    return prototype_cascade(
        requests, keyed, entries, X.FIXTURE_CONFIG, score_candidates=add, volatile=("7",), slow=("3",)
    ).select("req_id", "source", "answer", "category", "pair_score", "served_key")


def _replay_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.events(spark, sf_dir).select("event_id", "key", "at_us")


@register
def ttl_replay(spark, sf_dir):
    log = _replay_input(spark, sf_dir)
    return replay.ttl_replay(log, "key", "at_us", F.lit(3 * X.DAY_US), "event_id").select("event_id", "hit", "expires_us")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.file_stream(spark, sf_dir, EVENT_SCHEMA, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )


@register
def ttl_replay_stream(spark, sf_dir):
    log = _event_stream(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        scores.epoch_us(F.col("ts")).alias("at_us"), F.lit(3 * X.DAY_US).alias("ttl_us"),
    )
    path = scratch_path(spark, "replay")
    streams.run_append(streams.ttl_replay_stream(log), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(F.col("row_id").alias("event_id"), "hit", "expires_us")


@register
def cascade_stream(spark, sf_dir):
    """Two micro-batches of the same requests: the second meets what the first stored.

    The threshold of each request follows the calls of the half hour before it, of both batches.
    """
    path = scratch_path(spark, "cascade")
    # events are dealt before they get their vectors, and alike both times, so both passes have the same number of files
    requests = X.event_requests(spark, sf_dir, spark.sparkContext.defaultParallelism).drop("rate")
    files = 0
    for part in range(2):
        late = requests.withColumn("at_us", F.col("at_us") + part * X.MINUTE_US)
        late.write.mode("append").parquet(f"{path}/requests")
        files = files or len(spark.read.parquet(f"{path}/requests").inputFiles())
    source = streams.file_stream(spark, f"{path}/requests", _ddl(late), files_per_batch=files)
    config = C.CacheConfig(
        busy_threshold=0.35, normal_threshold=0.40, quiet_threshold=0.45, rate_seconds=1800, max_entries=10**9
    )
    cache = AnswerCache(spark, f"{path}/cache", config, Plugins(judge=X.judge_reply))
    streams.cascade_stream(source, cache, f"{path}/checkpoint").awaitTermination()
    return cache.decisions().select(
        F.col("batch").cast("long").alias("batch"), "req_id", "source", "threshold", "similarity"
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@register
def admit_and_store(spark, sf_dir):
    pairs = X.conversation_pairs(spark, sf_dir)
    category = F.when(F.length("query") % 2 == 0, C.STATIC).otherwise(C.SLOW)
    misses = pairs.select(
        "query", F.col("response").alias("answer"), category.alias("category"),
        (F.lit(X.BASE_US + 30 * X.DAY_US) + (F.col("conv_id") * 1000 + F.col("turn")) * 1_000_000).alias("at_us"),
    )
    _, table = admission.admit_and_store(
        misses, _stored_cache(spark, sf_dir), X.judge_reply, C.CacheConfig(max_entries=100), X.FIXTURE_PHRASES
    )
    return table.select("entry_key", "category", "cached_us", "expires_us")


@register
def admission_log(spark, sf_dir):
    pairs = X.conversation_pairs(spark, sf_dir).withColumnRenamed("response", "answer")
    judged = admission.judge_answers(pairs, X.judge_reply, 0.5, X.FIXTURE_PHRASES)
    return judged.select(
        "conv_id", "turn", "reusability_score", "confidence_score", "faithfulness_score", "combined_score",
        "admit_to_cache", "mode",
    )


@register
def stream_counters(spark, sf_dir):
    k = F.col("k")
    source = (
        F.when(k <= 9, C.REDIS_HIT).when(k <= 39, C.CACHE_HIT_FAST).when(k <= 49, C.CACHE_HIT_VERIFIED)
        .when(k <= 74, C.GEMINI_API).when(k <= 97, C.GEMINI_VOLATILE).otherwise(C.ERROR)
    )
    path = scratch_path(spark, "counters")
    counted = streams.counters_stream(_event_stream(spark, sf_dir).withColumn("source", source), window="1 hour")
    streams.run_update(counted, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.latest_updates(spark, f"{path}/rows", ["window_us", "source"])


@register
def stream_rate(spark, sf_dir):
    calls = _event_stream(spark, sf_dir).filter("k BETWEEN 50 AND 97")
    path = scratch_path(spark, "rate")
    rated = streams.rate_stream(calls, span="1 hour", slide="10 minutes")
    streams.run_update(rated, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.latest_updates(spark, f"{path}/rows", ["window_us"])


@register
def stream_rate_exact(spark, sf_dir):
    """The trailing hourly rate of every event, from four micro-batches in time order."""
    events = X.events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "at_us", F.col("k").between(50, 97).alias("is_call")
    )
    path = scratch_path(spark, "rate")
    events.limit(0).write.parquet(f"{path}/log")
    span = events.agg(F.min("at_us").alias("first"), F.max("at_us").alias("last")).first()
    if span["first"] is None:
        return events.select(F.col("row_id").alias("event_id"), F.lit(0).cast("long").alias("rate"))
    part = F.least(F.lit(3), F.floor((F.col("at_us") - span["first"]) * 4 / (span["last"] - span["first"] + 1)))
    for number in range(4):
        events.filter(part == number).write.mode("append").parquet(f"{path}/log")
        log = streams.file_stream(spark, f"{path}/log", _ddl(events), files_per_batch=10**9)
        streams.rate_batches(log, path, f"{path}/checkpoint", seconds=3600).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(F.col("row_id").alias("event_id"), "rate")


# -- learning ----------------------------------------------------------------

@register
def lifetime_train(spark, sf_dir):
    _, report = lifetime.train_lifetime(X.training_rows(spark, sf_dir))
    return report


def _trained(spark: SparkSession, sf_dir: str) -> lifetime.LifetimeModel:
    model, _ = lifetime.train_lifetime(X.training_rows(spark, sf_dir))
    return model


@register
def lifetime_predict(spark, sf_dir):
    scored = lifetime.predict_lifetime(_trained(spark, sf_dir), X.training_rows(spark, sf_dir))
    return scored.select("row_id", "label", F.round("confidence", 6).alias("confidence"), "stage", "ttl", "ttl_display")


@register
def lifetime_evaluate(spark, sf_dir):
    return lifetime.evaluate_lifetime(_trained(spark, sf_dir), X.training_rows(spark, sf_dir))


@register
def lifetime_cv(spark, sf_dir):
    return lifetime.cross_validate(X.training_rows(spark, sf_dir))


@register
def cv_summary(spark, sf_dir):
    return metrics.cv_summary(lifetime.cross_validate(X.training_rows(spark, sf_dir)))


@register
def lifetime_model_io(spark, sf_dir):
    path = scratch_path(spark, "model")
    _trained(spark, sf_dir).save(path)
    again = lifetime.LifetimeModel.load(spark, path)
    return lifetime.predict_lifetime(again, X.training_rows(spark, sf_dir)).select("row_id", "label", "stage")
