"""The decision cascade for a table of requests against a table of answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.plugins import Plugins, Scorer, only_where, placeholder_answer
from ..functions.scores import (
    dynamic_threshold, fail_safe_label, fast_accept, pyfs, verify_pair,
)
from ..functions.text import (
    cache_key, chat_messages, clip_relevance, lifetime_keywords, rewrite_applies, rewrite_prompt,
    rewrite_prompt_strict, strip, trim_history,
)
from ..operators.admission import admit_and_store
from ..operators.feedback import settled_instants, with_thresholds
from ..operators.knn import knn_join, nearest_one
from ..operators.lookup import asof_lookup, exact_lookup
from ..operators.memo import memo_score
from ..operators.ranking import topk
from ..session import written

DECISION_COLUMNS = (
    "req_id", "query", "source", "category", "confidence", "answer", "similarity",
    "rerank_score", "answer_relevance", "mu", "nu", "pi", "served_key", "cached_category",
    "rewritten", "at_us", "threshold",
)


#: Adds a score column: (rows, input columns, scorer, name of the score).
ScoreOnce = Callable[[DataFrame, list[str], Scorer, str], DataFrame]


def _scored_once(df: DataFrame, scorer: Scorer, inputs: list[Column], out: str, mask: Column | None, once: ScoreOnce) -> DataFrame:
    """``out`` by one model row per distinct input; rows outside the mask are one input, NULL, and get NULL."""
    names = [f"_in{i}" for i in range(len(inputs))]
    masked = [c if mask is None else F.when(mask, c) for c in inputs]
    return once(df.withColumns(dict(zip(names, masked))), names, scorer, out).drop(*names)


def resolve_context(
    requests: DataFrame, plugins: Plugins, signals=C.CONTEXT_SIGNALS, turns: int = 3, strict: bool = False
) -> DataFrame:
    """Trim history and rewrite follow-ups; adds ``rewritten``.

    Only requests that have history and use a signal word reach the rewriter; a
    rewriter that returns nothing leaves the request as it was.  ``strict`` sends
    every request with history, with the whole of it in the prompt.
    """
    if "history" not in requests.columns:
        return requests.withColumn("rewritten", F.lit(False))
    trimmed = requests if strict else requests.withColumn("history", trim_history(F.col("history"), turns))
    if plugins.rewriter is None:
        return trimmed.withColumn("rewritten", F.lit(False))
    query, history = F.col("query"), F.col("history")
    if strict:
        applies, prompt = F.coalesce(F.size(history), F.lit(0)) > 0, rewrite_prompt_strict(query, history)
    else:
        applies, prompt = rewrite_applies(query, history, signals), rewrite_prompt(query, history, signals)
    said = _scored_once(trimmed, plugins.rewriter, [prompt], "_said", applies, memo_score)
    out = F.when(applies, F.col("_said"))
    return (
        said.withColumn("_out", F.coalesce(strip(out) if strict else out, query)).drop("_said")
        .withColumn("rewritten", F.col("_out") != query)
        .withColumn("query", F.col("_out")).drop("_out")
    )


def label_requests(requests: DataFrame, plugins: Plugins, once: ScoreOnce = memo_score) -> DataFrame:
    """Lifetime label and confidence; anything unlabelled is treated as volatile.

    The classifier sees each distinct text once.
    """
    if plugins.classifier is not None:
        requests = once(requests, ["query"], plugins.classifier, "_l")
        requests = requests.withColumns(
            {"label": F.col("_l.label"), "confidence": F.col("_l.confidence")}
        ).drop("_l")
    for name, kind in (("label", "string"), ("confidence", "double")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    safe = fail_safe_label(F.col("label"), F.col("confidence"))
    return requests.withColumn("_l", safe).withColumns(
        {"label": F.col("_l.label"), "confidence": F.col("_l.confidence")}
    ).drop("_l")


def vector_id(embedding: Column) -> Column:
    """128 bits that stand for a vector; NULL for none."""
    digest = F.concat(F.hex(F.xxhash64(embedding)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), embedding)))
    # the hash passes over missing elements
    gaps = F.exists(embedding, lambda x: x.isNull())
    return F.when(gaps, F.md5(F.to_json(F.struct(embedding)))).when(embedding.isNotNull(), digest)


def vectors_apart(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with ``vector_id`` in place of ``embedding``, and each vector once, written.

    Requests repeat and so do their vectors: what is joined and written per request carries the id alone.
    """
    vectors = requests.select(vector_id(F.col("embedding")).alias("vector_id"), "embedding").filter("vector_id IS NOT NULL")
    return requests.withColumn("vector_id", vector_id(F.col("embedding"))).drop("embedding"), written(vectors.distinct(), "vectors")


def with_vectors(rows: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("vector_id",)) -> DataFrame:
    """``rows`` with ``embedding`` in place of ``vector_id``; Spark leaves the join out where nobody asks for it."""
    return rows.join(vectors.dropDuplicates(list(keys)), list(keys), "left").drop("vector_id")


def semantic_candidates(requests: DataFrame, vectors: DataFrame, semantic: DataFrame, config: C.CacheConfig) -> DataFrame:
    """Top-k entries per distinct request text, with the entry's own columns.

    The result is keyed by ``probe_id``, one per (query, skipped entry). Texts share vectors too, so
    each (vector, skipped entry) is searched once.
    """
    skip = [c for c in ("skip_key",) if c in requests.columns]
    probes = requests.groupBy("probe_id", "query", *skip).agg(F.min("vector_id").alias("vector_id"))
    search = F.md5(F.to_json(F.struct("vector_id", *skip)))
    probes = written(probes.filter("vector_id IS NOT NULL").withColumn("search_id", search), "probes")
    found = knn_join(
        probes.select(F.col("search_id").alias("req_id"), "vector_id", *skip).distinct().join(vectors, "vector_id"),
        semantic, config.k, max_broadcast_bytes=config.max_broadcast_bytes, tile_rows=config.tile_rows,
        max_pivots=config.max_pivots,
    ).withColumnRenamed("req_id", "search_id")
    entry = semantic.select(
        "entry_key",
        F.col("query").alias("cached_query"),
        F.col("answer").alias("cached_answer"),
        F.coalesce("category", F.lit(C.STATIC)).alias("cached_category"),
        *[F.col(c).alias(f"entry_{c}") for c in semantic.columns if c.startswith("x_")],
    )
    return found.join(entry, "entry_key").join(probes.drop("vector_id"), "search_id").drop("search_id")


def verify_candidates(
    candidates: DataFrame, plugins: Plugins, config: C.CacheConfig, kept_scores: Mapping[str, ScoreOnce] = {}
) -> DataFrame:
    """One row per probe: nearest entry, best reranked entry and its checks.

    Scores already present as columns (``rerank_score``, ``logit_ab``,
    ``logit_ba``, ``answer_relevance``) are used as they are; otherwise the
    plug-ins are called, the pair checks only for best candidates that pass the
    rerank threshold.
    """
    q, cached = F.col("query"), F.col("cached_query")
    if "rerank_score" not in candidates.columns:
        # the window shares its partitioning with the aggregation below
        nearest_similarity = F.max("similarity").over(Window.partitionBy("probe_id"))
        highest = config.quiet_threshold if config.fixed_threshold is None else config.fixed_threshold
        candidates = candidates.withColumn("_near", nearest_similarity)
        candidates = _pair_scores(
            candidates, "rerank_score", plugins.reranker, (q, cached), F.col("_near") <= highest, kept_scores.get("reranker")
        ).drop("_near")
    nearest = F.struct("similarity", "cached_answer", "cached_category", "entry_key")
    kept = F.struct(*[c for c in candidates.columns if c != "probe_id"])
    best = candidates.groupBy("probe_id").agg(
        F.min_by(nearest, "rank").alias("nearest"),
        F.max_by(kept, F.struct("rerank_score", -F.col("rank"))).alias("_b"),
    ).select("probe_id", "nearest", "_b.*")
    passes = F.coalesce(F.col("rerank_score") > config.rerank_threshold, F.lit(False))
    relevance = (q, clip_relevance(F.col("cached_answer")))
    if kept_scores.get("contradiction") and not {"logit_ab", "logit_ba"} & set(best.columns):
        best = _both_logits(best, plugins.contradiction, passes, kept_scores["contradiction"])
    checks = {
        "logit_ab": (plugins.contradiction, (q, cached)),
        "logit_ba": (plugins.contradiction, (cached, q)),
        "answer_relevance": (plugins.relevance, relevance),
    }
    for name, (scorer, inputs) in checks.items():
        if name not in best.columns:
            best = _pair_scores(best, name, scorer, inputs, passes)
    pair = pyfs(F.col("logit_ab"), F.col("logit_ba"))
    return best.withColumn("_pair", pair).select(
        "probe_id", "nearest", "rerank_score", "answer_relevance",
        F.col("_pair.mu").alias("mu"), F.col("_pair.nu").alias("nu"), F.col("_pair.pi").alias("pi"),
        F.struct("cached_answer", "cached_category", "entry_key").alias("best"),
    )


def _pair_scores(
    df: DataFrame, out: str, scorer: Scorer | None, inputs: tuple[Column, ...], mask: Column, once: ScoreOnce | None = None
) -> DataFrame:
    if scorer is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if once is None:
        return df.withColumn(out, only_where(mask, scorer, *inputs))
    return _scored_once(df, scorer, list(inputs), out, mask, once)


def _both_logits(best: DataFrame, scorer: Scorer, mask: Column, once: ScoreOnce) -> DataFrame:
    """Both directions in one look at the kept scores: a table is written once a batch."""
    pairs = best.filter(mask).select(F.col("query").alias("_a"), F.col("cached_query").alias("_b"))
    logits = once(pairs.union(pairs.select("_b", "_a")).distinct(), ["_a", "_b"], scorer, "_logit")
    for out, a, b in (("logit_ab", "query", "cached_query"), ("logit_ba", "cached_query", "query")):
        one = logits.select(F.col("_a").alias("_a_"), F.col("_b").alias("_b_"), F.col("_logit").alias(out))
        same = F.col(a).eqNullSafe(F.col("_a_")) & F.col(b).eqNullSafe(F.col("_b_"))
        best = best.join(one, same, "left").drop("_a_", "_b_").withColumn(out, F.when(mask, F.col(out)))
    return best


def cascade(
    requests: DataFrame,
    exact: DataFrame,
    semantic: DataFrame,
    config: C.CacheConfig = C.CacheConfig(),
    plugins: Plugins = Plugins(),
    score_candidates: Callable[[DataFrame], DataFrame] | None = None,
    exact_is_log: bool = False,
    signals=C.CONTEXT_SIGNALS,
    earlier_calls: DataFrame | None = None,
    kept_scores: Mapping[str, ScoreOnce] = {},
) -> DataFrame:
    """One decision row per request, against a fixed state of both tiers.

    ``requests(req_id, query, at_us[, history, label, confidence, embedding,
    skip_key, rate])``; ``exact(entry_key, cached_us, expires_us, answer,
    category[, seq])``, a write log when ``exact_is_log``; ``semantic`` has the
    answer-table schema.  The threshold is ``fixed_threshold``, else follows the
    ``rate`` of the requests, else, with ``earlier_calls(at_us)`` (empty if there
    were none), the calls that this very cascade makes.  ``score_candidates`` may add score columns to the
    candidate frame in place of the model plug-ins; ``kept_scores`` maps a
    plug-in (classifier, embedder, reranker, contradiction) to what asks it only for
    inputs not scored before, see :class:`~stillgood.operators.memo.ScoreTable`.

    A volatile request touches neither tier.  Only requests still undecided
    after the exact tier are searched, and only the best reranked candidate of a
    request is verified.  Requests after the exact tier feed both the search and
    the final join, so they are written once (``config.materialize``; always when
    a model produced them, so that no model runs twice).
    """
    return with_vectors(*decide(
        requests, exact, semantic, config, plugins, score_candidates, exact_is_log, signals, earlier_calls, kept_scores
    ))


def decide(
    requests: DataFrame,
    exact: DataFrame,
    semantic: DataFrame,
    config: C.CacheConfig = C.CacheConfig(),
    plugins: Plugins = Plugins(),
    score_candidates: Callable[[DataFrame], DataFrame] | None = None,
    exact_is_log: bool = False,
    signals=C.CONTEXT_SIGNALS,
    earlier_calls: DataFrame | None = None,
    kept_scores: Mapping[str, ScoreOnce] = {},
) -> tuple[DataFrame, DataFrame]:
    """The decisions of :func:`cascade` with ``vector_id`` in place of ``embedding``, and the vectors."""
    if plugins.embedder is None:
        requests, vectors = vectors_apart(requests)
    resolved = resolve_context(requests, plugins, signals, config.history_turns)
    labelled = label_requests(resolved, plugins, kept_scores.get("classifier", memo_score))
    keyed = labelled.withColumn("entry_key", cache_key(F.col("query")))
    lookup = asof_lookup if exact_is_log else exact_lookup
    volatile = F.col("label") == C.VOLATILE
    # a volatile request carries no key, so it can match nothing in the join
    guarded = keyed.withColumn("query_key", F.col("entry_key")).withColumn(
        "entry_key", F.when(volatile, F.concat(F.lit("volatile:"), F.col("req_id").cast("string"))).otherwise(F.col("entry_key"))
    )
    looked = lookup(guarded, exact).withColumnsRenamed({"answer": "exact_answer", "hit": "exact_hit"})
    looked = looked.drop("category", "cached_us", "entry_key")
    probe_parts = [F.col("query")] + [F.col("skip_key").cast("string") for c in ("skip_key",) if c in looked.columns]
    undecided = ~volatile & ~F.col("exact_hit")
    # decided requests get a key of their own, or all would meet in one task
    looked = looked.withColumn("undecided", undecided).withColumn(
        "probe_id",
        F.when(undecided, F.md5(F.to_json(F.struct(*probe_parts)).cast("binary")))
        .otherwise(F.concat(F.lit("decided:"), F.col("req_id").cast("string"))),
    )
    if config.materialize or plugins.rewriter or plugins.classifier:
        looked = written(looked, "looked")
    if plugins.embedder is not None:
        # the vector stays with the request: its answer is stored under it
        embed_once = kept_scores.get("embedder", memo_score)
        looked = _scored_once(
            looked.drop("embedding"), plugins.embedder, [F.col("query")], "embedding", F.col("undecided"), embed_once
        )
        looked, vectors = vectors_apart(written(looked, "embedded"))
        plugins = replace(plugins, embedder=None)
    live = semantic
    if config.expire_semantic:
        newest = looked.agg(F.max("at_us").alias("now")).scalar()
        live = semantic.filter(F.col("expires_us").isNull() | (F.col("expires_us") > newest))
    candidates = semantic_candidates(looked.filter("undecided"), vectors, live, config)
    if score_candidates is not None:
        candidates = score_candidates(candidates)
    verified = verify_candidates(candidates, plugins, config, kept_scores)
    threshold = F.lit(config.quiet_threshold)
    if config.fixed_threshold is not None:
        threshold = F.lit(config.fixed_threshold)
    elif "rate" in looked.columns:
        threshold = dynamic_threshold(F.coalesce("rate", F.lit(0)), config)
    elif earlier_calls is not None:
        # one row per probe; the timeline needs no more of a request than whether it may become a call
        verified = written(verified, "verified")
        fits = verify_pair(F.col("rerank_score"), F.col("nu"), F.col("answer_relevance"), config)
        checked = verified.select("probe_id", fits.alias("_fits"), F.col("nearest.similarity").alias("_near"))
        asks = looked.select("at_us", "probe_id", "undecided", volatile.alias("_volatile")).join(checked, "probe_id", "left")
        open_ = F.col("undecided") & ~F.coalesce("_fits", F.lit(False))
        settled = settled_instants(
            written(asks.select("at_us", "_volatile", open_.alias("_open"), "_near"), "asks"), "at_us",
            lambda t: F.col("_volatile") | (F.col("_open") & ~fast_accept(F.col("_near"), t)),
            config, earlier_calls,
        )
        looked, threshold = with_thresholds(looked, "at_us", settled, config), F.col("threshold")
    joined = looked.join(verified, "probe_id", "left")
    source = (
        F.when(volatile, F.lit(C.GEMINI_VOLATILE))
        .when(F.col("exact_hit"), F.lit(C.REDIS_HIT))
        .when(fast_accept(F.col("nearest.similarity"), threshold), F.lit(C.CACHE_HIT_FAST))
        .when(
            verify_pair(F.col("rerank_score"), F.col("nu"), F.col("answer_relevance"), config),
            F.lit(C.CACHE_HIT_VERIFIED),
        )
        .otherwise(F.lit(C.GEMINI_API))
    )
    decided = joined.withColumns({"source": source, "threshold": F.when(F.col("undecided"), threshold)})
    return _decision_rows(decided, plugins), vectors


def _decision_rows(decided: DataFrame, plugins: Plugins) -> DataFrame:
    source = F.col("source")
    fast, verified = source == C.CACHE_HIT_FAST, source == C.CACHE_HIT_VERIFIED
    upstream = source.isin(C.GEMINI_API, C.GEMINI_VOLATILE)
    answerer = plugins.answerer or (lambda query, messages: placeholder_answer(query))
    history = F.col("history") if "history" in decided.columns else F.lit(None)
    fresh = only_where(upstream, answerer, F.col("query"), chat_messages(F.col("query"), history))
    served = F.when(fast, F.col("nearest")["cached_answer"]).when(verified, F.col("best")["cached_answer"])
    values = {
        "category": F.when(upstream, F.col("label")).when(fast, F.col("nearest")["cached_category"]),
        "confidence": F.when(upstream, F.round("confidence", 4)),
        "answer": F.when(source == C.REDIS_HIT, F.col("exact_answer")).when(upstream, fresh).otherwise(served),
        "similarity": F.when(fast, F.round(F.col("nearest.similarity"), 4)),
        "served_key": F.when(fast, F.col("nearest.entry_key")).when(verified, F.col("best.entry_key")),
        "cached_category": F.when(fast, F.col("nearest.cached_category")).when(verified, F.col("best.cached_category")),
        **{c: F.when(verified, F.round(c, 4)) for c in ("rerank_score", "answer_relevance", "mu", "nu", "pi")},
    }
    kept = [
        values[c].alias(c) if c in values else F.col(c)
        for c in DECISION_COLUMNS
    ]
    extra = ["query_key", "label", "vector_id"]
    return decided.select(*kept, *extra)


def prototype_cascade(
    requests: DataFrame,
    exact: DataFrame,
    semantic: DataFrame,
    config: C.CacheConfig = C.CacheConfig(),
    plugins: Plugins = Plugins(),
    score_candidates: Callable[[DataFrame], DataFrame] | None = None,
    volatile=C.VOLATILE_KEYWORDS,
    slow=C.SLOW_KEYWORDS,
) -> DataFrame:
    """Earlier two-tier variant: exact, nearest one above a floor, pair check, answer.

    Labels come from keywords, and only requests answered upstream get one.
    """
    looked = exact_lookup(
        requests.withColumn("entry_key", cache_key(F.col("query"))), exact
    ).withColumnsRenamed({"answer": "exact_answer", "hit": "exact_hit", "entry_key": "query_key"}).drop("category")
    if config.materialize:
        looked = written(looked, "looked")
    open_ = looked.filter(~F.col("exact_hit"))
    near = nearest_one(
        open_, semantic, config.floor_threshold, max_broadcast_bytes=config.max_broadcast_bytes,
        tile_rows=config.tile_rows, max_pivots=config.max_pivots,
    )
    found = near.join(
        semantic.select(
            "entry_key", F.col("query").alias("cached_query"), F.col("answer").alias("cached_answer"),
            F.col("category").alias("cached_category"),
            *[F.col(c).alias(f"entry_{c}") for c in semantic.columns if c.startswith("x_")],
        ),
        "entry_key",
    ).join(open_.select("req_id", "query"), "req_id")
    if score_candidates is not None:
        found = score_candidates(found)
    else:
        q, cached = F.col("query"), F.col("cached_query")
        found = found.withColumns(
            {"logit_ab": plugins.contradiction(q, cached), "logit_ba": plugins.contradiction(cached, q)}
        )
    found = found.withColumn("pair", pyfs(F.col("logit_ab"), F.col("logit_ba"))).select(
        "req_id", "similarity", "cached_answer", "cached_category", "entry_key", "pair"
    )
    joined = looked.join(found, "req_id", "left")
    agrees = F.coalesce(F.col("pair.score") >= config.prototype_pair_threshold, F.lit(False))
    source = (
        F.when(F.col("exact_hit"), F.lit("redis_hit")).when(agrees, F.lit("chroma_hit")).otherwise(F.lit("llm"))
    )
    answerer = plugins.answerer or (lambda query, messages: placeholder_answer(query))
    decided = joined.withColumn("source", source)
    asked = F.col("source") == "llm"
    fresh = only_where(asked, answerer, F.col("query"), chat_messages(F.col("query"), F.lit(None)))
    return decided.select(
        "req_id", "query", "query_key", "source",
        F.when(F.col("exact_hit"), F.col("exact_answer")).when(asked, fresh).otherwise(F.col("cached_answer")).alias("answer"),
        F.when(asked, lifetime_keywords(F.col("query"), volatile, slow))
        .when(F.col("source") == "chroma_hit", F.col("cached_category")).alias("category"),
        F.when(~F.col("exact_hit"), F.round("pair.score", 6)).alias("pair_score"),
        F.when(F.col("source") == "chroma_hit", F.col("entry_key")).alias("served_key"),
    )


def misses(decisions: DataFrame) -> DataFrame:
    """Answered upstream and eligible for storing: bypasses are not."""
    return decisions.filter(F.col("source") == C.GEMINI_API).withColumn("category", F.col("label"))


def store_misses(
    decisions: DataFrame, semantic: DataFrame, plugins: Plugins, config: C.CacheConfig = C.CacheConfig(),
    phrases=C.UNCACHEABLE_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """Judge the fresh answers of a decided batch and store those admitted."""
    return admit_and_store(misses(decisions), semantic, plugins.judge, config, phrases)
