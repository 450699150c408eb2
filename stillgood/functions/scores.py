"""Column functions over scores, labels and lifetimes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import uncacheable

MICROS = 1_000_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read as session time."""
    return F.unix_micros(ts.cast("timestamp"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def pyfs(logit_ab: Column, logit_ba: Column) -> Column:
    """Fuzzy-set agreement of a pair from its two directed logits."""
    ab, ba = sigmoid(logit_ab.cast("double")), sigmoid(logit_ba.cast("double"))
    mu = (ab + ba) / 2
    nu = ((1 - ab) + (1 - ba)) / 2
    return F.struct(
        (mu * mu - nu * nu).alias("score"),
        mu.alias("mu"),
        nu.alias("nu"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - (mu * mu + nu * nu))).alias("pi"),
        F.lit(0.0).alias("neutral"),
    )


def dynamic_threshold(rate: Column, config: C.CacheConfig = C.CacheConfig()) -> Column:
    """Loosen acceptance when the upstream model is busy, tighten when idle."""
    return (
        F.when(rate > config.busy_rate, F.lit(config.busy_threshold))
        .when(rate < config.quiet_rate, F.lit(config.quiet_threshold))
        .otherwise(F.lit(config.normal_threshold))
    )


def fast_accept(similarity: Column, threshold: Column | float) -> Column:
    return F.coalesce(similarity > threshold, F.lit(False))


def floor_accept(similarity: Column, threshold: Column | float) -> Column:
    return F.coalesce(similarity >= threshold, F.lit(False))


def verify_pair(
    rerank: Column, nu: Column, relevance: Column, config: C.CacheConfig = C.CacheConfig()
) -> Column:
    return F.coalesce(
        (rerank > config.rerank_threshold)
        & (nu <= config.contradiction_threshold)
        & (relevance > config.relevance_threshold),
        F.lit(False),
    )


def admission(
    reusability: Column,
    confidence: Column,
    faithfulness: Column,
    threshold: float = 0.5,
    response: Column | None = None,
    phrases: Sequence[str] = C.UNCACHEABLE_PHRASES,
) -> Column:
    """Weighted judge score; a missing signal counts as 0, a blocked answer as all 0."""
    blocked = F.lit(False) if response is None else uncacheable(response, phrases)

    def signal(score: Column) -> Column:
        return F.when(blocked, F.lit(0.0)).otherwise(F.coalesce(score.cast("double"), F.lit(0.0)))

    r, c, f = signal(reusability), signal(confidence), signal(faithfulness)
    weight = C.JUDGE_WEIGHTS
    combined = weight["reusability"] * r + weight["confidence"] * c + weight["faithfulness"] * f
    return F.struct(
        F.round(r, 4).alias("reusability_score"),
        F.round(c, 4).alias("confidence_score"),
        F.round(f, 4).alias("faithfulness_score"),
        F.round(combined, 4).alias("combined_score"),
        (~blocked & (combined >= threshold)).alias("admit_to_cache"),
        F.when(blocked, F.lit(C.MODE_BLOCKED)).otherwise(F.lit(C.MODE_JUDGED)).alias("mode"),
    )


def label_seconds(label: Column, lifetimes: Mapping[str, int | None] = C.LIVE_LIFETIMES) -> Column:
    """Lifetime in seconds; NULL when the label never expires or is not known."""
    out = F.lit(None).cast("long")
    for name, seconds in lifetimes.items():
        if seconds is not None:
            out = F.when(label == name, F.lit(seconds).cast("long")).otherwise(out)
    return out


def label_display(label: Column, display: Mapping[str, str] = C.LIFETIME_DISPLAY) -> Column:
    out = F.lit(None).cast("string")
    for name, text in display.items():
        out = F.when(label == name, F.lit(text)).otherwise(out)
    return out


def expires_us(
    cached_us: Column, label: Column, lifetimes: Mapping[str, int | None] = C.LIVE_LIFETIMES
) -> Column:
    return cached_us + label_seconds(label, lifetimes) * MICROS


def confidence_gate(
    probs: Column,
    classes: Sequence[str],
    threshold: float = 0.40,
    fallback: str = C.VOLATILE,
) -> Column:
    """Label of the top class, or the fallback label when it is not convincing."""
    top = F.array_max(probs)
    names = F.array(*[F.lit(c) for c in classes])
    label = F.element_at(names, F.array_position(probs, top).cast("int"))
    low = top < threshold
    return F.struct(
        F.when(low, F.lit(fallback)).otherwise(label).alias("label"),
        top.alias("confidence"),
        F.when(low, F.lit("fallback_low_confidence"))
        .otherwise(F.lit("embedding_classifier"))
        .alias("stage"),
    )


def fail_safe_label(label: Column, confidence: Column) -> Column:
    """A request the classifier could not label must not touch the cache."""
    missing = label.isNull() | confidence.isNull()
    return F.struct(
        F.when(missing, F.lit(C.VOLATILE)).otherwise(label).alias("label"),
        F.when(missing, F.lit(0.0)).otherwise(confidence).alias("confidence"),
    )


def prob_map(classes: Sequence[str], probs: Column | None = None, label: Column | None = None) -> Column:
    """Class -> probability; one-hot on ``label`` when no model scored the row."""
    names = F.array(*[F.lit(c) for c in classes])
    if probs is None:
        probs = F.array(*[F.when(label == c, F.lit(1.0)).otherwise(F.lit(0.0)) for c in classes])
    return F.map_from_arrays(names, probs)


def is_hit(source: Column) -> Column:
    return F.coalesce(source.isin(*C.HIT_SOURCES), F.lit(False))
