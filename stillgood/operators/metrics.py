"""Quality metrics over decision logs.

All of them are partial aggregates: one pass over the log, then frames no
larger than the number of classes, sources or policies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scores import is_hit
from ..functions.text import clip_report
from ..functions.vectors import cosine


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def decision_flags(decisions: DataFrame) -> DataFrame:
    """Adds the boolean path flags and fills missing fields as reports expect."""
    source = F.coalesce(F.col("source"), F.lit(C.ERROR))
    added = {
        "source": source,
        "cache_hit": is_hit(source),
        "volatile_bypass": source == C.GEMINI_VOLATILE,
        "gemini_call": source == C.GEMINI_API,
    }
    if "predicted_category" in decisions.columns:
        added["predicted_category"] = F.coalesce("predicted_category", F.lit(C.UNKNOWN))
    return decisions.withColumns(added)


def decision_counters(decisions: DataFrame) -> DataFrame:
    """Event counters.  A volatile bypass raises only its own counter and the total.

    Optional columns: ``admission`` (admitted / blocked / error), ``rewritten``.
    """
    return decisions.agg(*_counters(decisions.columns))


def _counters(columns: Sequence[str]) -> list[Column]:
    source = F.col("source")
    admission = F.col("admission") if "admission" in columns else F.lit(None)
    rewritten = F.col("rewritten") if "rewritten" in columns else F.lit(False)
    return [
        _count(source == C.REDIS_HIT).alias("redis_hits"),
        _count(source == C.CACHE_HIT_FAST).alias("chroma_hits_fast"),
        _count(source == C.CACHE_HIT_VERIFIED).alias("chroma_hits_verified"),
        _count(source == C.GEMINI_VOLATILE).alias("volatile_bypasses"),
        _count(source == C.GEMINI_API).alias("gemini_calls"),
        _count(admission == "admitted").alias("gate3_admitted"),
        _count(admission == "blocked").alias("gate3_blocked"),
        _count(admission == "error").alias("gate3_errors"),
        _count(source != C.ERROR).alias("total_queries"),
        _count(rewritten).alias("gate1_rewrites"),
    ]


def live_stats(decisions: DataFrame) -> DataFrame:
    """Hit and saved-call percentages of a running cache (0 hits over an empty log)."""
    return decision_counters(decisions).select("total_queries", *_live_shares())


def _live_shares() -> list[Column]:
    total = F.greatest(F.lit(1), F.col("total_queries"))
    hits = F.col("redis_hits") + F.col("chroma_hits_fast") + F.col("chroma_hits_verified")
    return [
        F.round(hits * 100.0 / total, 2).alias("hit_rate_percent"),
        F.round((1 - F.col("gemini_calls") / total) * 100, 2).alias("api_reduction_percent"),
    ]


def full_stats(events: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Counters, entries per table and live percentages in one pass.

    ``events(source, rewritten, admission, held)``: a row per decision (``source``), judged answer
    (``admission``) and entry of a table (``held``, its name), with NULL in the other columns.
    """
    sizes = [_count(F.col("held") == name).alias(f"{name}_entries") for name in tables]
    return events.agg(*_counters(events.columns), *sizes).select("*", *_live_shares())


def effective_hit_rate(decisions: DataFrame) -> DataFrame:
    """Hit rate and saved upstream calls over all rows, failed requests included."""
    flags = decision_flags(decisions)
    return flags.agg(
        F.count("*").alias("total"),
        _count(F.col("cache_hit")).alias("cache_hits"),
        _count(F.col("volatile_bypass")).alias("volatile_bypasses"),
        _count(F.col("gemini_call")).alias("gemini_calls"),
        F.round(F.try_divide(_count(F.col("cache_hit")) * 100.0, F.count("*")), 2).alias("hit_rate_percent"),
        F.round(
            (1 - F.try_divide(_count(F.col("gemini_call")), F.count("*"))) * 100, 2
        ).alias("api_reduction_percent"),
    )


def staleness_rate(decisions: DataFrame) -> DataFrame:
    """Share of truly volatile requests that did not bypass the cache."""
    volatile = F.col("true_category") == C.VOLATILE
    kept = volatile & ~F.col("volatile_bypass")
    return decision_flags(decisions).agg(
        _count(volatile).alias("volatile_queries"),
        _count(kept).alias("not_bypassed"),
        F.round(_count(kept) * 100.0 / F.greatest(F.lit(1), _count(volatile)), 2).alias("staleness_rate_percent"),
    )


def stale_served_rate(decisions: DataFrame) -> DataFrame:
    """Share of truly volatile requests actually answered from the cache."""
    volatile = F.col("true_category") == C.VOLATILE
    served = volatile & F.col("cache_hit")
    return decision_flags(decisions).agg(
        _count(volatile).alias("volatile_queries"),
        _count(served).alias("served_from_cache"),
        F.round(_count(served) * 100.0 / F.greatest(F.lit(1), _count(volatile)), 2).alias("stale_served_percent"),
    )


def label_accuracy(decisions: DataFrame) -> DataFrame:
    """Share of correct labels among requests that carry one."""
    known = F.col("predicted_category") != C.UNKNOWN
    right = known & (F.col("predicted_category") == F.col("true_category"))
    return decision_flags(decisions).agg(
        _count(known).alias("labelled"),
        _count(right).alias("correct"),
        F.round(_percent(_count(right), _count(known)), 2).alias("category_accuracy_percent"),
    )


def category_breakdown(decisions: DataFrame) -> DataFrame:
    """Per true category; unlabelled requests count as wrong here."""
    right = F.col("predicted_category") == F.col("true_category")
    return decision_flags(decisions).groupBy("true_category").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.coalesce(right, F.lit(False)).cast("double")) * 100, 2).alias("accuracy_percent"),
        F.round(F.avg(F.col("cache_hit").cast("double")) * 100, 2).alias("hit_rate_percent"),
        F.round(F.avg("latency") * 1000, 2).alias("avg_latency_ms"),
    )


def latency_summary(decisions: DataFrame) -> DataFrame:
    """Mean latency of hits and of upstream calls, and their ratio (NULL if no hits)."""
    hit = F.coalesce(F.avg(F.when(F.col("cache_hit"), F.col("latency"))), F.lit(0.0))
    upstream = F.coalesce(F.avg(F.when(F.col("gemini_call"), F.col("latency"))), F.lit(0.0))
    return decision_flags(decisions).agg(
        F.round(hit * 1000, 2).alias("cache_hit_latency_ms"),
        F.round(upstream * 1000, 2).alias("gemini_latency_ms"),
        F.round(F.when(hit > 0, upstream / hit), 1).alias("speedup_factor"),
    )


def latency_histogram(decisions: DataFrame, by: str = "source") -> DataFrame:
    """``(by, latency_us, n)``: latencies cut to three significant digits of a microsecond count.

    Histograms of batches merge by ``merge_histograms``; as a streaming aggregate the same frame
    keeps at most 900 rows per power of ten and group.  Missing latencies do not count.
    """
    us = F.greatest(F.lit(0), F.round(F.col("latency") * 1_000_000).cast("long"))
    unit = F.rpad(F.lit("1"), F.greatest(F.lit(1), F.length(us.cast("string")) - 2), "0").cast("long")
    cut = (us - us % unit).alias("latency_us")
    return decision_flags(decisions).where("latency IS NOT NULL").groupBy(by, cut).agg(F.count("*").alias("n"))


def merge_histograms(histograms: DataFrame, by: str = "source") -> DataFrame:
    return histograms.groupBy(by, "latency_us").agg(F.sum("n").alias("n"))


def latency_percentiles(histogram: DataFrame, by: str = "source", points: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles in milliseconds per group, at most 1 % below the exact ones.

    The window sorts a group's histogram, never its decisions.
    """
    group = W.partitionBy(by)
    ranked = histogram.withColumns({
        "_upto": F.sum("n").over(group.orderBy("latency_us").rowsBetween(W.unboundedPreceding, 0)),
        "_all": F.sum("n").over(group),
    })
    at = lambda p: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("latency_us"))) / 1000.0
    return ranked.groupBy(by).agg(F.sum("n").alias("n"), *[at(p).alias(f"p{p}_ms") for p in points])


def source_breakdown(decisions: DataFrame, column: str = "source") -> DataFrame:
    return decisions.groupBy(column).agg(F.count("*").alias("n"))


def admission_integrity(outcomes: DataFrame, column: str = "admission") -> DataFrame:
    """Blocked share of judged answers; NULL when nothing was judged."""
    admitted, blocked = _count(F.col(column) == "admitted"), _count(F.col(column) == "blocked")
    return outcomes.agg(
        admitted.alias("admitted"),
        blocked.alias("blocked"),
        (admitted + blocked).alias("total"),
        F.round(F.try_divide(blocked * 100.0, admitted + blocked), 2).alias("cache_integrity_percent"),
    )


def wrong_hit_rows(decisions: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Cache hits scored against the true answer.

    Needs ``ground_truth``, ``cached_response`` and their vectors
    ``truth_vector``, ``served_vector``.  Rows missing either text are skipped.
    """
    usable = (
        is_hit(F.col("source"))
        & (F.length(F.coalesce("ground_truth", F.lit(""))) > 0)
        & (F.length(F.coalesce("cached_response", F.lit(""))) > 0)
    )
    # The full-precision similarity is compared, a rounded one reported.
    scored = decisions.filter(usable).withColumn(
        "_sim", cosine(F.col("truth_vector"), F.col("served_vector"))
    )
    return scored.withColumns(
        {
            "similarity_to_gt": F.round("_sim", 4),
            "is_wrong_hit": F.col("_sim") < threshold,
            "ground_truth": clip_report(F.col("ground_truth")),
            "cached_response": clip_report(F.col("cached_response")),
        }
    ).drop("_sim", "truth_vector", "served_vector")


def wrong_hits(rows: DataFrame) -> DataFrame:
    """Wrong-hit counts per category, plus the total in the same pass."""
    return (
        rows.rollup("true_category")
        .agg(
            F.grouping("true_category").alias("_total"),
            F.count("*").alias("hits"),
            _count(F.col("is_wrong_hit")).alias("wrong"),
        )
        .select(
            F.when(F.col("_total") == 1, F.lit("ALL")).otherwise(F.col("true_category")).alias("true_category"),
            "hits",
            "wrong",
            F.round(F.col("wrong") * 100.0 / F.greatest(F.lit(1), F.col("hits")), 2).alias("wrong_percent"),
        )
    )


def _class_counts(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: true positives, predicted and actual counts, via a confusion table."""
    confusion = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))

    def part(label: str, tp: Column, said: Column, is_: Column) -> Column:
        return F.struct(
            F.col(label).cast("string").alias("label"), tp.alias("tp"), said.alias("said"), is_.alias("support")
        )

    zero = F.lit(0).cast("long")
    parts = F.array(part("t", hit, zero, F.col("n")), part("p", zero, F.col("n"), zero))
    return (
        confusion.select(F.explode(parts).alias("x")).groupBy(F.col("x.label").alias("label"))
        .agg(F.sum("x.tp").alias("tp"), F.sum("x.said").alias("said"), F.sum("x.support").alias("support"))
    )


def _prf(counts: DataFrame) -> DataFrame:
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("said")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2.0 * F.col("tp"), F.col("said") + F.col("support")))
    )


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per-class precision, recall, F1, support; then accuracy, macro and weighted means."""
    measures = ("precision", "recall", "f1")

    def weighted(m: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0))

    rolled = _prf(_class_counts(rows, truth, predicted)).rollup("label").agg(
        F.grouping("label").alias("_total"),
        F.sum("support").alias("support"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[weighted(m).alias(f"weighted_{m}") for m in measures],
    )

    def line(label: Column, values: Sequence[Column]) -> Column:
        named = [F.round(v, 4).alias(m) for v, m in zip(values, measures)]
        return F.struct(label.alias("label"), *named, F.col("support").alias("support"))

    none = F.lit(None).cast("double")
    macro = [F.col(f"macro_{m}") for m in measures]
    totals = F.array(
        line(F.lit("accuracy"), [none, none, F.col("accuracy")]),
        line(F.lit("macro avg"), macro),
        line(F.lit("weighted avg"), [F.col(f"weighted_{m}") for m in measures]),
    )
    lines = F.when(F.col("_total") == 1, totals).otherwise(F.array(line(F.col("label"), macro)))
    return rolled.select(F.inline(lines))


def _with_total(classes: DataFrame, count: str) -> DataFrame:
    """Adds ``total`` and ``classes`` to a per-class frame (one row per class value)."""
    kept = F.struct(*classes.columns)
    return classes.agg(
        F.collect_list(kept).alias("_rows"), F.sum(count).alias("total"), F.count("*").alias("classes")
    ).select(F.inline("_rows"), "total", "classes")


def one_vs_rest_counts(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """TP, TN, FP, FN, recall and F1 per class."""
    c = _with_total(_prf(_class_counts(rows, truth, predicted)), "support")
    fp, fn = F.col("said") - F.col("tp"), F.col("support") - F.col("tp")
    return c.select(
        "label", "tp", (F.col("total") - F.col("tp") - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"),
        F.round("recall", 3).alias("recall"), F.round("f1", 3).alias("f1"),
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights: n / (classes * n_class)."""
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return _with_total(counted, "n").select(
        "label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight")
    )


def cv_summary(folds: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    return folds.agg(
        F.round(F.avg(accuracy), 4).alias("mean_accuracy"),
        F.round(F.stddev_pop(accuracy), 4).alias("std_accuracy"),
    )


def batch_throughput(rows: DataFrame, latency: str = "latency") -> DataFrame:
    """Total time of a scored batch and milliseconds per query; empty batches give NULL."""
    return rows.agg(
        F.count(latency).alias("queries"),
        F.round(F.sum(latency), 4).alias("total_seconds"),
        F.round(F.try_divide(F.sum(latency) * 1000, F.count(latency)), 4).alias("ms_per_query"),
    )


def policy_ablation(scored: DataFrame, policies: Mapping[str, Column], wrong: Column) -> DataFrame:
    """Hit and false-positive rate of each policy, all in one pass over the requests.

    ``policies`` maps a name to the condition under which that policy serves
    from the cache; ``wrong`` marks requests whose served answer would be wrong.
    """
    names = list(policies)
    one_row = scored.agg(
        F.count("*").alias("queries"),
        *[_count(policies[n]).alias(f"hits_{i}") for i, n in enumerate(names)],
        *[_count(policies[n] & wrong).alias(f"false_{i}") for i, n in enumerate(names)],
    )
    lines = F.array(
        *[
            F.struct(F.lit(n).alias("policy"), F.col(f"hits_{i}").alias("hits"), F.col(f"false_{i}").alias("false_hits"))
            for i, n in enumerate(names)
        ]
    )
    return one_row.select("queries", F.inline(lines)).select(
        "policy", "queries", "hits", "false_hits",
        F.round(_percent(F.col("hits"), F.col("queries")), 2).alias("hit_rate_percent"),
        F.round(_percent(F.col("false_hits"), F.col("hits")), 2).alias("false_positive_percent"),
    )


def threshold_sweep(scored: DataFrame, score: str, wrong: Column, steps: int = 100) -> DataFrame:
    """Hits and false hits of serving at every score threshold 0, 1 / steps, ..., 1, in one pass.

    Rows fold to one count per step before they are summed from the top, so nothing grows with the
    number of thresholds times rows.  Scores count to six decimals; a missing score is never served.
    """
    reached = F.floor(F.round(F.col(score) * 1_000_000).cast("long") * steps / 1_000_000)
    step = F.when(reached > steps, steps).otherwise(reached)
    counted = scored.groupBy(step.alias("step")).agg(F.count("*").alias("n"), _count(wrong).alias("false"))
    every = scored.sparkSession.range(steps + 1).select(F.col("id").alias("step"), F.lit(0).alias("n"), F.lit(0).alias("false"))
    folded = counted.unionByName(every).groupBy("step").agg(F.sum("n").alias("n"), F.sum("false").alias("false"))
    # one row per threshold, one for missing and those of negative scores: a small single partition
    above = W.orderBy(F.desc_nulls_last("step")).rowsBetween(W.unboundedPreceding, 0)
    summed = folded.select(
        "step", F.sum("n").over(W.partitionBy()).alias("queries"),
        F.sum("n").over(above).alias("hits"), F.sum("false").over(above).alias("false_hits"),
    )
    return summed.where("step >= 0").select(
        (F.col("step") / steps).alias("threshold"), "queries", "hits", "false_hits",
        F.round(_percent(F.col("hits"), F.col("queries")), 2).alias("hit_rate_percent"),
        F.round(_percent(F.col("false_hits"), F.col("hits")), 2).alias("false_positive_percent"),
    )


def cost_summary(
    decisions: DataFrame,
    local_cost: float = 0.00004,
    upstream_cost: float = 0.01,
) -> DataFrame:
    """Spend with and without the cache, and the hit rate at which it pays off.

    Every request pays the local cost; every request answered upstream, bypasses
    included, also pays ``upstream_cost``.
    """
    upstream = F.col("gemini_call") | F.col("volatile_bypass")
    n, calls = F.count("*"), _count(upstream)
    spent = n * local_cost + calls * upstream_cost
    return decision_flags(decisions).agg(
        n.alias("queries"),
        calls.alias("upstream_calls"),
        F.round(n * upstream_cost, 4).alias("cost_without_cache"),
        F.round(spent, 4).alias("cost_with_cache"),
        F.round(F.try_divide(spent, n), 6).alias("cost_per_query"),
        F.round(F.try_divide(n * upstream_cost, spent), 4).alias("cost_ratio"),
        F.lit(round(local_cost / upstream_cost * 100, 4)).alias("break_even_hit_rate_percent"),
    )


def evaluation_summary(decisions: DataFrame) -> DataFrame:
    """All headline numbers of a decision log as one nested row."""
    flags = decision_flags(decisions)
    if "admission" not in flags.columns:
        flags = flags.withColumn("admission", F.lit(None).cast("string"))
    known = F.col("predicted_category") != C.UNKNOWN
    volatile = F.col("true_category") == C.VOLATILE
    # fold to one row per source first, so the map is as small as the source list
    per_source = flags.groupBy("source").agg(
        F.count("*").alias("n"),
        _count(F.col("cache_hit")).alias("hits"),
        _count(F.col("gemini_call")).alias("calls"),
        _count(volatile).alias("volatile"),
        _count(volatile & ~F.col("volatile_bypass")).alias("stale"),
        _count(known).alias("labelled"),
        _count(known & (F.col("predicted_category") == F.col("true_category"))).alias("correct"),
        F.sum(F.when(F.col("cache_hit"), F.col("latency"))).alias("hit_time"),
        F.sum(F.when(F.col("gemini_call"), F.col("latency"))).alias("call_time"),
        _count(F.col("admission") == "admitted").alias("admitted"),
        _count(F.col("admission") == "blocked").alias("blocked"),
    )
    total = per_source.agg(
        *[F.sum(c).alias(c) for c in per_source.columns if c != "source"],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"),
    )
    hit_s = F.coalesce(F.try_divide("hit_time", "hits"), F.lit(0.0))
    call_s = F.coalesce(F.try_divide("call_time", "calls"), F.lit(0.0))
    judged = F.col("admitted") + F.col("blocked")
    return total.select(
        F.col("n").alias("total_queries_tested"),
        F.struct(
            F.round(_percent(F.col("hits"), F.col("n")), 2).alias("effective_hit_rate_percent"),
            F.round((1 - F.try_divide("calls", "n")) * 100, 2).alias("api_reduction_percent"),
            F.round(F.col("stale") * 100.0 / F.greatest(F.lit(1), F.col("volatile")), 2).alias("staleness_rate_percent"),
            F.round(F.try_divide(F.col("blocked") * 100.0, judged), 2).alias("cache_integrity"),
            F.round(_percent(F.col("correct"), F.col("labelled")), 2).alias("ttl_category_accuracy_percent"),
            F.round(hit_s * 1000, 2).alias("cache_hit_latency_ms"),
            F.round(call_s * 1000, 2).alias("gemini_latency_ms"),
            F.round(F.when(hit_s > 0, call_s / hit_s), 1).alias("speedup_factor"),
        ).alias("metrics"),
        F.struct("admitted", "blocked", judged.alias("total")).alias("gate3"),
        "source_breakdown",
    )
