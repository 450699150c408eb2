import random

import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.operators import metrics

# Path counts of a recorded run: 200 probes, 105 judged answers.
RECORDED = {C.GEMINI_API: 85, C.CACHE_HIT_FAST: 64, C.GEMINI_VOLATILE: 50, C.REDIS_HIT: 1}


def recorded(spark):
    rows = [(s, 2.0 if s == C.GEMINI_API else 0.5, C.STATIC, C.STATIC) for s, n in RECORDED.items() for _ in range(n)]
    return spark.createDataFrame(rows, "source string, latency double, true_category string, predicted_category string")


def test_recorded_ratios(spark):
    row = metrics.effective_hit_rate(recorded(spark)).first()
    assert (row.total, row.cache_hits, row.hit_rate_percent, row.api_reduction_percent) == (200, 65, 32.5, 57.5)
    judged = spark.createDataFrame([("admitted",)] * 98 + [("blocked",)] * 7 + [("error",)] * 3, "admission string")
    row = metrics.admission_integrity(judged).first()
    assert (row.total, row.cache_integrity_percent) == (105, 6.67)


def test_counters_add_up(spark):
    row = metrics.decision_counters(recorded(spark)).first()
    parts = ("redis_hits", "chroma_hits_fast", "chroma_hits_verified", "volatile_bypasses", "gemini_calls")
    assert sum(row[p] for p in parts) == row.total_queries == 200
    assert row.gemini_calls == 85


def test_latency_ratio(spark):
    row = metrics.latency_summary(recorded(spark)).first()
    assert (row.cache_hit_latency_ms, row.gemini_latency_ms, row.speedup_factor) == (500.0, 2000.0, 4.0)


def test_empty_log_rules(spark):
    none = recorded(spark).filter("false")
    assert metrics.label_accuracy(none).first().category_accuracy_percent == 0.0
    assert metrics.staleness_rate(none).first().staleness_rate_percent == 0.0
    assert metrics.live_stats(none).first().hit_rate_percent == 0.0
    assert metrics.latency_summary(none).first().speedup_factor is None
    assert metrics.batch_throughput(none).first().ms_per_query is None
    assert metrics.admission_integrity(none.withColumn("admission", F.lit("x"))).first().cache_integrity_percent is None


def test_staleness_counts_misses_too(spark):
    rows = [(C.GEMINI_VOLATILE, C.VOLATILE), (C.GEMINI_API, C.VOLATILE), (C.CACHE_HIT_FAST, C.VOLATILE), (C.REDIS_HIT, C.STATIC)]
    df = spark.createDataFrame(rows, "source string, true_category string")
    assert metrics.staleness_rate(df).first().staleness_rate_percent == 66.67
    assert metrics.stale_served_rate(df).first().stale_served_percent == 33.33


def test_unlabelled_rows(spark):
    rows = [(C.REDIS_HIT, C.STATIC, None, 1.0), (C.GEMINI_API, C.STATIC, C.STATIC, 1.0)]
    df = spark.createDataFrame(rows, "source string, true_category string, predicted_category string, latency double")
    assert metrics.label_accuracy(df).first().category_accuracy_percent == 100.0
    assert metrics.category_breakdown(df).first().accuracy_percent == 50.0


def test_report_against_hand_count(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = {r.label: r for r in metrics.classification_report(df, "t", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].support) == (0.75, 0.75, 0.75, 4)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.6667, 1.0, 0.8)
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0.0, 0.0, 0.0)
    assert got["accuracy"].f1 == 0.7143 and got["macro avg"].recall == 0.5833
    assert got["weighted avg"].precision == pytest.approx(0.6190, abs=1e-4)
    rest = {r.label: (r.tp, r.tn, r.fp, r.fn) for r in metrics.one_vs_rest_counts(df, "t", "p").collect()}
    assert rest == {"a": (3, 2, 1, 1), "b": (2, 4, 1, 0), "c": (0, 6, 0, 1)}


def test_wrong_hits_skip_blank_and_misses(spark):
    rows = [
        (C.CACHE_HIT_FAST, C.STATIC, "t", "r", [1.0, 0.0], [0.0, 1.0]),
        (C.CACHE_HIT_FAST, C.STATIC, "t", "r", [1.0, 0.0], [0.7, 0.1]),
        (C.REDIS_HIT, C.SLOW, "", "r", [1.0, 0.0], [0.0, 1.0]),
        (C.REDIS_HIT, C.SLOW, None, "r", None, [0.0, 1.0]),
        (C.GEMINI_API, C.SLOW, "t", "r", [1.0, 0.0], [0.0, 1.0]),
    ]
    df = spark.createDataFrame(
        rows, "source string, true_category string, ground_truth string, cached_response string, "
        "truth_vector array<double>, served_vector array<double>",
    )
    got = {r.true_category: (r.hits, r.wrong) for r in metrics.wrong_hits(metrics.wrong_hit_rows(df)).collect()}
    assert got == {"ALL": (2, 1), C.STATIC: (2, 1)}


def test_raising_a_threshold_never_raises_hits(spark):
    df = spark.range(200).withColumn("s", F.col("id") / 200)
    policies = {f"{t:.2f}": F.col("s") > t for t in (0.1, 0.3, 0.5, 0.7, 0.9)}
    got = metrics.policy_ablation(df, policies, F.col("id") % 2 == 0).orderBy("policy").collect()
    hits = [r.hits for r in got]
    assert hits == sorted(hits, reverse=True) and all(r.false_hits <= r.hits for r in got)


def test_summary_document(spark):
    row = metrics.evaluation_summary(recorded(spark)).first()
    assert row.source_breakdown == RECORDED
    assert row.metrics.effective_hit_rate_percent == 32.5 and row.metrics.cache_integrity is None


def test_cost(spark):
    row = metrics.cost_summary(recorded(spark)).first()
    assert (row.queries, row.upstream_calls, row.break_even_hit_rate_percent) == (200, 135, 0.4)


def test_percentiles_merge_across_batches_and_streams(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([*RECORDED, None]), rng.choice([None, 0.0, rng.random() ** 4 * 90])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "source string, latency double")
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    want = {}
    for source, latency in rows:
        if latency is not None:
            want.setdefault(source or C.ERROR, []).append(latency)

    def check(histogram):
        got = {r.source: r for r in metrics.latency_percentiles(histogram).collect()}
        assert got.keys() == want.keys()
        for source, values in want.items():
            values.sort()
            assert got[source].n == len(values)
            for p in (50, 95, 99):
                exact = values[-(-p * len(values) // 100) - 1] * 1000
                assert exact * 0.99 - 0.001 <= got[source][f"p{p}_ms"] <= exact + 0.001

    check(metrics.latency_histogram(log))
    halves = [metrics.latency_histogram(part) for part in log.randomSplit([0.3, 0.7], seed=1)]
    check(metrics.merge_histograms(halves[0].unionByName(halves[1])))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = metrics.latency_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("latencies").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    check(spark.table("latencies"))


def test_threshold_sweep_against_every_threshold(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, -0.2, 0.0, 0.29, 0.57, 1.0, 1.3, round(rng.random(), 6)]), rng.choice([True, False, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, wrong boolean")
    got = {round(r.threshold * 20): r for r in metrics.threshold_sweep(df, "score", F.col("wrong"), 20).collect()}
    assert sorted(got) == list(range(21))
    for i, r in got.items():
        hits = [w for s, w in rows if s is not None and s >= i / 20]
        assert (r.queries, r.hits, r.false_hits) == (500, len(hits), sum(w is True for w in hits))
    empty = metrics.threshold_sweep(df.limit(0), "score", F.col("wrong"), 4).collect()
    assert [(r.queries, r.hits, r.hit_rate_percent) for r in empty] == [(0, 0, 0.0)] * 5
