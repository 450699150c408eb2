import random

import pytest
from pyspark.sql import functions as F

from stillgood.operators import ranking


def test_rank_cuts_match_a_sort(spark):
    random.seed(3)
    rows = [(random.choice("ab"), random.choice([7, 7, 7, random.randrange(-(10**9), 10**9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    key = F.concat(ranking.order_hex(F.col("v")), ranking.order_hex(F.col("id")))
    ranks = {"a": [1, 100, 700], "b": [5, 1200]}
    for finish in (10, 100, 100_000):
        got = {(c.group, c.rank): c.key for c in ranking.rank_cuts(df, F.col("g"), key, ranks, finish_rows=finish)}
        for group, wanted in ranks.items():
            ordered = sorted((v, i) for g, v, i in rows if g == group)
            for rank in wanted:
                v, i = ordered[rank - 1]
                assert got[(group, rank)] == f"{v + 2**63:016X}{i + 2**63:016X}"


@pytest.mark.parametrize("n", [0, 1, 57, 200])
def test_smallest(spark, n):
    df = spark.range(200).withColumn("t", F.col("id") % 3)
    predicate = ranking.smallest(df, F.concat(ranking.order_hex(F.col("t")), ranking.order_hex(F.col("id"))), n)
    if n == 0:
        assert predicate is None
        return
    got = {r.id for r in df.filter(predicate).collect()}
    assert got == set(sorted(range(200), key=lambda i: (i % 3, i))[:n])


def test_stratified(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") < 700, "big").when(F.col("id") < 1000, "mid").otherwise("tiny"))
    split = ranking.stratified_split(df, "label", "id")
    assert {(r.label, r.n) for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {
        ("big", 140), ("mid", 60), ("tiny", 1),
    }
    sizes = ranking.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    for label, total in (("big", 700), ("mid", 300), ("tiny", 3)):
        counts = [r["count"] for r in sizes if r.label == label]
        assert sum(counts) == total and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("rows", [200, 30_000])
def test_stratified_with_missing_labels(spark, rows):
    df = spark.range(rows).withColumn("label", F.when(F.col("id") % 4 > 0, "some"))
    split = ranking.stratified_split(df, "label", "id")
    assert {(r.label, r["count"]) for r in split.filter("is_test").groupBy("label").count().collect()} == {(None, rows // 20), ("some", 3 * rows // 20)}
    folds = ranking.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in folds} == {(None, rows // 20), ("some", 3 * rows // 20)} and len(folds) == 10


def test_best_candidate_breaks_ties_by_rank(spark):
    df = spark.createDataFrame([(1, 1, "x", 0.5), (1, 2, "y", 0.9), (1, 3, "z", 0.9)], "req_id long, rank int, k string, rerank_score double")
    assert [(r.k, r["rank"]) for r in ranking.best_candidate(df).collect()] == [("y", 2)]


def test_dedup_plan_prunes_before_shuffle(spark):
    df = spark.range(1000).withColumn("q", (F.col("id") % 2).cast("string"))
    out = ranking.dedup_keep_first(df, ["q"], "id")
    assert sorted(r.id for r in out.collect()) == [0, 1]
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_repeated_sort_keys_are_refused(spark):
    df = spark.range(100).withColumn("s", F.lit("00ff"))
    with pytest.raises(ValueError):
        ranking.rank_cuts(df, F.lit(0), F.col("s"), {0: [5]}, finish_rows=10)
