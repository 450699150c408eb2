import math
import random

import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.functions import scores
from stillgood.functions.vectors import cosine, l2_normalize


def test_pyfs_golden(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0)], "a double, b double")
    got = [r[0] for r in rows.select(scores.pyfs(F.col("a"), F.col("b"))).collect()]
    assert (got[0].mu, got[0].nu, round(got[0].pi, 6), got[0].score) == (0.5, 0.5, 0.707107, 0.0)
    assert (round(got[1].mu, 6), round(got[1].nu, 6), round(got[1].score, 6)) == (0.880797, 0.119203, 0.761594)


def test_pyfs_identities(spark):
    random.seed(1)
    rows = spark.createDataFrame(
        [(random.uniform(-9, 9), random.uniform(-9, 9)) for _ in range(500)], "a double, b double"
    )
    for r in rows.select(scores.pyfs(F.col("a"), F.col("b")).alias("p")).select("p.*").collect():
        assert math.isclose(r.nu, 1 - r.mu, abs_tol=1e-12)
        assert math.isclose(r.score, 2 * r.mu - 1, abs_tol=1e-12)
        assert math.isclose(r.mu**2 + r.nu**2 + r.pi**2, 1, abs_tol=1e-9)


@pytest.mark.parametrize("rate, expected", [(0, 0.80), (2, 0.80), (3, 0.75), (10, 0.75), (11, 0.70)])
def test_dynamic_threshold(spark, rate, expected):
    assert spark.range(1).select(scores.dynamic_threshold(F.lit(rate))).first()[0] == expected


def test_acceptance_edges(spark):
    row = spark.range(1).select(
        scores.fast_accept(F.lit(0.8), 0.8), scores.floor_accept(F.lit(0.75), 0.75),
        scores.verify_pair(F.lit(0.71), F.lit(0.30), F.lit(1.51)),
        scores.verify_pair(F.lit(0.70), F.lit(0.30), F.lit(1.51)),
        scores.verify_pair(F.lit(0.71), F.lit(None).cast("double"), F.lit(1.51)),
    ).first()
    assert tuple(row) == (False, True, True, False, False)


def test_admission(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0, 1.0, "ok"), (0.4, 0.5, 0.7, "ok"), (None, None, None, "ok"), (1.0, 1.0, 1.0, "It Depends!")],
        "r double, c double, f double, answer string",
    )
    got = [
        (v.combined_score, v.admit_to_cache, v.mode)
        for (v,) in rows.select(scores.admission(F.col("r"), F.col("c"), F.col("f"), 0.5, F.col("answer"))).collect()
    ]
    assert got == [
        (1.0, True, C.MODE_JUDGED), (0.49, False, C.MODE_JUDGED), (0.0, False, C.MODE_JUDGED), (0.0, False, C.MODE_BLOCKED),
    ]


def test_lifetimes(spark):
    labels = spark.createDataFrame([("Static",), ("Slow-Moving",), ("Volatile",), ("other",), (None,)], "l string")
    live = [r[0] for r in labels.select(scores.label_seconds(F.col("l"))).collect()]
    assert live == [604800, 259200, 300, None, None]
    model = [r[0] for r in labels.select(scores.label_seconds(F.col("l"), C.CLASSIFIER_LIFETIMES)).collect()]
    assert model == [None, 2592000, 300, None, None]


def test_confidence_gate(spark):
    rows = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.33, 0.33, 0.34],), ([0.4, 0.4, 0.2],)], "p array<double>")
    got = [tuple(r[0]) for r in rows.select(scores.confidence_gate(F.col("p"), ["A", "B", "C"])).collect()]
    assert got == [
        ("B", 0.5, "embedding_classifier"), ("Volatile", 0.34, "fallback_low_confidence"), ("A", 0.4, "embedding_classifier"),
    ]


def test_fail_safe_and_prob_map(spark):
    rows = spark.createDataFrame([("Static", 0.9), (None, 0.9), ("Static", None)], "l string, c double")
    got = [tuple(r[0]) for r in rows.select(scores.fail_safe_label(F.col("l"), F.col("c"))).collect()]
    assert got == [("Static", 0.9), ("Volatile", 0.0), ("Volatile", 0.0)]
    one_hot = rows.select(scores.prob_map(C.CLASSES, label=F.col("l"))).first()[0]
    assert one_hot == {"Static": 1.0, "Slow-Moving": 0.0, "Volatile": 0.0}


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(cosine(F.col("a"), F.col("b")), l2_normalize(F.col("a"))).collect()
    assert math.isclose(got[0][0], 0.96) and got[1][0] == 0.0 and got[2][0] is None
    assert got[0][1] == pytest.approx([0.6, 0.8]) and got[1][1] == [0.0, 0.0]
