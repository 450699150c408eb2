import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.operators import lifetime
from stillgood.operators.replay import ttl_replay
from stillgood.sources import io
from stillgood.streaming import streams

AWKWARD = ['plain', 'two\nlines', 'a "quoted" word', 'comma, and \\ backslash', '  padded  ', '\\"', 'é ü 漢']


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.createDataFrame([(t, C.STATIC) for t in AWKWARD], "query string, primary_category string")
    io.write_results(df, path)
    back = io.scan_requests(spark, path)
    assert back.columns == ["query", "primary_category", "ground_truth_2026"]
    assert sorted(r.query for r in back.collect()) == sorted(AWKWARD)


def test_readers_check_their_columns(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    io.write_results(spark.createDataFrame([("x",)], "query string"), path)
    with pytest.raises(ValueError):
        io.scan_requests(spark, path)
    with pytest.raises(ValueError):
        io.scan_labelled(spark, path)
    with pytest.raises(ValueError):
        io.scan_labelled(spark, str(tmp_path / "set.xlsx"))


def test_lines(spark, tmp_path):
    (tmp_path / "q.txt").write_text("  one \n\n\t\ntwo \n")
    assert sorted(r.query for r in io.scan_lines(spark, str(tmp_path / "q.txt")).collect()) == ["one", "two"]


def test_request_bodies(spark):
    rows = [('{"query": "q", "history": [{"query": "a", "response": "b"}]}',), ('{"query": "q"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "body string").select(io.parse_requests(F.col("body"))).collect()]
    assert got[0].history[0].response == "b" and got[1].history is None


def test_checkpoint_writes_both_formats(spark, tmp_path):
    as_csv, as_json = io.write_checkpoint(spark.range(3), str(tmp_path))
    assert spark.read.json(as_json).count() == io.read_csv(spark, as_csv).count() == 3


@pytest.fixture(scope="module")
def labelled(spark):
    """Three separable classes of 40, 30 and 20 questions, each asked twice."""
    sizes = {"Static": (40, 0), "Slow-Moving": (30, 1), "Volatile": (20, 2)}
    rows, seq = [], 0
    for copy in range(2):
        for label, (n, axis) in sizes.items():
            for i in range(n):
                vector = [0.1 * ((i * 7 + d) % 5) for d in range(3)]
                vector[axis] += 3.0
                rows.append((seq, f"{label} {i}", label, vector))
                seq += 1
    return spark.createDataFrame(rows, "row_id long, Question string, Temporal_Category string, embedding array<double>")


def test_lifetime_model(spark, labelled, tmp_path):
    model, report = lifetime.train_lifetime(labelled)
    assert model.classes == ["Slow-Moving", "Static", "Volatile"]
    lines = {r.label: r for r in report.collect()}
    assert lines["accuracy"].support == 18 and lines["accuracy"].f1 == 1.0
    model.save(str(tmp_path / "m"))
    again = lifetime.LifetimeModel.load(spark, str(tmp_path / "m"))
    assert (again.classes, again.fallback_label, again.confidence_threshold) == (model.classes, "Volatile", 0.40)
    scored = lifetime.predict_lifetime(again, labelled).first()
    assert scored.label == "Static" and scored.ttl is None and scored.ttl_display == C.LIFETIME_DISPLAY["Static"]
    assert sum(scored.all_probs.values()) == pytest.approx(1.0)
    again.confidence_threshold = 1.1
    assert {r.label for r in lifetime.predict_lifetime(again, labelled).select("label").collect()} == {"Volatile"}
    assert lifetime.predict_lifetime(model, labelled.filter("false")).count() == 0
    dirty = labelled.unionByName(labelled.limit(1).withColumn("Question", F.lit(None).cast("string")))
    assert {r.label: r.support for r in lifetime.evaluate_lifetime(model, dirty).collect()}["accuracy"] == 180


def test_lifetime_without_label_or_vector(spark, labelled):
    odd = labelled.limit(1).withColumn("Question", F.lit("odd"))
    unlabelled = odd.withColumn("Temporal_Category", F.lit(None).cast("string"))
    gaps = [F.lit(None).cast("array<double>"), F.array(*[F.lit(None).cast("double")] * 2)]
    blind = [odd.withColumn("embedding", gap) for gap in gaps]
    dirty = labelled.unionByName(unlabelled).unionByName(blind[0]).unionByName(blind[1])
    model, report = lifetime.train_lifetime(dirty)
    assert {r.label: r.support for r in report.collect()}["accuracy"] == 18
    for frame in blind:
        row = lifetime.predict_lifetime(model, frame).first()
        assert (row.label, row.confidence, row.all_probs) == ("Volatile", 0.0, None)


def test_balanced_weights_reach_the_optimum(spark, labelled):
    """The penalty mapping: gradient of the weighted, regularised loss vanishes at the fit."""
    import numpy as np

    rows = [(r.Temporal_Category, list(r.embedding)) for r in lifetime.prepare_training(labelled, "Question", "row_id").collect()]
    classes = sorted({r[0] for r in rows})
    df = lifetime._vectors(spark.createDataFrame(rows, "label string, embedding array<double>"), "embedding")
    fitted = lifetime._fit(df, "label", classes).stages[0]
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    x = np.array([r[1] for r in rows])
    y = np.array([classes.index(r[0]) for r in rows])
    weight = np.array([len(y) / (len(classes) * (y == c).sum()) for c in y])
    logits = x @ w.T + b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = weight[:, None] * (p - np.eye(len(classes))[y])
    assert np.abs(error.T @ x + w).max() < 0.05  # summed loss plus |w|^2 / 2, as C = 1


def test_replay_stream_equals_batch(spark, tmp_path):
    import random

    random.seed(9)
    rows = sorted((random.randrange(5000), random.choice("aab")) for _ in range(200))
    schema = "row_id long, key string, at_us long, ttl_us long"
    for start in range(0, 200, 70):
        part = [(start + i, key, at, 300) for i, (at, key) in enumerate(rows[start:start + 70])]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    streams.run_append(streams.ttl_replay_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.row_id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    log = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    want = {r.row_id: r.hit for r in ttl_replay(log, "key", "at_us", F.col("ttl_us"), "row_id").collect()}
    assert got == want
    base = str(tmp_path / "batches")
    streams.ttl_replay_batches(stream, base, f"{base}/cp", 40).awaitTermination()
    assert {r.row_id: r.hit for r in spark.read.parquet(f"{base}/rows").collect()} == want
