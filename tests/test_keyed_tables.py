"""Tables by hash bucket, scores kept across batches, judge errors and the exact rate of a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.functions.plugins import Plugins, batch_model
from stillgood.operators import admission, memo, rates, store
from stillgood.plans.answer_cache import AnswerCache
from stillgood.streaming import streams


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, answer string")


def content(df):
    return {r.id: r.answer for r in df.collect()}


def files(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet") and "_bucket=" in folder
    }


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    table = store.KeyedTable(spark, path, "id long, answer string", "id", buckets=8)
    assert table.read().count() == 0 and table.before(0).count() == 0
    table.merge(0, frame(spark, {i: "a" for i in range(100)}))
    first = files(path)
    table.merge(1, frame(spark, {7: "b"}))
    second = files(path)
    assert len({os.path.dirname(f) for f in first}) == 8
    assert len({os.path.dirname(f) for f in set(first) ^ set(second)}) == 1
    assert all(second[f] == first[f] for f in set(first) & set(second))
    assert content(table.read()) == {i: "b" if i == 7 else "a" for i in range(100)}
    assert content(table.before(1)) == {i: "a" for i in range(100)}
    table.merge(2)
    assert files(path) == second
    with pytest.raises(ValueError):
        store.KeyedTable(spark, path, "id long, answer string", "id", buckets=4).merge(2, frame(spark, {1: "c"}))


def test_a_batch_that_runs_again_takes_back_what_it_wrote(spark, tmp_path):
    table = store.KeyedTable(spark, str(tmp_path / "t"), "id long, answer string", "id", buckets=3)
    table.merge(0, frame(spark, {1: "a", 2: "a", 3: None}))
    table.merge(1, frame(spark, {2: "b", 9: "b"}), frame(spark, {1: "", 2: "", 77: ""}))
    assert content(table.read()) == {2: "b", 3: None, 9: "b"}  # an entry wins over a removal
    assert content(table.before(1)) == {1: "a", 2: "a", 3: None}
    table.merge(1, frame(spark, {3: "c"}))
    assert content(table.read()) == {1: "a", 2: "a", 3: "c"}
    table.merge(1)
    assert content(table.read()) == {1: "a", 2: "a", 3: None} == content(table.before(1))
    table.clear()
    assert content(table.read()) == {} == content(table.before(1))
    table.merge(1, frame(spark, {5: "d"}))
    assert content(table.read()) == {5: "d"}


def test_random_merges_equal_a_dict(spark, tmp_path):
    rng, want = random.Random(3), {}
    table = store.KeyedTable(spark, str(tmp_path / "t"), "id long, answer string", "id", buckets=4)
    for batch in range(5):
        before = dict(want)
        for attempt in range(rng.choice([1, 2])):
            want = dict(before)
            entries = {rng.randrange(30): f"{batch}{attempt}" for _ in range(rng.randrange(9))}
            gone = {rng.randrange(30): "" for _ in range(rng.randrange(6))}
            table.merge(batch, frame(spark, entries), frame(spark, gone))
            want = {k: v for k, v in want.items() if k not in gone} | entries
            assert content(table.read()) == want and content(table.before(batch)) == before


def test_stale_rows_leave_with_their_bucket(spark, tmp_path):
    table = store.KeyedTable(spark, str(tmp_path / "t"), "id long, answer string", "id", buckets=1)
    table.merge(0, frame(spark, {1: "old", 2: "new", 3: None}))
    table.merge(1, frame(spark, {4: "new"}), stale=F.col("answer") == "old")
    assert content(table.read()) == {2: "new", 3: None, 4: "new"}


def counted(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def score(texts):
            seen.add(len(texts))
            return [float(len(t)) for t in texts]

        return score

    return seen, batch_model(load, "double")


def test_each_distinct_text_is_scored_once_over_two_batches(spark, tmp_path):
    seen, model = counted(spark)
    kept = memo.ScoreTable(spark, str(tmp_path / "s"), capacity=100, buckets=2)
    first = spark.createDataFrame([(i, "x" * (i % 5 + 1)) for i in range(40)] + [(99, None)], "id long, text string")
    second = spark.createDataFrame([(i, "x" * (i % 8 + 1)) for i in range(40)], "id long, text string")
    got = {r.id: r.score for r in kept.score(first, ["text"], model, batch=0).collect()}
    assert got == {i: i % 5 + 1.0 for i in range(40)} | {99: None} and seen.value == 5
    got = {r.id: r.score for r in kept.score(second, ["text"], model, batch=1).collect()}
    assert got == {i: i % 8 + 1.0 for i in range(40)} and seen.value == 8
    kept.score(second, ["text"], model, batch=1)  # a retry scores what it scored before
    assert seen.value == 11 and kept.entries().count() == 8
    assert kept.score(second.limit(0), ["text"], model, batch=2).count() == 0


def test_oldest_scores_go_first(spark, tmp_path):
    _, model = counted(spark)
    kept = memo.ScoreTable(spark, str(tmp_path / "s"), capacity=3, buckets=2)
    for batch, texts in enumerate((["a", "b"], ["a", "c"], ["d", "b"])):
        kept.score(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], model, batch=batch)
    made = {r.digest: r.made for r in kept.entries().collect()}
    digests = {t: spark.createDataFrame([(t,)], "text string").select(memo.input_digest(["text"])).first()[0] for t in "abcd"}
    oldest = min(digests["a"], digests["b"])  # equal batches go by digest
    assert made == {digests[t]: b for t, b in (("a", 0), ("b", 0), ("c", 1), ("d", 2)) if digests[t] != oldest}


def test_digest_tells_nulls_and_borders_apart(spark):
    rows = [("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", memo.input_digest(["a", "b"]))
    assert df.select("d").distinct().count() == len(rows)
    scored = memo.memo_score(df, ["a", "b"], lambda a, b: F.concat_ws("|", a, b), "s")
    assert {(r.a, r.b): r.s for r in scored.collect()} == {r: "|".join(x for x in r if x is not None) for r in rows}


def test_models_of_a_stored_cache_see_a_text_once(spark, tmp_path):
    """Classifier and embedder over two batches; the vector stays with the stored answer."""
    seen = {name: spark.sparkContext.accumulator(0) for name in ("classifier", "embedder")}
    vectors = {"size of venus": [0.0, 1.0], "venus size": [0.05, 1.0], "other": [1.0, 0.0]}

    def model(name, answer, kind):
        def load():
            def run(texts):
                seen[name].add(len(texts))
                return [answer(t) for t in texts]

            return run

        return batch_model(load, kind)

    plugins = Plugins(
        classifier=model("classifier", lambda t: {"label": "Static", "confidence": 0.9}, "struct<label: string, confidence: double>"),
        embedder=model("embedder", lambda t: vectors[t], "array<float>"),
        judge=lambda signal, prompt: F.when(F.contains(prompt, F.lit("other")), F.lit(None)).otherwise(F.lit("Score: 0.9")),
    )
    cache = AnswerCache(spark, str(tmp_path / "cache"), plugins=plugins, buckets=2)
    empty = cache.full_stats().first()
    assert (empty.total_queries, empty.semantic_entries, empty.hit_rate_percent) == (0, 0, 0.0)
    ask = lambda rows: cache.ask(spark.createDataFrame(rows, "req_id long, query string, at_us long"))
    ask([(i, ("size of venus", "other")[i % 2], 10 + i) for i in range(20)])
    assert {n: a.value for n, a in seen.items()} == {"classifier": 2, "embedder": 2}
    out = ask([(30, "venus size", 40), (31, "size of venus", 41), (32, "other", 42)])
    got = {r.req_id: r.source for r in out.collect()}
    assert got == {30: C.CACHE_HIT_FAST, 31: C.REDIS_HIT, 32: C.GEMINI_API}
    assert {n: a.value for n, a in seen.items()} == {"classifier": 3, "embedder": 3}
    stats = cache.full_stats().first().asDict()
    assert stats == {
        "redis_hits": 1, "chroma_hits_fast": 1, "chroma_hits_verified": 0, "volatile_bypasses": 0, "gemini_calls": 21,
        "gate3_admitted": 10, "gate3_blocked": 0, "gate3_errors": 11, "total_queries": 23, "gate1_rewrites": 0,
        "semantic_entries": 1, "exact_entries": 2, "classifier_entries": 3, "embedder_entries": 3,
        "reranker_entries": 0, "contradiction_entries": 0, "hit_rate_percent": 8.7, "api_reduction_percent": 8.7,
    }


def test_a_judge_that_fails_altogether_is_an_error(spark):
    rows = [("q1", "fine answer"), ("q2", "silent answer"), ("q3", "it depends"), ("q4", "half answer")]
    misses = spark.createDataFrame(rows, "query string, answer string")

    def judge(signal, prompt):
        half = F.contains(prompt, F.lit("half")) & (signal != F.lit("confidence"))
        return F.when(~F.contains(prompt, F.lit("silent")) & ~half, F.lit("Score: 0.9"))

    got = {r.query: (r.admission, r.admit_to_cache) for r in admission.judge_answers(misses, judge).collect()}
    assert got == {"q1": ("admitted", True), "q2": ("error", False), "q3": ("blocked", False), "q4": ("blocked", False)}


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_rate_of_a_stream_is_exact(spark, tmp_path, bound):
    rng, base = random.Random(8), 1_700_000_000_000_000
    rows = sorted((base + rng.choice([0, 60_000_000, rng.randrange(300_000_000)]), i, rng.random() < 0.5) for i in range(240))
    log = spark.createDataFrame([(i, t, c) for t, i, c in rows] + [(900, None, True)], "row_id long, at_us long, is_call boolean")
    path = str(tmp_path)
    cuts = [None, rows[80][0], rows[160][0], base + 10**12]
    for low, high in zip(cuts, cuts[1:]):
        part = (F.coalesce("at_us", F.lit(0)) < high) & (F.lit(True) if low is None else F.coalesce("at_us", F.lit(0)) >= low)
        log.filter(part).write.mode("append").parquet(f"{path}/log")
        source = streams.file_stream(spark, f"{path}/log", "row_id long, at_us long, is_call boolean", files_per_batch=10**6)
        streams.rate_batches(source, path, f"{path}/checkpoint", max_group_rows=bound).awaitTermination()
    done = spark.read.parquet(f"{path}/rows")
    assert done.select("batch").distinct().count() == 3
    want = {r.row_id: r.rate for r in rates.api_rate(log, F.col("is_call")).collect()}
    assert {r.row_id: r.rate for r in done.collect()} == want
