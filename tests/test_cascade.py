import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.functions.plugins import Plugins, batch_model, only_where
from stillgood.functions.text import cache_key
from stillgood.operators.knn import knn_join
from stillgood.plans.answer_cache import AnswerCache
from stillgood.plans.cascade import cascade, prototype_cascade, resolve_context, store_misses
from stillgood.plans.evaluation import evaluation_rows, write_evaluation
from stillgood.sources import io
from stillgood.streaming.streams import cascade_stream, file_stream

REQUEST = (
    "req_id long, query string, at_us long, label string, confidence double, embedding array<double>, "
    "history array<struct<query:string,response:string>>"
)
ENTRY = "query string, answer string, category string, cached_us long, expires_us long, embedding array<double>"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY).withColumn("entry_key", cache_key(F.col("query")))


def semantic(spark):
    return entries(
        spark,
        [
            ("capital of france", "Paris", "Static", 0, None, [1.0, 0.0, 0.0]),
            ("size of mars", "small", None, 0, None, [0.0, 1.0, 0.0]),
            ("why not ibuprofen", "ulcers", "Slow-Moving", 0, 10, [0.0, 0.0, 1.0]),
        ],
    )


def exact(spark):
    return entries(spark, [("  Known ", "stored", "Static", 0, 1000, None), ("stale", "old", "Static", 0, 5, None)])


def requests(spark):
    return spark.createDataFrame(
        [
            (1, "price now", 10, "Volatile", 0.9, [1.0, 0.0, 0.0], None),
            (2, "known", 10, "Static", 0.9, [1.0, 0.0, 0.0], None),
            (3, "stale", 10, "Static", 0.9, [0.5, 0.5, 0.7], None),
            (4, "France capital?", 10, "Static", 0.9, [0.99, 0.05, 0.0], None),
            (5, "mars diameter", 10, "Static", 0.9, [0.6, 0.75, 0.0], None),
            (6, "ibuprofen safe", 10, "Static", 0.9, [0.0, 0.6, 0.75], None),
            (7, "unlabelled", 10, None, None, [1.0, 0.0, 0.0], None),
            (8, "France capital?", 10, "Static", 0.9, [0.99, 0.05, 0.0], None),
        ],
        REQUEST,
    )


def reranker():
    def load():
        def score(queries, cached):
            assert "France capital?" not in queries, "an accepted request reached the reranker"
            return [0.9 if c != "capital of france" else 0.1 for c in cached]

        return score

    return batch_model(load, "double")


def logits():
    table = {("mars diameter", "size of mars"): 3.0, ("size of mars", "mars diameter"): 2.0}
    return batch_model(lambda: lambda a, b: [table.get(pair, -2.0) for pair in zip(a, b)], "double")


def relevance():
    return batch_model(lambda: lambda q, a: [2.0 for _ in q], "double")


def plugins(**more):
    return Plugins(reranker=reranker(), contradiction=logits(), relevance=relevance(), **more)


def test_every_path(spark):
    out = cascade(requests(spark), exact(spark), semantic(spark), C.CacheConfig(), plugins())
    got = {r.req_id: r for r in out.collect()}
    assert {i: r.source for i, r in got.items()} == {
        1: C.GEMINI_VOLATILE, 2: C.REDIS_HIT, 3: C.GEMINI_API, 4: C.CACHE_HIT_FAST, 5: C.CACHE_HIT_VERIFIED,
        6: C.GEMINI_API, 7: C.GEMINI_VOLATILE, 8: C.CACHE_HIT_FAST,
    }
    assert got[2].answer == "stored" and got[2].category is None
    assert (got[4].answer, got[4].category, got[4].rerank_score) == ("Paris", "Static", None)
    assert (got[5].answer, got[5].category, got[5].cached_category) == ("small", None, "Static")
    assert got[5].nu <= 0.3 and got[5].mu == pytest.approx(1 - got[5].nu, abs=1e-4)
    assert got[3].answer == "[LLM placeholder for: stale]"
    assert (got[7].category, got[7].confidence) == ("Volatile", 0.0)


def test_expired_answers_leave_the_semantic_tier_on_request(spark):
    asked = requests(spark).filter("req_id = 6").withColumn("embedding", F.expr("array(0D, 0D, 1D)"))
    for expire, source in ((False, C.CACHE_HIT_FAST), (True, C.GEMINI_API)):
        out = cascade(asked, exact(spark), semantic(spark), C.CacheConfig(expire_semantic=expire), plugins())
        assert out.first().source == source


def test_empty_cache_and_rate_driven_threshold(spark):
    asked = requests(spark).filter("req_id = 6").withColumn("rate", F.lit(11))
    assert cascade(asked, exact(spark), semantic(spark).filter("false"), plugins=plugins()).first().source == C.GEMINI_API
    assert cascade(asked, exact(spark), semantic(spark), plugins=plugins()).first().source == C.CACHE_HIT_FAST


def test_rewriting_reaches_only_follow_ups(spark):
    def load():
        return lambda prompts: [p.split("Context: ")[1].split(":")[0].upper() for p in prompts]

    rows = [
        (1, "what about it", [("paris", "a city"), ("mars", "a planet")]), (2, "what about it", []),
        (3, "nothing here", [("paris", "a city")]), (4, "and they said", None),
    ]
    df = spark.createDataFrame(rows, "req_id long, query string, history array<struct<query:string,response:string>>")
    got = {r.req_id: (r.query, r.rewritten) for r in resolve_context(df, Plugins(rewriter=batch_model(load, "string"))).collect()}
    assert got == {1: ("MARS", True), 2: ("what about it", False), 3: ("nothing here", False), 4: ("and they said", False)}


def test_failing_rewriter_keeps_the_query(spark):
    def load():
        def broken(prompts):
            raise RuntimeError("model down")

        return broken

    df = spark.createDataFrame(
        [(1, "what about it", [("a", "b")])], "req_id long, query string, history array<struct<query:string,response:string>>"
    )
    out = resolve_context(df, Plugins(rewriter=batch_model(load, "string", on_error="null")))
    assert tuple(out.select("query", "rewritten").first()) == ("what about it", False)


def test_only_where_hides_other_rows(spark):
    def load():
        def check(values):
            assert all(v >= 5 for v in values)
            return [v * 2.0 for v in values]

        return check

    model = batch_model(load, "double", batch_size=2)
    got = spark.range(8).select("id", only_where(F.col("id") >= 5, model, F.col("id").cast("double")).alias("x")).collect()
    assert {r.id: r.x for r in got} == {**{i: None for i in range(5)}, 5: 10.0, 6: 12.0, 7: 14.0}


def judge(signal, prompt):
    return F.when(F.contains(prompt, F.lit("stale")), F.lit("0.1")).otherwise(F.lit("Score: 0.9"))


def test_store_misses(spark):
    decided = cascade(requests(spark), exact(spark), semantic(spark), C.CacheConfig(), plugins(judge=judge))
    judged, table = store_misses(decided, semantic(spark), plugins(judge=judge))
    assert {r.req_id: r.admission for r in judged.collect()} == {3: "blocked", 6: "admitted"}
    stored = {r.query: r.expires_us for r in table.collect()}
    assert stored["ibuprofen safe"] == 10 + 7 * 86_400_000_000
    assert len(stored) == 4


def test_prototype(spark):
    asked = requests(spark).filter("req_id IN (1, 2, 5)").select("req_id", "query", "at_us", "embedding")
    out = prototype_cascade(asked, exact(spark), semantic(spark), C.CacheConfig(), Plugins(contradiction=logits()))
    got = {r.req_id: (r.source, r.category) for r in out.collect()}
    assert got == {1: ("llm", "volatile"), 2: ("redis_hit", None), 5: ("chroma_hit", None)}


def test_stream_sees_earlier_batches(spark, tmp_path):
    """Asked again in a later batch, an admitted miss is an exact hit and its paraphrase a semantic one."""
    first = [(1, "size of venus", 10, "Static", 0.9, [0.0, 1.0, 0.0], None), (2, "price now", 11, "Volatile", 0.9, [1.0, 0.0, 0.0], None)]
    second = [
        (3, "Size of Venus ", 20, "Static", 0.9, [0.0, 1.0, 0.0], None), (4, "venus size", 21, "Static", 0.9, [0.05, 1.0, 0.0], None),
        (5, "price now", 22, "Volatile", 0.9, [1.0, 0.0, 0.0], None),
    ]
    third = [(6, "venus size", 30, "Static", 0.9, [0.05, 1.0, 0.0], None)]
    for rows in (first, second, third):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = file_stream(spark, str(tmp_path / "in"), REQUEST, files_per_batch=1)
    cache = AnswerCache(spark, str(tmp_path / "cache"), plugins=Plugins(judge=judge))
    cascade_stream(source, cache, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.req_id: (r.batch, r.source) for r in cache.decisions().collect()}
    assert got == {
        1: (0, C.GEMINI_API), 2: (0, C.GEMINI_VOLATILE), 3: (1, C.REDIS_HIT), 4: (1, C.CACHE_HIT_FAST),
        5: (1, C.GEMINI_VOLATILE), 6: (2, C.REDIS_HIT),
    }
    assert [r.query for r in cache.semantic.read().collect()] == ["size of venus"]
    assert {r.query for r in cache.exact.read().collect()} == {"size of venus", "venus size"}
    assert tuple(cache.sizes().first()) == (1, 2)
    assert tuple(cache.stats().first()) == (6, 50.0, 83.33)
    assert cache.admissions().count() == 1


def test_batches_repeat_and_clear(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path / "cache"), plugins=Plugins(judge=judge))
    asked = requests(spark).filter("req_id = 5")
    assert cache.ask(asked).first().source == C.GEMINI_API
    assert cache.ask(asked, batch=0).first().source == C.GEMINI_API  # a retry sees what the batch saw
    assert cache.ask(asked).first().source == C.REDIS_HIT
    cache.clear()
    assert tuple(cache.sizes().first()) == (0, 0)
    assert cache.ask(asked).first().source == C.GEMINI_API
    assert cache.decisions().count() == 3


def test_strict_rewriting_uses_every_history(spark):
    rows = [(1, "plain words", [("a", "b")]), (2, "plain words", [])]
    df = spark.createDataFrame(rows, "req_id long, query string, history array<struct<query:string,response:string>>")
    out = resolve_context(df, Plugins(rewriter=lambda prompt: F.lit("  resolved ")), strict=True)
    assert {r.req_id: (r.query, r.rewritten) for r in out.collect()} == {1: ("resolved", True), 2: ("plain words", False)}


def test_populate_then_probe_and_report(spark, tmp_path):
    """Two-phase evaluation: fill the cache, probe it, compare with the truth."""
    cache = AnswerCache(spark, str(tmp_path / "cache"), plugins=Plugins(judge=judge))
    cache.ask(requests(spark).filter("req_id IN (4, 5)"))
    later = requests(spark).withColumn("at_us", F.col("at_us") + 1)
    probes = later.select("req_id", "query", F.lit("Static").alias("primary_category"), F.col("query").alias("ground_truth_2026"))
    probes = probes.unionByName(spark.createDataFrame([(99, "lost", "Volatile", None)], probes.schema))
    rows = evaluation_rows(cache.ask(later), probes)
    got = {r.req_id: r for r in rows.collect()}
    assert got[4].cache_hit and got[4].predicted_category == C.UNKNOWN and got[4].confidence == 0.0
    assert got[1].volatile_bypass and got[99].source == C.ERROR and got[99].query == "lost"
    embedder = lambda t: F.when(F.contains(t, F.lit("placeholder")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    paths = write_evaluation(rows, str(tmp_path / "report"), embedder)
    summary = spark.read.json(paths["summary"]).first()
    assert summary.total_queries_tested == 9 and summary.metrics.staleness_rate_percent == 100.0
    wrong = io.read_csv(spark, paths["wrong_hits"]).collect()
    assert len(wrong) == sum(r.cache_hit for r in got.values()) > 0
    assert {(r.similarity_to_gt, r.is_wrong_hit) for r in wrong} == {("0.7071", "false")}


def test_requests_of_one_vector_are_searched_once(spark, monkeypatch):
    """Other words, same vector and skipped entry: one search, whose result every text gets."""
    from stillgood.plans import cascade as module

    searched = []

    def search(requests, *args, **options):
        searched.append(requests.count())
        return knn_join(requests, *args, **options)

    monkeypatch.setattr(module, "knn_join", search)
    same = [(i, f"France, capital {i % 3}", 10, "Static", 0.9, [0.99, 0.05, 0.0], None) for i in range(9)]
    other = [(9, "mars", 10, "Static", 0.9, [0.0, 1.0, 0.0], None), (10, "no vector", 10, "Static", 0.9, None, None)]
    out = cascade(spark.createDataFrame(same + other, REQUEST), exact(spark), semantic(spark), C.CacheConfig(), plugins()).collect()
    assert searched == [2]
    assert {r.req_id: r.answer for r in out} == {**{i: "Paris" for i in range(9)}, 9: "small", 10: "[LLM placeholder for: no vector]"}
    assert {r.req_id: r.embedding for r in out} == {r[0]: r[5] for r in same + other}


def test_logs_name_vectors_and_keep_each_once(spark, tmp_path):
    rows = [(i, f"text {i % 2}", i, "Static", 0.9, [1.0, float(i % 2), 0.0], None) for i in range(6)]
    rows += [(6, "gap", 6, "Static", 0.9, None, None)]
    cache = AnswerCache(spark, str(tmp_path / "cache"), plugins=Plugins(judge=judge))
    asked = cache.ask(spark.createDataFrame(rows, REQUEST))
    want = {r[0]: r[5] for r in rows}
    assert {r.req_id: r.embedding for r in asked.collect()} == want
    assert {r.req_id: r.embedding for r in cache.decisions().collect()} == want
    for log in ("decisions", "admissions"):
        assert "embedding" not in spark.read.parquet(str(tmp_path / "cache" / log)).columns
    assert spark.read.parquet(str(tmp_path / "cache" / "vectors")).count() == 2
    assert {r.query: r.embedding for r in cache.semantic.read().collect()} == {"text 0": [1.0, 0.0, 0.0], "text 1": [1.0, 1.0, 0.0], "gap": None}
    plan = cache.decisions().select("req_id", "source")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_vector_ids(spark):
    from stillgood.plans.cascade import vector_id

    vectors = [[1.0, 2.0], [2.0, 1.0], [1.0, None, 2.0], [1.0, 2.0, None], [None, 1.0, 2.0], [], [0.0], [0.0, 0.0], None]
    ids = [r.v for r in spark.createDataFrame([(v,) for v in vectors], "e array<float>").select(vector_id(F.col("e")).alias("v")).collect()]
    assert ids[-1] is None and len(set(ids)) == len(vectors)
