import random

import pytest
from pyspark.sql import functions as F

from stillgood.operators import store
from stillgood.operators.replay import ttl_replay
from stillgood.streaming import streams


def simulate(rows):
    expiry, out = {}, {}
    for row_id, key, at, ttl in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        hit = key in expiry and (expiry[key] is None or at < expiry[key])
        if not hit:
            expiry[key] = None if ttl is None else at + ttl
        out[row_id] = hit
    return out


@pytest.mark.parametrize("seed, bound", [(1, 1_000_000), (1, 20), (2, 20), (3, 5)])
def test_replay_matches_simulation(spark, seed, bound):
    random.seed(seed)
    rows = [
        (i, random.choice(["hot"] * 6 + ["a", "b", "c"]), random.randrange(0, 2000, random.choice([1, 10])), random.choice([30, 30, 75, 400]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id long, key string, at long, ttl long")
    got = {r.id: r.hit for r in ttl_replay(df, "key", "at", F.col("ttl"), "id", bound).collect()}
    assert got == simulate(rows)


def test_replay_never_expiring(spark):
    rows = [(i, "k", i * 10, None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, key string, at long, ttl long")
    for bound in (1000, 5):
        got = {r.id: r.hit for r in ttl_replay(df, "key", "at", F.col("ttl"), "id", bound).collect()}
        assert got == simulate(rows)


@pytest.mark.parametrize("seed, bound", [(1, 1_000_000), (1, 20), (2, 5), (3, 5)])
def test_lifetimes_of_zero_or_less_serve_nobody(spark, seed, bound):
    random.seed(seed)
    rows = [(i, random.choice(["hot"] * 6 + ["a", "b"]), random.randrange(0, 300, random.choice([1, 10])), random.choice([0, 0, -5, 30, 75])) for i in range(200)]
    rows += [(500 + i, "zero", i // 3, 0) for i in range(40)]
    for log in (rows, rows[200:]):
        df = spark.createDataFrame(log, "id long, key string, at long, ttl long")
        got = {r.id: (r.hit, r.expires_us) for r in ttl_replay(df, "key", "at", F.col("ttl"), "id", bound).collect()}
        assert {i: hit for i, (hit, _) in got.items()} == simulate(log)
        assert all(hit or got[i][1] == at + ttl for i, _, at, ttl in log for hit in [got[i][0]])


def test_state_of_the_stream_goes_when_it_cannot_serve(spark, tmp_path):
    """Three files in order of time: keys that expired are dropped, rows equal the batch replay."""
    random.seed(4)
    second, rows = 1_000_000, []
    for part in range(3):
        for i in range(120):
            key = f"k{random.randrange(30)}" if part < 2 else "late"
            ttl = random.choice([0, 2 * second, 9 * second, None if key == "k7" else 5 * second])
            rows.append((part * 120 + i, key, part * 60 * second + random.randrange(10 * second), ttl))
        spark.createDataFrame(rows[-120:], "row_id long, key string, at_us long, ttl_us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = streams.file_stream(spark, str(tmp_path / "in"), "row_id long, key string, at_us long, ttl_us long", files_per_batch=1)
    query = streams.run_append(streams.ttl_replay_stream(log, "20 seconds"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 29 and held[-1] <= 2  # what never expires, and what came last
    got = {r.row_id: (r.hit, r.expires_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    plain = ttl_replay(spark.createDataFrame(rows, "row_id long, key string, at_us long, ttl_us long"), "key", "at_us", F.col("ttl_us"), "row_id")
    assert got == {r.row_id: (r.hit, r.expires_us) for r in plain.collect()}


def entries(spark, n, at="id"):
    return spark.range(n).select(
        F.concat(F.lit("tg:"), F.md5(F.col("id").cast("string").cast("binary"))).alias("entry_key"),
        F.expr(at).cast("long").alias("cached_us"), F.lit("old").alias("answer"), F.col("id"),
    )


@pytest.mark.parametrize("n, removed", [(999, 0), (1000, 100), (1009, 100)])
def test_eviction_sizes(spark, n, removed):
    cache = entries(spark, n)
    assert {r.id for r in store.evicted(cache).collect()} == set(range(removed))
    assert store.evict(cache).count() == n - removed
    assert store.remove_entries(cache, store.evicted(cache)).count() == n - removed


def test_eviction_takes_undated_entries_first_and_keeps_order_on_ties(spark):
    cache = entries(spark, 50, "if(id = 49, null, 5)")
    got = {r.entry_key for r in store.evicted(cache, 50).collect()}
    undated = cache.filter("id = 49").first().entry_key
    rest = sorted(r.entry_key for r in cache.filter("id < 49").collect())
    assert got == {undated, *rest[:4]}


def test_upsert_replaces_by_key(spark):
    cache = entries(spark, 3)
    fresh = entries(spark, 5).filter("id >= 2").withColumn("answer", F.lit("new")).withColumn("cached_us", F.lit(0).cast("long"))
    got = {r.id: r.answer for r in store.upsert(cache, fresh).collect()}
    assert got == {0: "old", 1: "old", 2: "new", 3: "new", 4: "new"}
    assert store.clear(cache).count() == 0


def test_replay_keeps_other_columns_as_they_are(spark):
    big = 9007199254740993  # not a double
    rows = [(i, "a", i * 10, 25, big if i % 2 else None) for i in range(6)]
    log = spark.createDataFrame(rows, "row_id long, key string, at_us long, ttl_us long, payload long")
    got = {r.row_id: (r.payload, r.hit) for r in ttl_replay(log, "key", "at_us", F.col("ttl_us"), "row_id").collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: big if i % 2 else None for i in range(6)}
    assert [got[i][1] for i in range(6)] == [False, True, True, False, True, True]
