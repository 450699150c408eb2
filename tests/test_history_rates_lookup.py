import random
import re

import pytest
from pyspark.sql import functions as F

from stillgood.operators import history, lookup, memo, rates


def conversation_rows():
    random.seed(5)
    rows = []
    for conv in range(6):
        for turn in range(random.randrange(1, 40)):
            rows.append((conv, turn * random.choice([1, 1, 3]) + turn * 100, random.choice(["user", "assistant", "system"]), f"c{conv}t{turn}"))
    return rows


def expected_history(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        past, before = [], None
        for _, turn, role, text in sorted(r for r in rows if r[0] == conv):
            if role == "user":
                out[(conv, turn)] = past[-3:]
            if role == "assistant" and before and before[0] == "user":
                past = past + [(before[1], text)]
            before = (role, text)
    return out


@pytest.mark.parametrize("bound", [1_000_000, 50, 3])
def test_history_whole_and_sliced(spark, bound):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = history.requests_with_history(df, max_group_rows=bound).collect()
    assert {(r.conv_id, r.turn): [tuple(m) for m in r.history] for r in got} == expected_history(rows)
    assert len(got) == sum(r[2] == "user" for r in rows)


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_rate_whole_and_folded(spark, bound):
    random.seed(6)
    base = 1_700_000_000_000_000
    rows = [(i, base + random.choice([0, 60_000_000, random.randrange(300_000_000)]), random.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, at_us long, is_call boolean")
    got = {r.id: r.rate for r in rates.api_rate(df, F.col("is_call"), max_group_rows=bound).collect()}
    want = {i: sum(c and 0 < t - u < 60_000_000 for _, u, c in rows) for i, t, _ in rows}
    assert got == want


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_rate_is_a_running_sum(spark, bound):
    """No window adds up its look-back again for every row: all frames begin at the start of their block."""
    base = 1_700_000_000_000_000
    rows = [(i, base + (i // 3) * 7_000_000 + i % 3, None if i % 11 == 0 else i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at_us long, is_call boolean")
    rated = rates.api_rate(df, F.col("is_call"), max_group_rows=bound)
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", rated._jdf.queryExecution().analyzed().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}
    want = {i: sum(bool(c) and 0 < t - u < 60_000_000 for _, u, c in rows) for i, t, _ in rows}
    assert {r.id: r.rate for r in rated.collect()} == want


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_asof_whole_and_sliced(spark, bound):
    random.seed(7)
    requests = [(i, random.choice("hhhhab"), random.randrange(1000)) for i in range(300)]
    writes = [
        (random.choice("hhhab"), random.randrange(1000), i, random.choice([None, 30, 400]), random.choice(["", "x", "y", "z"]))
        for i in range(60)
    ]
    r = spark.createDataFrame(requests, "id long, entry_key string, at_us long")
    w = spark.createDataFrame(writes, "entry_key string, cached_us long, seq long, ttl long, answer string").withColumn(
        "expires_us", F.col("cached_us") + F.col("ttl")
    ).withColumn("category", F.lit("Static"))
    got = {x.id: (x.hit, x.answer) for x in lookup.asof_lookup(r, w, max_group_rows=bound, slice_us=50).collect()}
    want = {}
    for i, key, at in requests:
        seen = [x for x in writes if x[0] == key and x[1] <= at]
        newest = max(seen, key=lambda x: (x[1], x[2])) if seen else None
        hit = bool(newest and newest[4] and (newest[3] is None or at < newest[1] + newest[3]))
        want[i] = (hit, newest[4] if hit else None)
    assert got == want


def test_snapshot_lookup(spark):
    cache = spark.createDataFrame(
        [("a", 0, 100, "A", "Static"), ("b", 0, None, "", "Static"), ("c", 50, None, "C", "Static")],
        "entry_key string, cached_us long, expires_us long, answer string, category string",
    )
    requests = spark.createDataFrame([(1, "a", 99), (2, "a", 100), (3, "b", 5), (4, "c", 49), (5, "c", 50), (6, None, 1)], "id long, entry_key string, at_us long")
    got = {r.id: r.answer for r in lookup.exact_lookup(requests, cache).collect()}
    assert got == {1: "A", 2: None, 3: None, 4: None, 5: "C", 6: None}


def test_memo_scores_each_distinct_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(text):
        calls.add(1)
        return None if text is None else len(text)

    df = spark.createDataFrame([(i, "same") for i in range(50)] + [(50, "other"), (51, None)], "id long, t string")
    got = {r.id: r.score for r in memo.memo_score(df, ["t"], lambda c: slow(c)).collect()}
    assert got == {**{i: 4 for i in range(50)}, 50: 5, 51: None}
    assert calls.value == 3


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_requests_without_a_key_miss(spark, bound):
    """Whatever the size of other keys, a null key meets no write, not even one without a key."""
    writes = spark.createDataFrame([(None, 0, None, "lost", "Static", 1), ("k", 0, None, "kept", "Static", 2)],
                                   "entry_key string, cached_us long, expires_us long, answer string, category string, seq long")
    asked = spark.createDataFrame([(i, None if i % 2 else "k", 10 + i) for i in range(12)], "req_id long, entry_key string, at_us long")
    got = {r.req_id: (r.hit, r.answer) for r in lookup.asof_lookup(asked, writes, max_group_rows=bound).collect()}
    assert got == {i: (False, None) if i % 2 else (True, "kept") for i in range(12)}
