"""Inserts with eviction against a plain replay of the rule, one insert at a time."""

import random

import pytest

from stillgood.operators import store

SCHEMA = "entry_key string, answer string, cached_us long"


def replayed(old, inserts, cap):
    """Old entries oldest first, then each insert: a full table loses its oldest tenth before it."""
    table = [k for _, k in sorted((t or 0, k) for k, t in old.items())]
    for _, k in sorted((t or 0, k) for k, t in inserts.items()):
        if len(table) >= cap:
            table = table[max(1, len(table) // 10):]
        if k in table:
            table.remove(k)
        table.append(k)
    return set(table)


def key(i):
    return f"k:{i * 2654435761 % 2**32:08x}{i:024x}"


def frame(spark, rows, answer):
    return spark.createDataFrame([(k, answer, t) for k, t in rows.items()], SCHEMA)


def planned(old, inserts, cap):
    """What the ranks say, without Spark."""
    def order(t, k):
        return f"{(t or 0) + 2**63:016X}{k}"

    was = {k: order(t, k) for k, t in old.items()}
    new = {k: order(t, k) for k, t in inserts.items()}
    needed = sorted((s, was.get(k)) for k, s in new.items())[: len(old) + 3 * cap + 500]
    rows = store._Lists([(s, new.get(k)) for k, s in was.items()], [(s, w) for s, w in needed], len(new))
    at = store._filled(rows, len(old), len(new), cap)
    gone = sorted(new.values())[: at.evicted_inserts]
    return {k for k, s in was.items() if s > at.gone and k not in new} | {k for k, s in new.items() if s not in gone}


@pytest.mark.parametrize("seed", range(60))
def test_ranks_equal_the_replay(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 2, 3, 9, 10, 11, 19, 20, 25, 100])
    n, m = rng.choice([0, 1, cap - 1, cap, cap + 1, 3 * cap, 10 * cap + 7]), rng.choice([1, 2, 5, cap, 2 * cap + 3, 400])
    old = {key(i): rng.choice([None, rng.randrange(1000)]) for i in range(n)}
    share = rng.choice([0, 0.3, 0.9])
    inserts = {}
    for i in range(m):
        inserts[key(rng.randrange(n)) if n and rng.random() < share else key(10_000 + i)] = 1000 + rng.randrange(1000)
    assert planned(old, inserts, cap) == replayed(old, inserts, cap)


@pytest.mark.parametrize("m", [1, 50, 5000])
def test_a_full_table_stays_below_its_cap(spark, m):
    old = {key(i): i for i in range(1000)}
    inserts = {key(i * 7 if i % 9 == 0 else 5000 + i): 2000 + i for i in range(m)}
    table = store.insert_all(frame(spark, old, "old"), frame(spark, inserts, "new"), 1000)
    rows = table.collect()
    want = replayed(old, inserts, 1000)
    assert {r.entry_key for r in rows} == want and len(rows) == len(want) <= 1000
    assert all((r.answer == "new") == (r.entry_key in inserts) for r in rows)


@pytest.mark.parametrize("n, m, cap", [(40, 12, 40), (12, 14, 10), (0, 25, 10)])
def test_beyond_the_bound_on_held_rows(spark, n, m, cap):
    """The same ranks from histograms in Spark."""
    old = {key(i): i for i in range(n)}
    inserts = {key(i * 3 if i % 4 == 0 and n else 500 + i): 100 + i // 2 for i in range(m)}
    table = store.insert_all(frame(spark, old, "old"), frame(spark, inserts, "new"), cap, held_rows=0)
    assert {r.entry_key for r in table.collect()} == replayed(old, inserts, cap)


def test_repeats_nothing_and_late_times(spark):
    old, none = {key(1): 50, key(2): 60}, frame(spark, {}, "x")
    cache = frame(spark, old, "old")
    assert store.insert_all(cache, none, 2).count() == 2 and store.insert_all(none, none, 2).count() == 0
    twice = frame(spark, {key(3): 5}, "first").union(frame(spark, {key(3): 7}, "last"))
    got = {r.entry_key: r.answer for r in store.insert_all(cache, twice, 2).collect()}
    assert got == {key(2): "old", key(3): "last"}  # the oldest goes, a late insert counts as newest
    with pytest.raises(ValueError):
        store.insert_all(cache, none, 0)
