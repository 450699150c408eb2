"""The threshold that its own calls move, against one walk through all requests."""

import random

import pytest
from pyspark.sql import functions as F

from stillgood.config import CacheConfig
from stillgood.operators import feedback

CONFIG = CacheConfig(rate_seconds=1)


def walked(rows, earlier, config):
    """Thresholds of ``(id, at, similarity, always)`` in order of time; one instant sees none of its own."""
    calls, out = list(earlier), {}
    width = config.rate_seconds * 1_000_000
    for at in sorted({r[1] for r in rows if r[1] is not None}):
        rate = sum(c < at and at - c < width for c in calls)
        t = config.busy_threshold if rate > config.busy_rate else config.quiet_threshold if rate < config.quiet_rate else config.normal_threshold
        for i, when, s, always in rows:
            if when == at:
                out[i] = t
                if always or not (s is not None and s > t):
                    calls.append(at)
    return out | {i: config.quiet_threshold for i, at, _, _ in rows if at is None}


def settled(spark, rows, earlier, config, slice_us=None):
    df = spark.createDataFrame(rows, "id long, at_us long, similarity double, always boolean").withColumn("band", F.lit(9))
    before = spark.createDataFrame([(t,) for t in earlier], "at_us long") if earlier is not None else None
    up = lambda t: F.col("always") | ~F.coalesce(F.col("similarity") > t, F.lit(False))
    return {r.id: r.threshold for r in feedback.settle_thresholds(df, "at_us", up, config, before, slice_us).collect()}


@pytest.mark.parametrize("seed, per_second, slice_us", [(1, 12, None), (2, 12, 1), (3, 5, 1_700_000), (4, 40, 1), (5, 2, 3_000_000)])
def test_equals_one_walk(spark, seed, per_second, slice_us):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(0, 30_000_000, rng.choice([1, 250_000])), rng.choice([None, 0.6, 0.72, 0.77, 0.78, 0.9]), rng.random() < 0.2) for i in range(30 * per_second)]
    earlier = [-100, -200_000, -999_999, -1_000_000, 400_000] if seed % 2 else None
    want = walked(rows, earlier or [], CONFIG)
    assert settled(spark, rows, earlier, CONFIG, slice_us) == want and len(set(want.values())) > 1


def test_a_chain_through_all_slices(spark):
    """Every decision hangs on the one before: slices are walked until the chain has passed."""
    rows = [(i, i * 400_000, 0.76, False) for i in range(60)]
    config = CacheConfig(rate_seconds=1, busy_rate=9, quiet_rate=1)
    want = walked(rows, [], config)
    assert set(want.values()) == {0.75, 0.80}
    assert settled(spark, rows, [], config, 1) == want and settled(spark, rows, None, config) == want


def test_crowded_instants_and_missing_times(spark):
    rows = [(i, 5, 0.5, False) for i in range(500)] + [(500, 6, 0.71, False), (501, None, 0.1, False), (502, 5, 0.9, True)]
    got = settled(spark, rows, None, CacheConfig())
    assert got[500] == 0.70 and got[501] == got[0] == got[502] == 0.80
    assert settled(spark, [], [3], CacheConfig()) == {}
    assert settled(spark, rows[501:502], None, CacheConfig()) == {501: 0.80}
