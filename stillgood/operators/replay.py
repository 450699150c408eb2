"""Replay of a timed request log against per-key lifetimes.

The first request of a key stores its answer; later ones hit until it expires;
the first one at or after expiry stores again.  Hits never extend a lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import written
from .lookup import DAY_US, _asof_sliced, _slice_width
from .ranking import bin_of

NEVER = (1 << 62) - 1
SLICE_ROWS = 1_000_000


def replay_sorted(at: np.ndarray, ttl: np.ndarray, expiry: int | None):
    """One key's requests in time order; returns (hit, expires, last expiry)."""
    hit = np.zeros(len(at), dtype=bool)
    expires = np.zeros(len(at), dtype=np.int64)
    position = 0
    while position < len(at):
        if expiry is not None:
            served = position + int(np.searchsorted(at[position:], expiry, side="left"))
            hit[position:served] = True
            expires[position:served] = expiry
            position = served
            if position == len(at):
                break
        expiry = min(int(at[position]) + int(ttl[position]), NEVER)
        expires[position] = expiry
        position += 1
    return hit, expires, expiry


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key-sorted batches of one partition; state is one expiry, whatever the key's size.

    Only key, time and lifetime are looked at: the log's own columns stay as Arrow has them.
    """
    open_key, expiry = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        at, ttl = (batch.column(c).to_numpy().astype(np.int64) for c in ("_at", "_ttl"))
        hit, expires = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(at)]])
        for start, end in zip(starts[:-1], starts[1:]):
            if keys[start] != open_key:
                open_key, expiry = keys[start], None
            hit[start:end], expires[start:end], expiry = replay_sorted(
                at[start:end], ttl[start:end], expiry
            )
        kept = [c for c in batch.schema.names if c not in ("_key", "_at", "_ttl")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(hit), pa.array(expires)], [*kept, "hit", "expires_us"]
        )


def _replay_whole(log: DataFrame) -> DataFrame:
    out = StructType(
        [f for f in log.schema.fields if f.name not in ("_key", "_at", "_ttl", "_id")]
        + [StructField("hit", BooleanType()), StructField("expires_us", LongType())]
    )
    return log.repartition("_key").sortWithinPartitions("_key", "_at", "_id").drop("_id").mapInArrow(
        _walk, out
    )


def _superblock(t: Column, origin: int, width: int, level: int) -> Column:
    return F.shiftright(bin_of(t - origin, width), level)


def _store_times(instants: DataFrame, slice_us: int) -> DataFrame:
    """Instants (key, t) at which hot keys store, found without walking a key in order.

    Lifetimes have to be positive here, see :func:`_replay_hot`.

    Every instant points at the first one at or after its own expiry.  Time is
    cut into blocks no longer than the shortest lifetime, so a block holds at
    most one store.  Going up, pointers of adjacent blocks are composed, keeping
    only instants by which a larger block can be entered; going down, the
    entries actually reached from the first request are collected.
    """
    points = instants.withColumn("until", F.least(F.col("t") + F.col("ttl"), F.lit(NEVER)))
    # "first at or after" is "last at or before" on negated time
    ahead = _asof_sliced(
        points.select(F.col("key").alias("entry_key"), "t", (-F.col("until")).alias("at_us")),
        points.select(
            F.col("key").alias("entry_key"), (-F.col("t")).alias("cached_us"), F.lit(0).alias("seq")
        ),
        F.struct("cached_us"), "at_us", slice_us,
    )
    hops = written(
        ahead.select(F.col("entry_key").alias("key"), F.col("t").alias("i"), (-F.col("_w.cached_us")).alias("g"))
    )
    bounds = points.agg(F.min("ttl").alias("ttl"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    width, origin = bounds["ttl"], bounds["lo"]
    levels = ceil(log2((bounds["hi"] - origin) // width + 1))

    def apart(level: int) -> Column:
        ends = [_superblock(F.col(c), origin, width, level) for c in ("i", "g")]
        return ends[0] != ends[1]

    firsts = points.groupBy("key").agg(F.min("t").alias("i"))
    table = [hops]
    for level in range(1, levels + 1):
        below = table[-1]
        crosses = apart(level)
        entries = (
            below.filter(F.col("g").isNotNull() & crosses).select("key", F.col("g").alias("i"))
            .unionByName(firsts).distinct()
        )
        onward = below.select("key", F.col("i").alias("g"), F.col("g").alias("_onward"))
        composed = (
            entries.join(below, ["key", "i"]).join(onward, ["key", "g"], "left")
            .select("key", "i", F.when(crosses, F.col("g")).otherwise(F.col("_onward")).alias("g"))
        )
        table.append(written(composed))
    reached = firsts
    for level in range(levels - 1, -1, -1):
        steps = reached.join(table[level], ["key", "i"]).filter(
            F.col("g").isNotNull() & ~apart(level + 1)
        )
        reached = written(
            reached.unionByName(steps.select("key", F.col("g").alias("i"))).distinct()
        )
    return reached.select("key", F.col("i").alias("t"))


def _replay_hot(log: DataFrame, columns: list[str], slice_us: int) -> DataFrame:
    """Requests whose answer is stored for no time serve nobody, so the chain of stores leaves them out.

    They are looked up in it: a hit if a store before them still holds, else a store of their own.
    """
    instants = log.filter("_ttl > 0").groupBy(F.col("_key").alias("key"), F.col("_at").alias("t")).agg(
        F.min_by("_ttl", "_id").alias("ttl"), F.min("_id").alias("first_id")
    )
    instants = written(instants)
    if instants.isEmpty():
        return log.select(*columns, F.lit(False).alias("hit"), (F.col("_at") + F.col("_ttl")).alias("expires_us"))
    stores = instants.join(_store_times(instants, slice_us), ["key", "t"]).select(
        F.col("key").alias("entry_key"),
        F.col("t").alias("cached_us"),
        F.least(F.col("t") + F.col("ttl"), F.lit(NEVER)).alias("expires_us"),
        "first_id",
        F.lit(0).alias("seq"),
    )
    requests = log.withColumnRenamed("_key", "entry_key").withColumnRenamed("_at", "at_us_")
    found = _asof_sliced(
        requests, stores, F.struct("cached_us", "expires_us", "first_id"), "at_us_", slice_us
    )
    w = F.col("_w")
    later = (w["cached_us"] < F.col("at_us_")) | (w["first_id"] < F.col("_id"))
    held = F.coalesce(later & (F.col("at_us_") < w["expires_us"]), F.lit(False))
    lasts = F.col("_ttl") > 0
    return found.select(
        *columns,
        F.when(lasts, (w["cached_us"] != F.col("at_us_")) | (w["first_id"] != F.col("_id"))).otherwise(held).alias("hit"),
        F.when(lasts | held, w["expires_us"]).otherwise(F.col("at_us_") + F.col("_ttl")).alias("expires_us"),
    )


def ttl_replay(
    log: DataFrame,
    key: str,
    at_us: str,
    ttl_us: Column,
    row_id: str,
    max_group_rows: int = 20_000_000,
) -> DataFrame:
    """Adds ``hit`` and ``expires_us`` to each request of the log.

    ``ttl_us`` is the lifetime a store made by that request would get; NULL
    never expires.  Keys are walked in time order within their partition, one
    Arrow batch in memory at a time; a key with more than ``max_group_rows``
    requests would take too long there and goes the block-composition route.
    """
    prepared = log.select(
        "*",
        F.col(key).alias("_key"),
        F.col(at_us).cast("long").alias("_at"),
        F.col(row_id).alias("_id"),
        F.coalesce(ttl_us.cast("long"), F.lit(NEVER)).alias("_ttl"),
    )
    hot = prepared.groupBy("_key").count().filter(F.col("count") > max_group_rows).select("_key")
    if hot.isEmpty():
        return _replay_whole(prepared)
    hot = written(hot, "hot-keys")
    cold = _replay_whole(prepared.join(hot, "_key", "left_anti").select(*prepared.columns))
    crowded = prepared.join(hot, "_key", "left_semi").select(*prepared.columns)
    timeline = crowded.select(F.col("_key").alias("entry_key"), F.col("_at").alias("_t"))
    slice_us = _slice_width(timeline, DAY_US, min(max_group_rows, SLICE_ROWS))
    return cold.unionByName(_replay_hot(crowded, log.columns, slice_us))
