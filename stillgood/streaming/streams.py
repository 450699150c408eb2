"""Streaming forms of the replay, the cascade and the counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scores import epoch_us
from ..operators.rates import MICROS, api_rate
from ..operators.replay import NEVER, replay_sorted, ttl_replay
from ..operators.store import KeyedTable, read_or_empty
from ..plans.answer_cache import AnswerCache
from ..session import written

WATERMARK = "10 minutes"
OUT_ROWS = 100_000


def file_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream, oldest first, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def _replay_key(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """One key's requests of one micro-batch; the state is its expiry, dropped once no request can meet it.

    Of the rows three numbers each are held, and results leave in pieces.
    """
    if state.hasTimedOut:
        state.remove()
        return
    expiry = state.get[0] if state.exists else None
    parts = [tuple(rows[c].to_numpy(np.int64) for c in ("row_id", "at_us", "ttl_us")) for rows in batches]
    row_id, at, ttl = (np.concatenate(column) for column in zip(*parts))
    del parts
    order = np.lexsort((row_id, at))
    row_id, at, ttl = row_id[order], at[order], ttl[order]
    hit, expires, expiry = replay_sorted(at, ttl, expiry)
    until = -(-expiry // 1000)
    if until <= state.getCurrentWatermarkMs():
        state.remove()
    else:
        state.update((expiry,))
        if expiry < NEVER:
            state.setTimeoutTimestamp(until)
    for start in range(0, len(at), OUT_ROWS):
        piece = slice(start, start + OUT_ROWS)
        yield pd.DataFrame({"row_id": row_id[piece], "key": key[0], "at_us": at[piece], "hit": hit[piece], "expires_us": expires[piece]})


def ttl_replay_stream(log: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Streaming replay of ``log(row_id, key, at_us, ttl_us)``.

    State is one long per key that can still serve: an event-time timer drops it when the watermark,
    ``delay`` behind the newest request, has passed its expiry.  Requests that come later than the
    watermark are dropped.  Batches must arrive in time order, but for ``delay``, for the result to
    equal the batch replay; a batch bounds the rows of a key held by a task (24 bytes each).
    """
    prepared = log.select(
        "row_id", "key", F.col("at_us").cast("long"),
        F.coalesce(F.col("ttl_us").cast("long"), F.lit(NEVER)).alias("ttl_us"),
        F.timestamp_micros(F.col("at_us").cast("long")).alias("event_time"),
    ).withWatermark("event_time", delay)
    return prepared.groupBy("key").applyInPandasWithState(
        _replay_key,
        "row_id long, key string, at_us long, hit boolean, expires_us long",
        "expiry long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def ttl_replay_batches(
    log: DataFrame, path: str, checkpoint: str, max_group_rows: int = 20_000_000
) -> StreamingQuery:
    """The replay per micro-batch through the batch operator, for streams with hot keys.

    The last store of each key is carried in a keyed table and enters the
    next batch as that key's first request, so a key of any size is split as in
    the batch replay.  Rows land in ``path/rows``; a retried batch rewrites its own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        state = KeyedTable(batch.sparkSession, f"{path}/state", "key string, at_us long, expires_us long", "key")
        last = state.before(batch_id)
        carried = last.join(batch.select("key").distinct(), "key", "left_semi").select(
            F.lit(None).cast("long").alias("row_id"), "key", "at_us",
            (F.col("expires_us") - F.col("at_us")).alias("ttl_us"), F.lit(True).alias("_carried"),
        )
        rows = batch.select(
            "row_id", "key", F.col("at_us").cast("long"), F.col("ttl_us").cast("long"), F.lit(False).alias("_carried")
        )
        both = rows.unionByName(carried).withColumn("_order", F.coalesce("row_id", F.lit(-1)))
        replayed = written(
            ttl_replay(both, "key", "at_us", F.col("ttl_us"), "_order", max_group_rows), "replayed"
        )
        replayed.filter("NOT _carried").drop("_order", "ttl_us", "_carried").write.mode("overwrite").parquet(
            f"{path}/rows/batch={batch_id}"
        )
        stores = replayed.filter("NOT hit").groupBy("key").agg(
            F.max("at_us").alias("at_us"), F.max_by("expires_us", "at_us").alias("expires_us")
        )
        state.merge(batch_id, stores)

    return (
        log.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def counters_stream(decisions: DataFrame, ts: str = "ts", window: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Requests per event-time window and source."""
    return (
        decisions.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), "source").agg(F.count("*").alias("n"))
        .select(epoch_us(F.col("w.start")).alias("window_us"), "source", "n")
    )


def rate_stream(
    calls: DataFrame, ts: str = "ts", span: str = "60 seconds", slide: str = "10 seconds", delay: str = WATERMARK
) -> DataFrame:
    """Upstream calls per sliding window, a coarser view of the trailing rate."""
    return (
        calls.withWatermark(ts, delay)
        .groupBy(F.window(ts, span, slide).alias("w")).agg(F.count("*").alias("calls"))
        .select(epoch_us(F.col("w.start")).alias("window_us"), "calls")
    )


def rate_batches(log: DataFrame, path: str, checkpoint: str, seconds: int = 60, max_group_rows: int = 1_000_000) -> StreamingQuery:
    """The exact trailing rate of every request of ``log(row_id, at_us, is_call)``, per micro-batch.

    A batch meets the calls of earlier ones that are still within ``seconds`` of its oldest request, one
    row per microsecond that had any, and is counted as by the batch operator.  Batches must arrive in
    time order: a late call changes no rate that was given before.  Rows land in ``path/rows``, calls in
    ``path/calls``; a retried batch rewrites its own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("row_id", F.col("at_us").cast("long"), F.col("is_call").cast("long").alias("calls"))
        oldest = rows.agg(F.min("at_us")).first()[0]
        made = read_or_empty(batch.sparkSession, f"{path}/calls", "at_us long, calls long, batch long")
        near = made.filter((F.col("batch") < batch_id) & (F.col("at_us") > F.lit(oldest) - seconds * MICROS))
        both = rows.withColumn("_earlier", F.lit(False)).unionByName(
            near.select(F.lit(None).cast("long").alias("row_id"), "at_us", "calls", F.lit(True).alias("_earlier"))
        )
        rated = api_rate(both, F.col("calls"), "at_us", seconds, max_group_rows)
        rated.filter("NOT _earlier").select("row_id", "at_us", "rate").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        calls = rows.filter("calls > 0 AND at_us IS NOT NULL").groupBy("at_us").agg(F.sum("calls").alias("calls"))
        calls.write.mode("overwrite").parquet(f"{path}/calls/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to Parquet and stop once the available input is processed."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )


def run_update(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every batch's changed aggregates, one folder per batch.

    A retried batch rewrites its own folder; :func:`latest_updates` reads the
    newest value per key, windows still open included.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return (
        spark.read.parquet(path).withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1").drop("_rn", "batch")
    )


def cascade_stream(source: DataFrame, cache: AnswerCache, checkpoint: str) -> StreamingQuery:
    """Put every micro-batch to the cache: what batch *n* stores, batch *n+1* can serve."""

    def step(batch: DataFrame, batch_id: int) -> None:
        cache.ask(batch, batch_id)

    return (
        source.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
