"""Exact-match lookups against a snapshot or a timed write log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bin_of, largest_group

DAY_US = 86_400_000_000


def _valid(answer: Column, expires: Column, at: Column) -> Column:
    """Usable answer: non-empty, and not past its expiry (NULL never expires)."""
    return (
        answer.isNotNull()
        & (F.length(answer) > 0)
        & (expires.isNull() | (at < expires))
    )


def exact_lookup(requests: DataFrame, cache: DataFrame, at_us: str = "at_us") -> DataFrame:
    """Look up ``entry_key`` in a snapshot holding one entry per key.

    Adds ``answer, category, hit``.  The join is many-to-one, so a key asked by
    a third of all requests only skews the request side, which AQE splits.
    """
    side = cache.select(
        "entry_key",
        F.col("answer").alias("_answer"),
        F.col("category").alias("_category"),
        F.col("cached_us").alias("_cached"),
        F.col("expires_us").alias("_expires"),
    )
    joined = requests.join(side, "entry_key", "left")
    hit = F.coalesce(
        (F.col("_cached") <= F.col(at_us))
        & _valid(F.col("_answer"), F.col("_expires"), F.col(at_us)),
        F.lit(False),
    )
    return joined.withColumns(
        {
            "hit": hit,
            "answer": F.when(hit, F.col("_answer")),
            "category": F.when(hit, F.col("_category")),
        }
    ).drop("_answer", "_category", "_cached", "_expires")


def asof_lookup(
    requests: DataFrame,
    writes: DataFrame,
    at_us: str = "at_us",
    max_group_rows: int = 1_000_000,
    slice_us: int = DAY_US,
) -> DataFrame:
    """Look up each request in the newest write of its key made at or before it.

    A later write replaces an earlier one, expired or not, as a keyed store
    does.  Adds ``answer, category, cached_us, hit``.

    Keys that fit a task use one window per key.  Otherwise timelines are cut
    into (key, time slice) groups over distinct instants, and the last write of
    earlier slices is carried in, so a hot key spreads over its slices.
    """
    payload = F.struct("cached_us", "expires_us", "answer", "category")
    writes = writes.filter("entry_key IS NOT NULL")  # a request without a key is a miss
    both_sides = requests.select("entry_key", F.col(at_us).alias("_t")).unionAll(
        writes.select("entry_key", "cached_us")
    )
    if largest_group(both_sides, "entry_key") <= max_group_rows:
        looked_up = _asof_whole(requests, writes.select("entry_key", "cached_us", "seq", payload.alias("_w")), at_us)
    else:
        width = _slice_width(both_sides, slice_us, max_group_rows)
        looked_up = _asof_sliced(requests, writes, payload, at_us, width)
    w = F.col("_w")
    hit = F.coalesce(_valid(w["answer"], w["expires_us"], F.col(at_us)), F.lit(False))
    return looked_up.withColumns(
        {
            "hit": hit,
            "answer": F.when(hit, w["answer"]),
            "category": F.when(hit, w["category"]),
            "cached_us": F.when(hit, w["cached_us"]),
        }
    ).drop("_w")


def _slice_width(timeline: DataFrame, width: int, bound: int) -> int:
    """Slice length whose fullest slice fits a task.

    At ``bound`` microseconds it fits by construction, since a slice holds each
    instant once.
    """
    while width > bound:
        fullest = largest_group(timeline, "entry_key", bin_of(F.col("_t"), width))
        if fullest <= bound:
            break
        width = max(bound, width // (fullest // bound + 1))
    return width


def _asof_whole(requests: DataFrame, writes: DataFrame, at_us: str) -> DataFrame:
    kept = F.struct(*[c for c in requests.columns if c != "entry_key"])
    asked = requests.select(
        "entry_key", F.col(at_us).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_seq"), kept.alias("_r"),
    )
    written = writes.select(
        "entry_key", F.col("cached_us").alias("_t"), F.lit(0).alias("_kind"),
        F.col("seq").cast("long").alias("_seq"), "_w",
    )
    timeline = Window.partitionBy("entry_key").orderBy("_t", "_kind", "_seq")
    return (
        asked.unionByName(written, allowMissingColumns=True)
        .withColumn("_w", F.last("_w", ignorenulls=True).over(timeline.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_kind = 1")
        .select("entry_key", "_r.*", "_w")
    )


def _asof_sliced(
    requests: DataFrame, writes: DataFrame, payload: Column, at_us: str, slice_us: int
) -> DataFrame:
    def sliced(df: DataFrame) -> DataFrame:
        return df.withColumn("_slice", bin_of(F.col("_t"), slice_us))

    instants = sliced(requests.select("entry_key", F.col(at_us).alias("_t")).distinct())
    written = sliced(
        writes.groupBy("entry_key", F.col("cached_us").alias("_t"))
        .agg(F.max_by(payload, F.col("seq")).alias("_w"))
    )
    # newest write time at or before each instant, first within the slice
    timeline = Window.partitionBy("entry_key", "_slice").orderBy("_t", "_kind")
    marks = instants.withColumn("_kind", F.lit(1)).withColumn("_at", F.lit(None).cast("long")).unionByName(
        written.select("entry_key", "_t", "_slice").withColumn("_kind", F.lit(0)).withColumn("_at", F.col("_t"))
    )
    inside = (
        marks.withColumn("_at", F.last("_at", ignorenulls=True).over(timeline.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_kind = 1").drop("_kind")
    )
    # then from the last write of any earlier slice
    ends = written.groupBy("entry_key", "_slice").agg(F.max("_t").alias("_end"))
    asked = instants.select("entry_key", "_slice").distinct().withColumn("_end", F.lit(None).cast("long"))
    across = Window.partitionBy("entry_key").orderBy("_slice")
    carried = (
        ends.unionByName(asked)
        .groupBy("entry_key", "_slice").agg(F.max("_end").alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .select("entry_key", "_slice", "_carry")
    )
    resolved = inside.join(carried, ["entry_key", "_slice"], "left").select(
        "entry_key", "_t", F.coalesce("_at", "_carry").alias("_at")
    )
    answers = resolved.join(
        written.select("entry_key", F.col("_t").alias("_at"), "_w"), ["entry_key", "_at"], "left"
    ).select("entry_key", F.col("_t").alias(at_us), "_w")
    return requests.join(answers, ["entry_key", at_us], "left")
