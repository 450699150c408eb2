"""Trailing call rate per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bin_of, largest_group

MICROS = 1_000_000


def _trailing(df: DataFrame, at: str, n: str, reach: int, block: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over rows whose ``at`` is 1 to ``reach`` below a row's own.

    A row counts for what comes after it and is taken off again ``reach + 1`` later, in the block that
    this falls into; a block starts from what still counts when it begins.  So each sum is a running one,
    however many rows lie within reach.  ``block`` is more than ``reach``.
    """
    own, until = bin_of(F.col(at), block), F.col(at) + F.lit(reach + 1)
    enters = F.struct(own.alias("_block"), F.col(at).alias("_at"), F.col(n).alias("_in"), F.lit(0).cast("long").alias("_out"), F.lit(0).cast("long").alias("_held"), F.lit(True).alias("_own"))
    later = bin_of(until, block)
    leaves = F.struct(
        later.alias("_block"), until.alias("_at"), F.lit(0).cast("long").alias("_in"), F.col(n).alias("_out"),
        F.when(later > own, F.col(n)).otherwise(F.lit(0)).alias("_held"), F.lit(False).alias("_own"),
    )
    marks = df.withColumn("_mark", F.explode(F.when(F.col(n) > 0, F.array(enters, leaves)).otherwise(F.array(enters)))).select("*", "_mark.*").drop("_mark")
    along = Window.partitionBy("_block").orderBy("_at")
    start = Window.unboundedPreceding
    held = F.sum("_held").over(along.rowsBetween(start, Window.unboundedFollowing))
    came, left = F.sum("_in").over(along.rangeBetween(start, -1)), F.sum("_out").over(along.rangeBetween(start, 0))
    counted = marks.withColumn(out, held + F.coalesce(came, F.lit(0)) - left)
    return counted.filter("_own").drop("_block", "_at", "_in", "_out", "_held", "_own")


def api_rate(
    requests: DataFrame,
    is_call: Column,
    at_us: str = "at_us",
    seconds: int = 60,
    max_group_rows: int = 1_000_000,
) -> DataFrame:
    """Adds ``rate``: upstream calls strictly before a request and under ``seconds`` old.

    ``is_call`` marks rows that made an upstream call; a request never counts
    itself; a request without a time keeps its row, at rate 0.  When one bin is too crowded for a task, rows are first folded per
    microsecond and counted in slices that no amount of rows can overfill.
    """
    width = seconds * MICROS
    untimed = requests.filter(F.col(at_us).isNull()).withColumn("rate", F.lit(0).cast("long"))
    log = requests.filter(F.col(at_us).isNotNull()).withColumn("_t", F.col(at_us)).withColumn("_calls", is_call.cast("long"))
    if largest_group(log, bin_of(F.col("_t"), width)) <= max_group_rows:
        return _trailing(log, "_t", "_calls", width - 1, width, "rate").drop("_t", "_calls").unionByName(untimed)
    rates = _folded_rates(log.groupBy("_t").agg(F.sum("_calls").alias("n")), width, max_group_rows)
    return log.join(rates, "_t").drop("_t", "_calls").unionByName(untimed)


def _folded_rates(instants: DataFrame, width: int, bound: int) -> DataFrame:
    """Trailing counts per distinct instant, with every window bounded.

    The look-back is a whole number of slices, each at most ``bound``
    microseconds long.  The count at T is what its own slice holds before T,
    plus the slices in between, less what lies at or before the cut T - width.
    """
    parts = next(m for m in range(-(-width // bound), width + 1) if width % m == 0)
    slice_us = width // parts
    marks = instants.select("_t", F.col("_t").alias("at"), "n", F.lit(0).alias("cut")).unionByName(
        instants.select("_t", (F.col("_t") - width).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("cut"))
    )
    marks = marks.withColumn("_slice", bin_of(F.col("at"), slice_us))
    inside = Window.partitionBy("_slice").orderBy("at", "cut").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("n").over(inside)
    edges = (
        marks.withColumn("edge", F.when(F.col("cut") == 0, running - F.col("n")).otherwise(-running))
        .groupBy("_t").agg(F.sum("edge").alias("edge"))
        .withColumn("_slice", bin_of(F.col("_t"), slice_us))
    )
    totals = instants.groupBy(bin_of(F.col("_t"), slice_us).alias("_slice")).agg(F.sum("n").alias("n"))
    between = _trailing(totals, "_slice", "n", parts, parts + 1, "between").select("_slice", "between")
    return edges.join(between, "_slice").select("_t", (F.col("edge") + F.col("between")).alias("rate"))
