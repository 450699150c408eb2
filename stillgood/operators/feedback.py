"""The acceptance threshold that follows calls which it decides itself.

A request that is not served goes upstream; many calls of late lower the threshold of later requests,
few raise it. So the calls of a batch depend on its own decisions, earlier ones on none but earlier
ones. The timeline is cut into slices. A slice is walked in order, from the calls that reach into it;
all slices are walked at once, and those whose calls turn out to begin otherwise than assumed are
walked again, until none is left: what holds then is what one walk through all requests would give.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import written
from .ranking import bin_of

MICROS = 1_000_000
#: Instants that a slice aims at, and slices whose ends the driver holds (a dozen numbers each).
SLICE_INSTANTS, MAX_SLICES = 200_000, 10_000
WALKED = "slice long, at long, band int, ends array<long>, calls array<long>"


def _bands(config: C.CacheConfig) -> tuple[float, float, float]:
    return config.busy_threshold, config.normal_threshold, config.quiet_threshold


def _walker(starts: dict[int, list[tuple[int, int]]], config: C.CacheConfig):
    """Walk slices, each from the calls ``starts`` names; rows of instants, then one of the last calls.

    No more calls are held than decide the band: those further back change nothing while so many newer
    ones are in reach, and leave it before them.
    """
    width, busy, quiet = config.rate_seconds * MICROS, config.busy_rate, config.quiet_rate
    enough = max(busy, quiet) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, deque(), 0

        def rows(slices, at, band, ends, calls):
            return pa.record_batch({"slice": pa.array(slices, pa.int64()), "at": pa.array(at, pa.int64()), "band": pa.array(band, pa.int32()),
                                    "ends": pa.array(ends, pa.list_(pa.int64())), "calls": pa.array(calls, pa.list_(pa.int64()))})

        def end():
            return rows([now], [None], [None], [[t for t, _ in held]], [[n for _, n in held]])

        for batch in batches:
            bands = np.zeros(batch.num_rows, np.int32)
            columns = (batch.column(c).to_pylist() for c in ("slice", "at", "n0", "n1", "n2"))
            for i, (part, at, *calls) in enumerate(zip(*columns)):
                if part != now:
                    if now is not None:
                        yield end()
                    now, held = part, deque(starts.get(part, ()))
                    total = sum(n for _, n in held)
                while held and at - held[0][0] >= width:
                    total -= held.popleft()[1]
                bands[i] = band = 0 if total > busy else 2 if total < quiet else 1
                if calls[band]:
                    held.append((at, calls[band]))
                    total += calls[band]
                    while total - held[0][1] >= enough:
                        total -= held.popleft()[1]
            if batch.num_rows:
                empty = [None] * batch.num_rows
                yield rows(batch.column("slice"), batch.column("at"), bands, empty, empty)
        if now is not None:
            yield end()

    return run


def _reaching(ends: dict[int, list[tuple[int, int]]], part: int) -> list[tuple[int, int]]:
    # a slice is as wide as the window at least, so no call reaches beyond the next one
    return ends.get(part - 1, [])


def settle_thresholds(
    requests: DataFrame,
    at_us: str,
    goes_upstream: Callable[[Column], Column],
    config: C.CacheConfig = C.CacheConfig(),
    earlier_calls: DataFrame | None = None,
    slice_us: int | None = None,
) -> DataFrame:
    """Adds ``threshold``: what each request is measured by, given the calls before it.

    ``goes_upstream(threshold)`` says whether a request becomes a call at a threshold;
    ``earlier_calls(at_us)`` are calls made before this batch. A call counts for requests strictly later
    and less than ``rate_seconds`` younger; requests of one instant do not see each other. A request
    without a time makes no call that counts and gets the quiet threshold. ``requests`` is read more
    than once: pass a stored frame. However many requests share an instant, they are folded to three
    counts first. At worst, when every slice hands on another ending each time, there are as many
    rounds as slices; a silence as long as the window, or more than enough calls for sure, ends that.
    """
    return with_thresholds(requests, at_us, settled_instants(requests, at_us, goes_upstream, config, earlier_calls, slice_us), config)


def with_thresholds(requests: DataFrame, at_us: str, settled: DataFrame | None, config: C.CacheConfig = C.CacheConfig()) -> DataFrame:
    """Adds ``threshold`` from ``settled(at, threshold)``: the quiet one where no instant settles it."""
    if settled is None:
        return requests.withColumn("threshold", F.lit(config.quiet_threshold))
    decided = settled.select(F.col("at").alias("_at"), "threshold")
    joined = requests.join(decided, F.col(at_us).cast("long") == F.col("_at"), "left").drop("_at")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(config.quiet_threshold)))


def settled_instants(
    requests: DataFrame,
    at_us: str,
    goes_upstream: Callable[[Column], Column],
    config: C.CacheConfig = C.CacheConfig(),
    earlier_calls: DataFrame | None = None,
    slice_us: int | None = None,
) -> DataFrame | None:
    """The instants of :func:`settle_thresholds`, ``(at, threshold)``; None if there are none.

    ``requests`` need no columns but those that ``goes_upstream`` and the time take.
    """
    asked = requests.filter(F.col(at_us).isNotNull())
    counts = [F.count_if(goes_upstream(F.lit(t))).alias(f"n{i}") for i, t in enumerate(_bands(config))]
    instants = asked.groupBy(F.col(at_us).cast("long").alias("at")).agg(*counts)
    window = config.rate_seconds * MICROS
    if earlier_calls is not None:
        first = asked.agg(F.min(at_us).alias("t"), F.max(at_us).alias("u")).first()
        known = earlier_calls.select(F.col("at_us").cast("long").alias("at"), *(F.lit(1).alias(f"n{i}") for i in range(3)))
        known = known.filter(F.col("at").between((first["t"] or 0) - window, first["u"] or 0))
        instants = instants.unionByName(known).groupBy("at").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(3)))
    instants = written(instants, "instants")
    span = instants.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).first()
    thresholds = F.element_at(F.array(*map(F.lit, _bands(config))), F.col("band") + 1)
    if not span["n"]:
        return None
    if slice_us is None:
        parts = max(1, min(MAX_SLICES, -(-span["n"] // SLICE_INSTANTS)))
        slice_us = -(-(span["hi"] - span["lo"] + 1) // parts)
    slice_us = max(slice_us, window, -(-(span["hi"] - span["lo"] + 1) // MAX_SLICES))
    instants = instants.withColumn("slice", bin_of(F.col("at") - span["lo"], slice_us))
    slices = -(-(span["hi"] - span["lo"] + 1) // slice_us)

    used: dict[int, list] = {}  # what each slice was walked from, last time
    ends: dict[int, list] = {}
    walks, newest, todo = [], {}, None
    while todo is None or todo:
        rows = instants if todo is None else instants.filter(F.col("slice").isin(sorted(todo)))
        tasks = min(slices if todo is None else len(todo), 4 * instants.sparkSession.sparkContext.defaultParallelism)
        dealt = rows.repartition(max(1, tasks), "slice").sortWithinPartitions("slice", "at")
        starts = {} if todo is None else {part: _reaching(ends, part) for part in todo}
        walk = written(dealt.select("slice", "at", "n0", "n1", "n2").mapInArrow(_walker(starts, config), WALKED), "walk")
        for r in walk.filter("at IS NULL").collect():
            ends[r["slice"]], newest[r["slice"]], used[r["slice"]] = list(zip(r["ends"], r["calls"])), len(walks), starts.get(r["slice"], [])
        walks.append(walk.filter("at IS NOT NULL"))
        todo = {part for part in ends if _differs(_reaching(ends, part), used[part], part, span["lo"], slice_us, window)}
    settled = None
    for i, walk in enumerate(walks):
        mine = sorted(part for part, n in newest.items() if n == i)
        if mine:
            kept = walk.filter(F.col("slice").isin(mine)) if len(mine) < len(newest) else walk
            settled = kept if settled is None else settled.unionByName(kept)
    return settled.select("at", thresholds.alias("threshold"))


def _differs(now: list, was: list, part: int, low: int, slice_us: int, window: int) -> bool:
    """Whether calls reach into a slice otherwise than assumed; those too old for its first instant do not."""
    reach = low + part * slice_us - window
    return [x for x in now if x[0] > reach] != [x for x in was if x[0] > reach]
