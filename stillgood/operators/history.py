"""Conversation context: turn pairs and the turns before a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bin_of, largest_group


def with_halo(
    df: DataFrame, part: str, order: str, width: int, before: int, source: Column | None = None
) -> DataFrame:
    """Cut long groups into slices that carry the rows they need from earlier ones.

    Adds ``slice`` and ``halo``.  A window over (part, slice) that looks back at
    the last ``before`` rows satisfying ``source`` then sees what a window over
    the whole group would: each slice receives the last such rows of the nearest
    ``before`` earlier slices that hold any, and one row each is enough.
    """
    sliced = df.withColumn("slice", bin_of(F.col(order).cast("long"), width)).withColumn(
        "_src", F.lit(True) if source is None else F.coalesce(source, F.lit(False))
    )
    along = Window.partitionBy(part).orderBy("slice")
    slices = (
        sliced.groupBy(part, "slice").agg(F.max(F.col("_src").cast("int")).alias("_has"))
        .withColumn("_nth", F.sum("_has").over(along))
    )
    wanted = slices.select(
        part,
        F.col("slice").alias("_to"),
        F.explode(
            F.sequence(F.col("_nth") - F.col("_has") - before + 1, F.col("_nth") - F.col("_has"))
        ).alias("_nth"),
    ).filter(F.col("_nth") > 0)
    routes = slices.filter(F.col("_has") == 1).select(part, "_nth", "slice").join(
        wanted, [part, "_nth"]
    )
    newest = Window.partitionBy(part, "slice").orderBy(F.desc(order))
    tails = (
        sliced.filter("_src").withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= before).drop("_rn")
    )
    copies = (
        tails.join(routes.select(part, "slice", "_to"), [part, "slice"])
        .withColumn("slice", F.col("_to")).drop("_to").withColumn("halo", F.lit(True))
    )
    return sliced.withColumn("halo", F.lit(False)).unionByName(copies).drop("_src")


def _mark_pairs(turns, conv, turn, role, text, width) -> tuple[DataFrame, list[str]]:
    """Adds ``pair`` to each assistant row that answers the user row before it.

    Whole conversations form the window groups while ``width`` is None; longer
    ones are sliced by turn.
    """
    rows, keys = turns.withColumn("halo", F.lit(False)), [conv]
    if width is not None:
        rows, keys = with_halo(turns, conv, turn, width, 1), [conv, "slice"]
    w = Window.partitionBy(*keys).orderBy(turn)
    answered = (F.col(role) == "assistant") & (F.lag(role).over(w) == "user")
    pair = F.struct(
        F.lag(turn).over(w).alias("turn"),
        F.lag(text).over(w).alias("query"),
        F.col(text).alias("response"),
    )
    marked = rows.withColumn("pair", F.when(answered, pair)).filter(~F.col("halo"))
    return marked.drop("slice"), [conv]


def _width(turns: DataFrame, conv: str, max_group_rows: int) -> int | None:
    return None if largest_group(turns, conv) <= max_group_rows else max_group_rows


def turn_pairs(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    max_group_rows: int = 1_000_000,
) -> DataFrame:
    """User turns followed directly by an assistant turn, as (query, response)."""
    width = _width(turns, conv, max_group_rows)
    marked, _ = _mark_pairs(turns, conv, turn, role, text, width)
    return marked.filter(F.col("pair").isNotNull()).select(
        conv, F.col("pair.turn").alias(turn), "pair.query", "pair.response"
    )


def requests_with_history(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    max_turns: int = 3,
    max_group_rows: int = 1_000_000,
) -> DataFrame:
    """Each user turn with the last ``max_turns`` completed pairs before it."""
    width = _width(turns, conv, max_group_rows)
    rows, keys = _mark_pairs(turns, conv, turn, role, text, width)
    if width is None:
        rows = rows.withColumn("halo", F.lit(False))
    else:
        rows = with_halo(rows.drop("halo"), conv, turn, width, max_turns, F.col("pair").isNotNull())
        keys = [conv, "slice"]
    # Number rows by pairs completed so far: a range over that number reaches
    # the last pairs however many unpaired rows lie between them.
    so_far = F.count("pair").over(Window.partitionBy(*keys).orderBy(turn))
    reach = Window.partitionBy(*keys).orderBy("_pairs").rangeBetween(-(max_turns - 1), 0)
    message = F.when(
        F.col("pair").isNotNull(), F.struct(F.col("pair.query"), F.col("pair.response"))
    )
    return (
        rows.withColumn("_pairs", so_far)
        .withColumn("history", F.collect_list(message).over(reach))
        .filter((F.col(role) == "user") & ~F.col("halo"))
        .select(conv, turn, F.col(text).alias("query"), "history")
    )


def last_context(history: Column) -> Column:
    """The only turn the rewriter looks at."""
    return F.try_element_at(history, F.lit(-1))
