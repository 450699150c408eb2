"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, broadcast_if_small

#: Hex digits of the sampling hash that one round of the search for a source's cut looks at.
DIGITS = 2


def text_size(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def _key(source: str) -> Column:
    """Never null, so that documents without a source join as one source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _hash(doc_id: str, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 16)


def water_fill(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """Targets of ``sizes(key, source, source_size)``, one row per source.

    Sources whose share by weight passes ``max_epochs`` times their size stay at that; the rest is
    shared by weight among the others until none is above. In the order of cap / weight the clamped
    sources come first, so running sums give the level of every such split and the first feasible
    one is the answer. Windows without a partition: the frame has one row per source.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    order = W.orderBy("ratio", "key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * float(share) - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"])
        .select("key", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))
    )


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``whole`` repetitions and the ``cut``: documents whose hash is at most the cut come once more.

    The cut is searched by digits of the hash: sums per source and leading digits find the slice in
    which the running size passes the target, twice, so only 1/65536 of a source is ever ordered.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = written(
        targets.withColumn("whole", whole)
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit("")), "mix"
    )
    for depth in (1, 2):
        slices = (
            sized.join(broadcast_if_small(state.where("left > 0")), "key").where(F.col("h").startswith(F.col("prefix")))
            .groupBy("key", F.substring("h", 1, DIGITS * depth).alias("slice"), "left").agg(F.sum("size").alias("size"))
        )
        before = F.sum("size").over(W.partitionBy("key").orderBy("slice")) - F.col("size")
        passed = (
            slices.withColumn("before", before).where(F.col("before") < F.col("left"))
            .groupBy("key").agg(F.max("slice").alias("slice"), F.max("before").alias("before"))
        )
        state = written(
            state.join(passed, "key", "left")
            .select("key", "source_size", "target", "whole", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"),
                    F.coalesce("slice", "prefix").alias("prefix")), "mix"
        )
    last = (
        sized.join(broadcast_if_small(state.where("left > 0")), "key").where(F.col("h").startswith(F.col("prefix")))
        .groupBy("key", "h", "left").agg(F.sum("size").alias("size"))
    )
    middle = F.sum("size").over(W.partitionBy("key").orderBy("h")) - F.col("size") / 2
    taken = last.withColumn("middle", middle).where(F.col("middle") <= F.col("left")).groupBy("key").agg(F.max("h").alias("cut"))
    return written(
        state.join(taken, "key", "left")
        .select("key", "source_size", "target", "whole", F.coalesce("cut", F.when(F.col("left") > 0, F.col("prefix")), F.lit("")).alias("cut")),
        "mix",
    )


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), _key(source).alias("key"), F.col(source).alias("source"),
                       _hash(doc_id, seed).alias("h"), text_size(F.col(text)).alias("size"))


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, weights, max_epochs, share, seed) -> tuple[DataFrame, DataFrame]:
    sized = written(_sized(docs, doc_id, text, source, seed), "sizes")
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    return sized, _cuts(sized, water_fill(sizes, weights, max_epochs, share))


def _copies() -> Column:
    return (F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")).alias("copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``: how often the mix takes each document.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share`` of all sizes.
    Every document comes ``floor(target / source_size)`` times, and once more if its seeded hash is
    below the cut of its source, which brings the taken size as near the target as whole documents
    allow. Null texts have size 0, rows with equal ids share a hash and are taken together, a source
    without words has target 0, an empty table gives no rows, other columns are not looked at.
    """
    sized, cuts = _plan(docs, doc_id, text, source, weights, max_epochs, share, seed)
    return (
        sized.join(broadcast_if_small(cuts), "key").withColumn("copies", _copies())
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0,
                    seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as ``mix`` takes it."""
    _, cuts = _plan(docs, doc_id, text, source, weights, max_epochs, share, seed)
    rows = docs.select(F.struct("*").alias("row"), _key(source).alias("key"), _hash(doc_id, seed).alias("h"))
    return (
        rows.join(broadcast_if_small(cuts), "key").select("row", _copies()).where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
    )
