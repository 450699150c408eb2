"""Score each distinct input once, within a batch and across batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .ranking import order_hex, smallest
from .store import KeyedTable


def input_digest(keys: Sequence[str]) -> Column:
    """128 bits that stand for a key tuple, NULLs included."""
    return F.md5(F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])))


def memo_score(
    df: DataFrame, keys: Sequence[str], scorer: Callable[..., Column], out: str = "score"
) -> DataFrame:
    """Adds ``out`` = ``scorer(*keys)``, computed once per distinct key tuple.

    Repeats collapse in the map-side part of the distinct, so a text that makes
    up a third of the rows costs one model call.  The join back goes by a digest
    of the inputs, NULLs included, so the score side carries no text.
    """
    inputs = df.select(*keys).distinct()
    scored = inputs.select(input_digest(keys).alias("_digest"), scorer(*[F.col(k) for k in keys]).alias(out))
    return df.withColumn("_digest", input_digest(keys)).join(scored, "_digest", "left").drop("_digest")


class ScoreTable:
    """Scores kept from batch to batch, the newest ``capacity`` of them: first in, first out.

    ``kind`` is the type of a score.  Only inputs that the table does not know reach the scorer, each
    distinct one once; of one batch they count as stored in the order of their digests.  A NULL score
    is a failure and is not kept, so its input is tried again in the next batch.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "double", capacity: int = 1024, buckets: int = 16):
        self.table = KeyedTable(spark, path, f"digest string, value {kind}, made long", "digest", buckets)
        self.capacity = capacity

    def score(
        self, df: DataFrame, keys: Sequence[str], scorer: Callable[..., Column], out: str = "score", batch: int = 0
    ) -> DataFrame:
        """Adds ``out`` to the rows of a batch and keeps what was scored; a batch may run again."""
        known = self.table.before(batch)
        inputs = df.select(*keys).distinct().withColumn("digest", input_digest(keys))
        unknown = inputs.join(known.select("digest"), "digest", "left_anti")
        made = unknown.select("digest", scorer(*[F.col(k) for k in keys]).alias("value"), F.lit(batch).alias("made"))
        fresh = written(self.table._conformed(made), "scores")
        used = known.join(inputs.select("digest"), "digest", "left_semi")
        scores = written(used.unionByName(fresh).select(F.col("digest").alias("_digest"), F.col("value").alias(out)), "used")
        self._keep(known, fresh.filter("value IS NOT NULL"), batch)
        return df.withColumn("_digest", input_digest(keys)).join(scores, "_digest", "left").drop("_digest")

    def _keep(self, known: DataFrame, fresh: DataFrame, batch: int) -> None:
        both = known.unionByName(fresh).select("digest", "made")
        n, order = both.count(), F.concat(order_hex(F.col("made")), F.col("digest"))
        oldest = smallest(both, order, n - self.capacity, n)
        if oldest is None:
            self.table.merge(batch, fresh)
        else:
            self.table.merge(batch, fresh.filter(~oldest), known.filter(oldest))

    def entries(self) -> DataFrame:
        return self.table.read()
