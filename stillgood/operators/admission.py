"""Judging fresh answers and storing the ones worth reusing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.plugins import Scorer, only_where
from ..functions.scores import admission, expires_us
from ..functions.text import cache_key, fill_template, parse_score, uncacheable
from ..session import written
from .ranking import topk
from .store import insert_all


def judge_answers(
    misses: DataFrame,
    judge: Scorer,
    threshold: float = 0.5,
    phrases: Sequence[str] = C.UNCACHEABLE_PHRASES,
) -> DataFrame:
    """Adds the admission fields and ``admission`` = admitted / blocked / error.

    ``misses(query, answer, ...)``; ``judge(signal, prompt)`` returns reply text,
    NULL when it failed; an answer for which all signals failed is an error.
    Answers blocked by the phrase filter are never sent to the judge.
    """
    ask = ~uncacheable(F.col("answer"), phrases)
    replies = {
        signal: only_where(
            ask, judge, F.lit(signal),
            fill_template(template, query=F.col("query"), response=F.col("answer")),
        )
        for signal, template in C.JUDGE_TEMPLATES.items()
    }
    replied = misses.withColumns({f"_{signal}_reply": reply for signal, reply in replies.items()})
    scored = replied.withColumns({f"_{signal}": parse_score(F.col(f"_{signal}_reply")) for signal in replies})
    silent = F.coalesce(*[F.col(f"_{signal}_reply") for signal in replies]).isNull()
    verdict = admission(
        F.col("_reusability"), F.col("_confidence"), F.col("_faithfulness"), threshold,
        F.col("answer"), phrases,
    )
    return (
        scored.withColumns({"_v": verdict, "_failed": ask & silent})
        .select(*misses.columns, "_v.*", "_failed")
        .withColumn(
            "admission",
            F.when(F.col("admit_to_cache"), "admitted").when(F.col("_failed"), "error").otherwise("blocked"),
        )
        .drop("_failed")
    )


def admitted_entries(judged: DataFrame, lifetimes=C.LIVE_LIFETIMES) -> DataFrame:
    """Cache entries for admitted answers; repeats of a key keep the latest.

    Entries take ``vector_id`` along where ``judged`` has it in place of ``embedding``.
    """
    kept = judged.filter("admit_to_cache").select(
        cache_key(F.col("query")).alias("entry_key"),
        "query",
        "answer",
        "category",
        F.col("at_us").alias("cached_us"),
        expires_us(F.col("at_us"), F.col("category"), lifetimes).alias("expires_us"),
        F.col("vector_id") if "vector_id" in judged.columns
        else F.col("embedding") if "embedding" in judged.columns
        else F.lit(None).cast("array<float>").alias("embedding"),
    )
    return topk(kept, ["entry_key"], [F.desc("cached_us"), F.desc("query")], 1).drop("rank")


def store_entries(cache: DataFrame, entries: DataFrame, max_entries: int = 1000) -> DataFrame:
    """The table after one batch of admissions, each of them stored for itself."""
    return insert_all(cache, entries, max_entries)


def admit_and_store(
    misses: DataFrame,
    cache: DataFrame,
    judge: Scorer,
    config: C.CacheConfig = C.CacheConfig(),
    phrases: Sequence[str] = C.UNCACHEABLE_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """(judged misses, table after storing the admitted ones).

    The judged rows are written once: storing reads them more than once, and the
    judge must not be asked again.
    """
    judged = written(judge_answers(misses, judge, config.admission_threshold, phrases), "judged")
    return judged, store_entries(cache, admitted_entries(judged), config.max_entries)
