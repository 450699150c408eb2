"""A stored pair of tiers that whole request tables are put to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.plugins import Plugins
from ..operators import metrics
from ..operators.admission import admitted_entries, judge_answers
from ..operators.memo import ScoreTable
from ..operators.store import KeyedTable, insert_changes, newest_entries, refresh_entries, table_sizes, upsert
from .cascade import decide, misses, with_vectors


class AnswerCache:
    """Both tiers, kept model scores, the decision log and the admission log below one shared path.

    A batch decides against the tables as they stood before it; what it stores
    is visible to the next.  Logs name the vector of a request; a batch keeps each once, beside them.  Everything a batch writes is keyed by its number,
    so running the newest batch again replaces its own output and nothing else.
    Keyed entries leave once no request as old as the oldest of a batch can meet
    them, when their bucket is written next.  ``buckets`` holds for the life of a path.
    """

    #: Kept scores: type and how many, oldest out first.
    SCORES = {
        "classifier": ("struct<label: string, confidence: double>", 1024),
        "embedder": ("array<float>", 1024),
        "reranker": ("double", 1024),
        "contradiction": ("double", 512),
    }

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        config: C.CacheConfig = C.CacheConfig(),
        plugins: Plugins = Plugins(),
        score_candidates: Callable[[DataFrame], DataFrame] | None = None,
        phrases: Sequence[str] = C.UNCACHEABLE_PHRASES,
        buckets: int = 16,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.config, self.plugins = config, plugins
        self.score_candidates, self.phrases = score_candidates, phrases
        self.semantic = KeyedTable(spark, f"{self.path}/semantic", buckets=buckets)
        self.exact = KeyedTable(spark, f"{self.path}/exact", buckets=buckets)
        self.scores = {
            name: ScoreTable(spark, f"{self.path}/scores/{name}", kind, size, buckets)
            for name, (kind, size) in self.SCORES.items() if getattr(plugins, name) is not None
        }

    def _stored(self, df: DataFrame, log: str, batch: int) -> DataFrame:
        target = f"{self.path}/{log}/batch={batch}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    def next_batch(self) -> int:
        last = self._decided().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def ask(self, requests: DataFrame, batch: int | None = None) -> DataFrame:
        """Decide a table of requests, store admitted answers, return the decisions."""
        batch = self.next_batch() if batch is None else batch
        semantic, exact = self.semantic.before(batch), self.exact.before(batch)
        decided, vectors = decide(
            requests, exact, semantic, self.config, self.plugins, self.score_candidates,
            earlier_calls=self.calls_before(batch),
            kept_scores={name: partial(table.score, batch=batch) for name, table in self.scores.items()},
        )
        decided, vectors = self._stored(decided, "decisions", batch), self._stored(vectors, "vectors", batch)
        oldest = decided.agg(F.min("at_us")).first()[0] or 0
        keyed = newest_entries(refresh_entries(decided))
        if self.plugins.judge is not None:
            judged = self._stored(
                judge_answers(
                    misses(decided), self.plugins.judge, self.config.admission_threshold, self.phrases
                ),
                "admissions", batch,
            )
            entries = with_vectors(admitted_entries(judged), vectors)
            fresh, made, stays = insert_changes(semantic, entries, self.config.max_entries)
            lost = semantic.filter(~stays).select("entry_key").union(fresh.filter(~made).select("entry_key"))
            self.semantic.merge(batch, fresh.filter(made), lost)
            keyed = upsert(keyed, fresh)
        self.exact.merge(batch, keyed, stale=F.col("expires_us") <= oldest)
        return with_vectors(decided, vectors)

    def calls_before(self, batch: int) -> DataFrame:
        """When requests of earlier batches went upstream: what the threshold of this one starts from."""
        log = self._log("decisions", "at_us long, source string, batch int").filter(F.col("batch") < batch)
        return log.filter(F.col("source").isin(C.GEMINI_API, C.GEMINI_VOLATILE)).select("at_us")

    def _log(self, name: str, without: str) -> DataFrame:
        """A log, or no rows of the columns ``without`` names before the first batch."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], without)

    def _decided(self) -> DataFrame:
        return self._log("decisions", "req_id long, query string, source string, rewritten boolean, at_us long, batch int")

    def decisions(self) -> DataFrame:
        """Every decision taken so far, with its batch number and its request's vector, which is kept once a batch."""
        decided = self._decided()
        if "vector_id" not in decided.columns:
            return decided
        return with_vectors(decided, self.spark.read.parquet(f"{self.path}/vectors"), ("batch", "vector_id"))

    def admissions(self) -> DataFrame:
        """Every judged answer so far."""
        return self._log("admissions", "query string, admission string, batch int")

    def sizes(self) -> DataFrame:
        return table_sizes(self.semantic.read(), self.exact.read())

    def stats(self) -> DataFrame:
        """Hit rate and saved calls since the first batch."""
        return metrics.live_stats(self._decided())

    def full_stats(self) -> DataFrame:
        """All counters, entries of both tiers and of the kept scores, and both percentages, as one row."""
        events = self._decided().select("source", "rewritten", F.lit(None).cast("string").alias("admission"), F.lit(None).cast("string").alias("held"))
        judged = self.admissions().select("admission")
        tables = {"semantic": self.semantic.read(), "exact": self.exact.read()} | {n: t.entries() for n, t in self.scores.items()}
        events = events.unionByName(judged, allowMissingColumns=True)
        for name, table in tables.items():
            events = events.unionByName(table.select(F.lit(name).alias("held")), allowMissingColumns=True)
        return metrics.full_stats(events, ("semantic", "exact", *self.SCORES))

    def clear(self) -> None:
        """Start both tiers over; the logs and the kept scores stay."""
        self.semantic.clear()
        self.exact.clear()
