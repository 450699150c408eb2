"""Maintenance of the answer table: upsert, eviction, refresh, keyed storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scores import expires_us
from ..session import written
from .ranking import order_hex, rank_cuts, smallest, topk

#: Above every sort key.
ALL_GONE = "~"

ENTRY_SCHEMA = (
    "entry_key string, query string, answer string, category string, "
    "cached_us long, expires_us long, embedding array<float>"
)


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert entries, replacing those with the same key.

    ``cache`` holds one row per key, so only the entries are deduplicated (newest
    wins) and a table much larger than the batch need not be shuffled.
    """
    fresh = newest_entries(entries)
    kept = remove_entries(cache, fresh)
    return kept.unionByName(fresh, allowMissingColumns=True)


def newest_entries(entries: DataFrame) -> DataFrame:
    """One row per key, the newest."""
    return topk(entries, ["entry_key"], [F.desc_nulls_last("cached_us")], 1).drop("rank")


def eviction_order() -> Column:
    """Oldest first; an entry without a time counts as oldest; equal times by key."""
    return F.concat(order_hex(F.coalesce(F.col("cached_us"), F.lit(0))), F.col("entry_key"))


def eviction_size(n: int, max_entries: int) -> int:
    return max(1, n // 10) if n >= max_entries else 0


def _oldest(cache: DataFrame, max_entries: int) -> Column | None:
    n = cache.count()
    return smallest(cache, eviction_order(), eviction_size(n, max_entries), n)


def evicted(cache: DataFrame, max_entries: int = 1000) -> DataFrame:
    """The oldest tenth of a full table, as found before an insert."""
    oldest = _oldest(cache, max_entries)
    return clear(cache) if oldest is None else cache.filter(oldest)


def remove_entries(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("entry_key"), "entry_key", "left_anti")


def evict(cache: DataFrame, max_entries: int = 1000) -> DataFrame:
    """The table without its oldest tenth, once it holds ``max_entries``.

    Finding the cut scans two columns of the table a few times, so pass a stored
    table rather than a long computation.
    """
    oldest = _oldest(cache, max_entries)
    return cache if oldest is None else cache.filter(~oldest)


@dataclass
class _Filling:
    """A table that is filled insert by insert: what the next step starts from.

    Positions are sort keys; ``gone`` is that of the newest old entry evicted, ``done`` that of the
    newest insert made, "" where there is none.
    """

    size: int
    left: int
    gone: str = ""
    done: str = ""
    evicted_inserts: int = 0


class _Frames:
    """Old entries ``(s, by)`` and inserts ``(s, was)``: sort keys, and that of the other row of the key."""

    def __init__(self, old: DataFrame, inserts: DataFrame):
        self.old, self.inserts = old, inserts

    def _nth(self, rows: DataFrame, n: int) -> str | None:
        total = rows.count()
        return None if n > total else rank_cuts(rows, F.lit(0), F.col("s"), {0: [n]}, total)[0].key

    def nth_new(self, at: _Filling, n: int) -> str | None:
        """The ``n``-th insert still to make whose key the table does not hold."""
        new = F.col("was").isNull() | (F.col("was") <= at.gone)
        return self._nth(self.inserts.filter((F.col("s") > at.done) & new), n)

    def next_insert(self, at: _Filling) -> tuple[str, bool]:
        row = self.inserts.filter(F.col("s") > at.done).orderBy("s").first()
        return row["s"], row["was"] is None or row["was"] <= at.gone

    def inserts_left(self, at: _Filling) -> int:
        return self.inserts.filter(F.col("s") > at.done).count()

    def _alive(self, at: _Filling) -> DataFrame:
        return self.old.filter((F.col("s") > at.gone) & (F.col("by").isNull() | (F.col("by") > at.done)))

    def alive(self, at: _Filling) -> int:
        return self._alive(at).count()

    def nth_alive(self, at: _Filling, n: int) -> str:
        return self._nth(self._alive(at), n)


class _Lists(_Frames):
    """The same for a table and as many inserts as old entries can outlast, held in memory."""

    def __init__(self, old: list[tuple], inserts: list[tuple], total: int):
        self.old, self.inserts, self.total = sorted(old), sorted(inserts, key=lambda x: x[0]), total
        self.at = {s: i for i, (s, _) in enumerate(self.inserts)}

    def _todo(self, at: _Filling) -> list[tuple]:
        return self.inserts[self.at[at.done] + 1 if at.done else 0 :]

    def nth_new(self, at: _Filling, n: int) -> str | None:
        new = [s for s, was in self._todo(at) if was is None or was <= at.gone]
        if n > len(new) and len(self.inserts) < self.total:
            raise RuntimeError("more inserts are needed than were taken")
        return new[n - 1] if n <= len(new) else None

    def next_insert(self, at: _Filling) -> tuple[str, bool]:
        s, was = self._todo(at)[0]
        return s, was is None or was <= at.gone

    def inserts_left(self, at: _Filling) -> int:
        return self.total - (self.at[at.done] + 1 if at.done else 0)

    def alive(self, at: _Filling) -> int:
        return len(self._live(at))

    def _live(self, at: _Filling) -> list[str]:
        return [s for s, by in self.old if s > at.gone and (by is None or by > at.done)]

    def nth_alive(self, at: _Filling, n: int) -> str:
        return self._live(at)[n - 1]


def _filled(rows: _Frames, size: int, inserts: int, max_entries: int) -> _Filling:
    """Apply the rule of one insert to all of them, without going through them one by one.

    A full table loses its oldest tenth before an insert, also before one that replaces. Inserts are
    newer than old entries, so old ones go first, and what is gone is always all below a position:
    each eviction is a rank among the old entries alive, each wait for the next one a rank among the
    inserts that are new. Once no old entry is left every insert is new, and the rest is arithmetic.
    """
    at = _Filling(size, inserts)
    while at.left:
        if at.size >= max_entries:
            drop, alive = eviction_size(at.size, max_entries), rows.alive(at)
            at.size -= drop
            if drop >= alive:
                at.evicted_inserts = drop - alive
                return _refilled(at, max_entries)
            at.gone = rows.nth_alive(at, drop)
            at.done, new = rows.next_insert(at)
            at.size, at.left = at.size + new, at.left - 1
        else:
            full = rows.nth_new(at, max_entries - at.size)
            if full is None:
                return at
            at.size, at.done = max_entries, full
            at.left = rows.inserts_left(at)
    return at


def _refilled(at: _Filling, max_entries: int) -> _Filling:
    """The rest of the inserts, when an eviction for the next one has taken all old entries."""
    at.gone, at.size, at.left = ALL_GONE, at.size + 1, at.left - 1
    while at.left:
        drop = eviction_size(at.size, max_entries)
        if not drop:
            made = min(at.left, max_entries - at.size)
            at.size += made
        elif at.size == max_entries or drop == 1:
            # what an eviction takes, as many inserts bring back before the next one
            made, out = at.left, -(-at.left // drop) * drop
            at.evicted_inserts, at.size = at.evicted_inserts + out, at.size - out + made
        else:
            made, at.evicted_inserts, at.size = 1, at.evicted_inserts + drop, at.size - drop + 1
        at.left -= made
    return at


def insert_changes(
    cache: DataFrame, entries: DataFrame, max_entries: int = 1000, held_rows: int = 100_000
) -> tuple[DataFrame, Column, Column]:
    """What inserting ``entries`` one by one, oldest first, with eviction before each, does to a table.

    Returns the entries, newest of each key; which of them stay; and which of the old rows that no entry
    replaces stay. Entries count as newer than all the table holds, as they are when they are made,
    whatever their times say; equal times go by key. ``cache`` holds one row per key and is read several
    times when it gets full: pass a stored one. Which rows stay is found by ranks: of lists while table,
    cap and what they need of the batch are below ``held_rows``, of histograms in Spark beyond it.
    """
    if max_entries < 1:
        raise ValueError("max_entries must be at least 1")
    fresh = written(newest_entries(entries), "fresh")
    size, inserts, every = cache.count(), fresh.count(), F.lit(True)
    if not inserts or (size + inserts <= max_entries and size < max_entries):
        return fresh, every, every
    order = eviction_order()
    old, new = cache.select("entry_key", order.alias("s")), fresh.select("entry_key", order.alias("s"))
    both = written(
        old.withColumnRenamed("s", "was").join(new, "entry_key", "full").select("entry_key", "was", "s"), "order"
    )
    news, olds = both.filter("s IS NOT NULL").select("s", "was"), both.filter("was IS NOT NULL").select(F.col("was").alias("s"), F.col("s").alias("by"))
    # old entries are gone after at most one fill, one replacement of each and a dozen evictions
    needed = size + 3 * max_entries + 500
    if size + min(inserts, needed) <= held_rows:
        first = news.orderBy("s").limit(needed).collect()
        rows = _Lists([tuple(r) for r in olds.collect()], [tuple(r) for r in first], inserts)
    else:
        rows = _Frames(olds, news)
    at = _filled(rows, size, inserts, max_entries)
    stays = F.lit(False) if at.gone == ALL_GONE else order > at.gone
    last = smallest(fresh, order, at.evicted_inserts, inserts)
    return fresh, every if last is None else ~last, stays


def insert_all(cache: DataFrame, entries: DataFrame, max_entries: int = 1000, held_rows: int = 100_000) -> DataFrame:
    """The table after its entries were inserted as by :func:`insert_changes`."""
    fresh, made, stays = insert_changes(cache, entries, max_entries, held_rows)
    return remove_entries(cache.filter(stays), fresh).unionByName(fresh.filter(made), allowMissingColumns=True)


def clear(cache: DataFrame) -> DataFrame:
    """Empty table of the same schema, to overwrite either tier with."""
    return cache.filter(F.lit(False))


def refresh_entries(hits: DataFrame, lifetimes=C.LIVE_LIFETIMES) -> DataFrame:
    """Exact-tier rows written by semantic hits.

    The served answer is stored under the *asking* query's key, with the
    lifetime of the *cached* entry's category.  Exact hits refresh nothing.
    ``hits(source, query_key, query, answer, cached_category, at_us)``.
    """
    return hits.filter(F.col("source").isin(C.CACHE_HIT_FAST, C.CACHE_HIT_VERIFIED)).select(
        F.col("query_key").alias("entry_key"),
        "query",
        "answer",
        F.col("cached_category").alias("category"),
        F.col("at_us").alias("cached_us"),
        expires_us(F.col("at_us"), F.col("cached_category"), lifetimes).alias("expires_us"),
    )


def table_sizes(semantic: DataFrame, exact: DataFrame) -> DataFrame:
    """Entry counts of both tiers as one row."""
    tiers = semantic.select(F.lit("semantic").alias("tier")).unionAll(
        exact.select(F.lit("exact").alias("tier"))
    )
    return tiers.agg(
        F.count_if(F.col("tier") == "semantic").alias("semantic_entries"),
        F.count_if(F.col("tier") == "exact").alias("exact_entries"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows while nothing was written to its path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class KeyedTable:
    """One row per key in Parquet folders by hash bucket: a batch rewrites only the buckets it touches.

    A row names the batch that ``added`` it and the one that ``removed`` it, so the table can be read as
    it stood before the newest batch, and a batch that runs again first takes back what it wrote. Rows
    removed by earlier batches go when their bucket is next written. Writers take turns. Buckets are
    swapped one after the other by Spark's dynamic overwrite: a frame read before a merge must not be
    used after it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = ENTRY_SCHEMA, key: str = "entry_key", buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.fields = spark.createDataFrame([], schema).schema.fields

    def _rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, f"{self.schema}, _added long, _removed long, _of int, _bucket int")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _conformed(self, df: DataFrame) -> DataFrame:
        """The table's own columns, order and types; columns that ``df`` lacks are NULL."""
        return df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.fields]
        )

    def read(self) -> DataFrame:
        """The table after the newest batch; empty before the first."""
        return self._rows().filter("_removed IS NULL").select(*[f.name for f in self.fields])

    def before(self, batch: int) -> DataFrame:
        """The table as ``batch`` found it, be it the newest one or the next."""
        seen = (F.col("_added") < batch) & (F.col("_removed").isNull() | (F.col("_removed") >= batch))
        return self._rows().filter(seen).select(*[f.name for f in self.fields])

    def merge(
        self, batch: int, entries: DataFrame | None = None, removed: DataFrame | None = None, stale: Column | None = None
    ) -> None:
        """Put ``entries`` in (one row per key, in place of the old one) and take the keys of ``removed`` out.

        An entry wins over a removal of its key. Old rows that are ``stale`` go from the buckets that are
        written anyway. The table grows by no shuffle: only buckets with a change are read and written.
        """
        if entries is None:
            entries = self.spark.createDataFrame([], self.schema)
        new = self._conformed(entries).withColumns({"_is_new": F.lit(True), "_bucket": self._bucket()})
        if removed is not None:
            gone = removed.select(self.key).distinct().join(entries.select(self.key), self.key, "left_anti")
            new = new.unionByName(gone.withColumns({"_is_new": F.lit(False), "_bucket": self._bucket()}), allowMissingColumns=True)
        new, rows = written(new, "changes"), self._rows()
        if not rows.filter(F.col("_of") != self.buckets).isEmpty():
            raise ValueError(f"{self.path} does not have {self.buckets} buckets")
        undone = rows.filter((F.col("_added") >= batch) | (F.col("_removed") >= batch))
        # at most one row per bucket
        touched = [r[0] for r in new.select("_bucket").union(undone.select("_bucket")).distinct().collect()]
        if not touched:
            return
        old = rows.filter(F.col("_bucket").isin(touched) & (F.col("_removed").isNull() | (F.col("_removed") >= batch)))
        old = old.join(new.select(self.key, F.lit(True).alias("_changed")), self.key, "left")
        leaves = F.col("_changed").isNotNull() | (F.lit(False) if stale is None else F.coalesce(stale, F.lit(False)))
        # what a first attempt added stays as a row nobody sees, so that no bucket is left without a file
        old = old.withColumn("_removed", F.when(F.col("_added") >= batch, F.col("_added")).when(leaves, F.lit(batch)).cast("long"))
        added = new.filter("_is_new").withColumns(
            {"_added": F.lit(batch).cast("long"), "_removed": F.lit(None).cast("long"), "_of": F.lit(self.buckets)}
        )
        columns = [f.name for f in self.fields] + ["_added", "_removed", "_of", "_bucket"]
        staged = written(old.select(*columns).unionByName(added.select(*columns)), "buckets")
        (
            staged.hint("rebalance", F.col("_bucket")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        )

    def clear(self) -> None:
        """Start over, for a batch that runs again too."""
        schema = self._rows().schema
        (
            self.spark.createDataFrame([], schema).write.mode("overwrite")
            .option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(self.path)
        )
