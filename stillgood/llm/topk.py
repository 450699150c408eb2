"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into slots of bounded size; a slot keeps one sorted list per dimension. Queries
visit every slot, batch by batch, and stop at the depth where no unseen vector can still enter
their k best of the slot. The best of all slots are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import matrix, runs

#: Vectors of a slot (its lists and matrix stay in a task's memory), and first depth of the lists.
SLOT_ROWS, FIRST_DEPTH = 8_192, 64


def integers(embedding: str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null where a vector is null, empty or has a null or non-finite one."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


class _Slot:
    """Vectors of one slot, sorted by id, with their lists."""

    def __init__(self, ids: list, vectors: np.ndarray):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, vectors = [ids[i] for i in order], vectors[order]
        # sums of products stay exact in doubles below 2**53, else in 64-bit integers
        top = float(np.abs(vectors).max(initial=0))
        self.top, self.vectors = top, vectors.astype(np.float64)
        self.whole = vectors
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)
        self.at = {x: i for i, x in enumerate(self.ids)}

    def search(self, queries: np.ndarray, own: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query its number, rows and scores of its k best here, ties to smaller ids."""
        n, dims = self.vectors.shape
        exact = self.top * float(np.abs(queries).max(initial=0)) * dims < 2**53
        data = self.vectors if exact else self.whole
        queries = queries.astype(data.dtype)
        depths = []
        depth = FIRST_DEPTH
        while depth < n:
            depths.append(depth)
            depth *= 2
        # what a vector can score at most that no list has shown down to each depth
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        low, high = [self.sorted[d] for d in depths], [self.sorted[n - 1 - d] for d in depths]
        bounds = positive @ np.array(low).T + negative @ np.array(high).T if depths else np.zeros((len(queries), 0))
        for i, q in enumerate(queries):
            seen, up, down = np.zeros(n, bool), np.flatnonzero(q > 0), np.flatnonzero(q < 0)
            found, scores = np.zeros(0, np.int64), np.zeros(0, data.dtype)
            mine, start = self.at.get(own[i], -1), 0
            if mine >= 0:
                seen[mine] = True
            for d in [*depths, n]:
                fresh = np.zeros(n, bool)
                if d == n or 2 * d * (len(up) + len(down)) > 8 * n:  # the lists show nearly all: read the rest at random
                    fresh[:] = True
                    d = n
                else:
                    fresh[self.order[start:d, up]] = True
                    fresh[self.order[n - d : n - start, down]] = True
                new = np.flatnonzero(fresh & ~seen)
                seen[new] = True
                found, scores = np.r_[found, new], np.r_[scores, data[new] @ q]
                best = np.lexsort((found, -scores))[:k] if len(found) <= 4 * k else self._best(found, scores, k)
                found, scores, start = found[best], scores[best], d
                # an unseen vector may tie with the bound and have a smaller id: stop only above it
                if d == n or len(found) == k and scores[-1] > bounds[i, depths.index(d)]:
                    break
            yield i, found, scores

    @staticmethod
    def _best(found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((found[near], -scores[near]))][:k]


def top_k(rows: DataFrame, row_id: str, vector: str, is_query: Column, k: int = 5, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row the ``k`` other rows of highest inner product.

    ``vector`` holds longs; every row is a candidate, ties go to smaller ids, fewer than ``k`` rows
    come back where fewer exist. Vectors of another length than the query's are not compared. Rows
    with a null id or vector take no part; of rows with one id the smallest vector counts. Scores are
    exact as long as they fit a long. An empty table gives no rows; other columns are not read.
    """
    clean = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")).where("id IS NOT NULL AND vector IS NOT NULL")
    clean = clean.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    id_type = clean.schema["id"].dataType.simpleString()
    # a number of slots that keeps each below its size, and every task busy on small tables
    count = rows.count()
    slots = max(min(24, count // 500), -(-count // slot_rows), 1)
    homes = clean.select(F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("role"), "id", "vector")
    asks = clean.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("role"), "id", "vector")
    dealt = (
        homes.unionByName(asks).withColumn("key", F.concat_ws("/", F.size("vector"), "slot"))
        .repartition(slots, "key").sortWithinPartitions("key", "role")
    )

    def search(batches):
        key, slot, ids, parts = None, None, [], []
        for now, batch in runs(batches, "key"):
            if now != key:
                key, slot, ids, parts = now, None, [], []
            role = batch.column("role").to_numpy()
            first = int((role == 0).sum())
            if first:
                ids += batch.column("id").slice(0, first).to_pylist()
                parts.append(matrix(batch.column("vector").slice(0, first), "int64"))
            asking = batch.slice(first)
            if not asking.num_rows or not ids:
                continue
            slot = slot or _Slot(ids, np.concatenate(parts))
            own = asking.column("id").to_pylist()
            query, other, score = [], [], []
            for i, found, scores in slot.search(matrix(asking.column("vector"), "int64"), own, k):
                query += [own[i]] * len(found)
                other += [slot.ids[j] for j in found]
                score += [int(s) for s in scores]
            kind = batch.schema.field("id").type
            yield pa.record_batch({"query_id": pa.array(query, kind), "id": pa.array(other, kind), "score": pa.array(score, pa.int64())})

    found = dealt.select("key", "role", "id", "vector").mapInArrow(search, f"query_id {id_type}, id {id_type}, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
