"""Nearest-neighbour joins by cosine similarity.

Three physical forms, one result contract ``(req_id, rank, entry_key, similarity)``
with similarity rounded to six decimals and ties broken by entry key:

* ``broadcast``: the entry matrix is proven to fit ``max_broadcast_bytes`` and is
  multiplied against request batches; nothing is shuffled but the top k.
* ``cells``: entries are grouped around pivots, and a request visits a cell only
  if the triangle inequality lets it hold a closer entry than the k found so
  far.  Exact at any size.
* ``probes``: the same cells, but only the ``nprobe`` nearest; approximate.  With ``target_recall``
  the depth is the smallest at which measured requests find that share of their exact neighbours.

Pairs never leave a task: tiles of entries meet tiles of requests in single precision, what may win is
computed in double precision, and only the k best per request come out.  A request is sent once to a
bundle of neighbouring cells, with the list of those it visits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SCALE, list_matrix, unit_rows
from ..session import written
from .ranking import topk

BLOCK = 512            # request rows per matrix product
SLACK = 2.0 / SCALE    # similarity slack that keeps pruning safe under rounding
EMPTY = -(1 << 62)       # marks a position that must not be picked
FEW = 30               # fewer measured requests than this say too little: all are measured


def _key_array(values) -> np.ndarray:
    return np.array(values, dtype=object)


def _places(keys, wanted) -> np.ndarray:
    """Position of each wanted key among the keys, or -1."""
    where = {key: i for i, key in enumerate(keys)}
    return np.array([where.get(s, -1) for s in wanted], dtype=np.int64)


class _Best:
    """Best k entry positions and scaled similarities of some requests, met by one block of entries after another.

    Entries are in key order, so a smaller position wins a tie.  ``skip`` holds one position per request
    to leave out, or -1.  Products are taken in single precision; only what its error leaves a chance to
    be among the k best is computed in double precision and merged.
    """

    def __init__(self, requests: np.ndarray, skip: np.ndarray, k: int, n: int):
        self.requests, self.single, self.skip, self.k, self.n = requests, requests.astype(np.float32), skip, k, n
        self.best = np.full((len(requests), k), EMPTY, dtype=np.int64)
        self.floor = np.full(len(requests), -np.inf, dtype=np.float32)
        # a sum of d products of unit vectors, and rounding to SCALE
        self.error = (requests.shape[1] + 8) * 2.0**-22 + 2.0 / SCALE

    def meet(self, entries: np.ndarray, positions: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Put the entries at ``positions`` to the requests ``asked`` (all by default)."""
        single = entries.astype(np.float32)
        for start in range(0, len(self.best) if asked is None else len(asked), BLOCK):
            rows = np.arange(start, min(start + BLOCK, len(self.best))) if asked is None else asked[start:start + BLOCK]
            similar = self.single[rows] @ single.T
            # NaN has always counted like any number
            odd = np.isnan(similar)
            if odd.any():
                similar[odd] = np.inf
            floor = self.floor[rows]
            new = np.isneginf(floor)
            if new.any() and len(entries) > self.k + 1:
                # one of these may be skipped, so k of them are sure
                kth = np.partition(similar[new], -self.k - 1, axis=1)[:, -self.k - 1]
                floor[new] = np.where(np.isfinite(kth), kth - self.error, -np.inf)
            at, column = np.nonzero(similar >= floor[:, None])
            if len(at):
                self._merge(rows, at, entries[column], positions[column])

    def _merge(self, rows: np.ndarray, at: np.ndarray, entries: np.ndarray, positions: np.ndarray) -> None:
        touched, at = np.unique(at, return_inverse=True)
        rows = rows[touched]
        scaled = np.rint(np.einsum("ij,ij->i", self.requests[rows[at]], entries) * SCALE).astype(np.int64)
        packed = scaled * self.n + (self.n - 1 - positions)
        packed[self.skip[rows[at]] == positions] = EMPTY
        both = np.concatenate([self.best[rows].ravel(), packed])
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        order = np.lexsort((-both, owner))
        first = np.searchsorted(owner[order], np.arange(len(rows)))
        best = both[order][first[:, None] + np.arange(self.k)]
        self.best[rows] = best
        full = best[:, -1] != EMPTY
        self.floor[rows[full]] = np.floor_divide(best[full, -1], self.n) / SCALE - self.error

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, scaled similarities, and which of them there are; best first."""
        scaled = np.floor_divide(self.best, max(self.n, 1))
        return self.n - 1 - (self.best - scaled * self.n), scaled, self.best != EMPTY


def _types(requests: DataFrame, entries: DataFrame) -> tuple[str, str]:
    return (
        requests.schema["req_id"].dataType.simpleString(),
        entries.schema["entry_key"].dataType.simpleString(),
    )


def _emit(schema: pa.Schema, ids, keys, similarity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids.tolist(), schema.field(0).type),
            pa.array(keys.tolist(), schema.field(1).type),
            pa.array(similarity, pa.float64()),
        ],
        schema=schema,
    )


def _runs(sorted_values: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct values, and the others that go with each."""
    values, first = np.unique(sorted_values, return_index=True)
    return values, np.split(others, first[1:])


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _arrow_schema(requests: DataFrame, entries: DataFrame) -> pa.Schema:
    return pa.schema(
        [
            ("req_id", _arrow_type(requests, "req_id")),
            ("entry_key", _arrow_type(entries, "entry_key")),
            ("similarity", pa.float64()),
        ]
    )


def _requests(df: DataFrame) -> DataFrame:
    skip = F.col("skip_key") if "skip_key" in df.columns else F.lit(None)
    return df.filter(F.col("embedding").isNotNull()).select(
        "req_id", "embedding", skip.alias("skip_key")
    )


def _entries(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull()).select("entry_key", "embedding")


def _fits(entries: DataFrame, max_bytes: int) -> pa.Table | None:
    """The entries as one Arrow table if they are proven small, else None."""
    size = entries.select(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")
    ).first()
    if not size["n"]:
        return entries.limit(0).toArrow()
    room = max_bytes // (8 * size["dims"])
    if size["n"] > room:
        return None
    table = entries.limit(room + 1).toArrow()
    return table if table.num_rows <= room else None


def knn_join(
    requests: DataFrame,
    entries: DataFrame,
    k: int = 5,
    method: str = "auto",
    nprobe: int = 4,
    max_broadcast_bytes: int = 64 << 20,
    tile_rows: int = 8192,
    max_pivots: int = 1024,
    target_recall: float | None = None,
    measured: Column | None = None,
) -> DataFrame:
    """Top ``min(k, entries)`` entries per request.

    ``requests(req_id, embedding[, skip_key])``, ``entries(entry_key, embedding)``.
    ``skip_key`` names one entry a request must not be matched with, which makes
    leave-one-out evaluation of a table against itself possible.

    ``target_recall`` with ``method="probes"`` replaces ``nprobe`` by the depth that ``probe_depth``
    finds on the requests for which ``measured`` holds (by default one in a hundred by hash); all
    neighbours (1.0) take the exact search, since a sample cannot promise them.
    """
    req, ent = _requests(requests), _entries(entries)
    # the work of a request has little to do with the bytes it takes in a file
    req = req.repartition(2 * req.sparkSession.sparkContext.defaultParallelism, "req_id")
    if method in ("auto", "broadcast"):
        table = _fits(ent, max_broadcast_bytes)
        if table is not None:
            return _broadcast_join(req, ent, table, k, tile_rows)
        if method == "broadcast":
            raise ValueError("entries exceed max_broadcast_bytes; use method='cells'")
    if method not in ("auto", "cells", "probes"):
        raise ValueError(f"unknown method {method}")
    # Copies of one vector tie, and ties go to the smallest keys: k + 1 of them
    # (one may be skipped) stand for the whole group.
    ent = topk(ent, ["embedding"], [F.col("entry_key")], k + 1).drop("rank")
    cells = _Cells(req, ent, k, tile_rows, max_pivots)
    if method != "probes" or (target_recall or 0) >= 1:
        return cells.exact()
    return cells.nearest(nprobe if target_recall is None else cells.depth(target_recall, measured))


def probe_depth(behind: Mapping[int, int], requests: int, target: float) -> int:
    """Smallest number of cells that holds the share ``target`` of the measured neighbours.

    ``behind`` counts neighbours by how many nearer cells a request visits before theirs.  A share must
    exceed the target by 1.64 standard errors of ``requests`` independent ones, or be whole.
    """
    total, found = sum(behind.values()), 0
    for before in sorted(behind):
        found += behind[before]
        share = found / total
        if found == total or share - 1.64 * sqrt(share * (1 - share) / max(1, requests)) >= target:
            return before + 1
    return 1


def nearest_one(requests: DataFrame, entries: DataFrame, floor: float = 0.75, **options) -> DataFrame:
    """Single nearest entry, kept when its similarity is at least ``floor``."""
    return knn_join(requests, entries, k=1, **options).filter(F.col("similarity") >= floor).drop("rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("similarity"), F.asc("entry_key")]
    return topk(found, ["req_id"], order, k).select("req_id", "rank", "entry_key", "similarity")


def _broadcast_join(req: DataFrame, ent: DataFrame, table: pa.Table, k: int, tile: int) -> DataFrame:
    schema, (req_type, key_type) = _arrow_schema(req, ent), _types(req, ent)
    out = f"req_id {req_type}, rank int, entry_key {key_type}, similarity double"
    ranked = pa.schema([schema.field(0), ("rank", pa.int32()), schema.field(1), schema.field(2)])
    table = table.sort_by("entry_key")
    shared = req.sparkSession.sparkContext.broadcast(
        (
            _key_array(table["entry_key"].to_pylist()),
            unit_rows(list_matrix(table["embedding"])),
        )
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = shared.value
        if not len(keys):
            return
        where = {key: i for i, key in enumerate(keys)}
        for part in batches:
            if not part.num_rows:
                continue
            vectors = unit_rows(list_matrix(part.column("embedding")))
            skip = np.array([where.get(s, -1) for s in part.column("skip_key").to_pylist()], dtype=np.int64)
            best = _Best(vectors, skip, k, len(keys))
            for start in range(0, len(keys), tile):
                block = matrix[start:start + tile]
                best.meet(block, np.arange(start, start + len(block)))
            position, scaled, found = best.found()
            rows, columns = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("req_id").take(pa.array(rows)),
                    pa.array(columns + 1, pa.int32()),
                    pa.array(keys[position[found]].tolist(), schema.field(1).type),
                    pa.array(scaled[found] / SCALE, pa.float64()),
                ],
                schema=ranked,
            )

    return req.mapInArrow(match, out)


class _Cells:
    """Entries grouped around pivots; request and entry tiles bounded on both sides."""

    def __init__(self, req: DataFrame, ent: DataFrame, k: int, tile: int, max_pivots: int):
        self.req, self.ent, self.k, self.tile = req, ent, k, tile
        self.req_type, self.key_type = _types(req, ent)
        self.schema = _arrow_schema(req, ent)
        self.sc = req.sparkSession.sparkContext
        total = ent.count()
        wanted = max(1, min(max_pivots, int(sqrt(total)))) if total else 0
        # A fixed-size, repeatable sample; identical vectors give one pivot.
        sample = (
            ent.orderBy(F.xxhash64("entry_key"), "entry_key").limit(wanted).select("embedding").toArrow()
        )
        self.pivots = self.sc.broadcast(
            np.unique(unit_rows(list_matrix(sample["embedding"])), axis=0) if wanted else np.zeros((0, 0))
        )
        self.assigned = written(self._assign(), "cells")
        self.stats = {
            r["cell"]: (r["n"], r["radius"])
            for r in self.assigned.groupBy("cell")
            .agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
            .collect()
        }
        # neighbouring cells share a bundle: a request is sent once to each bundle, not to each cell
        self.bundles, held = {}, 0
        for i, cell in enumerate(sorted(self.stats)):
            size = self.stats[cell][0]
            if not i or held + size > 4 * tile:
                bundle, held = cell, 0
            self.bundles[cell], held = bundle, held + size

    def _assign(self) -> DataFrame:
        pivots = self.pivots
        schema = pa.schema(
            [
                self.schema.field(1), ("embedding", pa.list_(pa.float64())),
                ("cell", pa.int32()), ("angle", pa.float64()),
            ]
        )

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = unit_rows(list_matrix(batch.column("embedding")))
                similarity = vectors @ pivots.value.T
                cell = similarity.argmax(axis=1)
                angle = np.arccos(np.clip(similarity.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("entry_key"), _lists(vectors), pa.array(cell, pa.int32()), pa.array(angle)],
                    schema=schema,
                )

        out = f"entry_key {self.key_type}, embedding array<double>, cell int, angle double"
        return self.ent.mapInArrow(assign, out)

    def _probe(self, req: DataFrame, choose) -> DataFrame:
        """One row per request and bundle of visited cells; ``choose`` returns a mask matrix."""
        pivots, stats, bundles = self.pivots, self.stats, self.bundles
        kept = req.schema["embedding"].dataType.simpleString()
        schema = pa.schema(
            [
                self.schema.field(0), ("embedding", _arrow_type(req, "embedding")),
                ("skip_key", self.schema.field(1).type), ("bundle", pa.int32()), ("cells", pa.list_(pa.int32())),
            ]
        )

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.array(sorted(stats), dtype=np.int64)
            of = np.array([bundles[c] for c in cells], dtype=np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    vectors = unit_rows(list_matrix(part.column("embedding")))
                    angle = np.arccos(np.clip(vectors @ pivots.value[cells].T, -1, 1))
                    rows, columns = np.nonzero(choose(part, cells, angle))
                    first = np.nonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(of[columns], prepend=-1) != 0))[0]
                    picked = pa.array(rows[first])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("req_id").take(picked),
                            part.column("embedding").take(picked).cast(schema.field(1).type),
                            part.column("skip_key").cast(schema.field(2).type).take(picked),
                            pa.array(of[columns[first]], pa.int32()),
                            pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), pa.array(cells[columns], pa.int32())),
                        ],
                        schema=schema,
                    )

        out = f"req_id {self.req_type}, embedding {kept}, skip_key {self.key_type}, bundle int, cells array<int>"
        return req.mapInArrow(probe, out)

    def _home(self, nprobe: int):
        """Nearest cells: at least ``nprobe`` and enough to hold k entries."""
        stats, need = self.stats, self.k + 1

        def choose(part, cells, angle):
            order = np.argsort(angle, axis=1, kind="stable")
            sizes = np.array([stats[c][0] for c in cells])[order]
            before = np.cumsum(sizes, axis=1) - sizes
            ahead = (before < need) | (np.arange(len(cells)) < nprobe)
            mask = np.zeros(angle.shape, dtype=bool)
            np.put_along_axis(mask, order, ahead, axis=1)
            return mask

        return choose

    def _match(self, probes: DataFrame) -> DataFrame:
        """Tile the probed bundles on both sides and keep the k best per request and tile."""
        spark = self.req.sparkSession
        sizes: dict[int, int] = {}
        for cell, bundle in self.bundles.items():
            sizes[bundle] = sizes.get(bundle, 0) + self.stats[cell][0]
        asked = {r["bundle"]: r["count"] for r in probes.groupBy("bundle").count().collect()}
        plan = [(b, ceil(sizes[b] / (4 * self.tile)), ceil(n / (2 * self.tile))) for b, n in asked.items()]
        plan_df = F.broadcast(
            spark.createDataFrame(plan, "bundle int, entry_tiles int, request_tiles int")
        )
        of = F.broadcast(spark.createDataFrame(sorted(self.bundles.items()), "cell int, bundle int"))

        def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
            sized = df.join(plan_df, "bundle")
            mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
            return (
                sized.withColumn(own[:-1], mine)
                .withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop(own, other)
            )

        left = spread(probes, "req_id", "request_tiles", "entry_tiles")
        right = spread(
            self.assigned.select("entry_key", "embedding", "cell").join(of, "cell"),
            "entry_key", "entry_tiles", "request_tiles",
        )
        k, schema = self.k, self.schema

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return pa.Table.from_batches([], schema)
            held = held.sort_by("entry_key")
            keys, matrix = _key_array(held["entry_key"].to_pylist()), list_matrix(held["embedding"])
            cell = held["cell"].to_numpy()
            best = _Best(unit_rows(list_matrix(asked["embedding"])), _places(keys, asked["skip_key"].to_pylist()), k, len(keys))
            visits = asked["cells"].combine_chunks()
            visitors = np.repeat(np.arange(asked.num_rows), visits.value_lengths().to_numpy(zero_copy_only=False))
            visited = visits.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(visited, kind="stable")
            for c, mine in zip(*_runs(visited[order], visitors[order])):
                positions = np.nonzero(cell == c)[0]
                if len(positions):
                    best.meet(matrix[positions], positions, mine)
            position, scaled, found = best.found()
            rows, _ = np.nonzero(found)
            ids = _key_array(asked["req_id"].to_pylist())
            return pa.Table.from_batches([_emit(schema, ids[rows], keys[position[found]], scaled[found] / SCALE)], schema)

        tile_keys = ["bundle", "request_tile", "entry_tile"]
        out = f"req_id {self.req_type}, entry_key {self.key_type}, similarity double"
        return left.groupBy(*tile_keys).cogroup(right.groupBy(*tile_keys)).applyInArrow(meet, out)

    def nearest(self, nprobe: int) -> DataFrame:
        if not self.stats:
            return self._nothing()
        return _ranked(self._match(self._probe(self.req, self._home(nprobe))), self.k)

    def depth(self, target: float, measured: Column | None = None) -> int:
        """Cells to visit so that the measured requests find ``target`` of their exact neighbours.

        A visited cell yields every true neighbour it holds, so one exact search gives the recall of
        every depth at once: count the neighbours by the place of their cell in the request's order.
        """
        if not self.stats:
            return 1
        one_in_hundred = F.pmod(F.xxhash64("req_id"), F.lit(100)) == 0
        chosen = written(self.req.where(one_in_hundred if measured is None else measured), "measured")
        requests = chosen.count()
        if requests < FEW:
            chosen = self.req
            requests = chosen.count()
        true = self.exact(chosen).select("req_id", "entry_key")
        homes = true.join(self.assigned.select("entry_key", "cell"), "entry_key").groupBy("req_id").agg(F.collect_list("cell").alias("homes"))
        pivots, stats = self.pivots, self.stats

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.array(sorted(stats), dtype=np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    vectors = unit_rows(list_matrix(part.column("embedding")))
                    angle = np.arccos(np.clip(vectors @ pivots.value[cells].T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.arange(len(cells))[None, :], axis=1)
                    held = part.column("homes")
                    rows = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
                    columns = np.searchsorted(cells, held.flatten().to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(place[rows, columns], pa.int64())], ["before"])

        asked = chosen.join(homes, "req_id").select("embedding", "homes")
        counted = asked.mapInArrow(places, "before long").groupBy("before").count().collect()
        return probe_depth({r["before"]: r["count"] for r in counted}, requests, target)

    def exact(self, requests: DataFrame | None = None) -> DataFrame:
        if not self.stats:
            return self._nothing()
        req = self.req if requests is None else requests
        home = self._home(1)
        first = written(_ranked(self._match(self._probe(req, home)), self.k), "home-cells")
        bound = first.groupBy("req_id").agg(
            F.when(F.count("*") >= self.k, F.min("similarity")).alias("bound")
        )
        stats = self.stats

        def beyond(part, cells, angle):
            radius = np.array([stats[c][1] for c in cells])
            bounds = np.array(
                [-2.0 if b is None else b for b in part.column("bound").to_pylist()]
            )
            reachable = np.cos(np.maximum(angle - radius, 0.0)) >= bounds[:, None] - SLACK
            return reachable & ~home(part, cells, angle)

        second = self._match(self._probe(req.join(bound, "req_id", "left"), beyond))
        return _ranked(first.drop("rank").unionByName(second), self.k)

    def _nothing(self) -> DataFrame:
        schema = f"req_id {self.req_type}, rank int, entry_key {self.key_type}, similarity double"
        return self.req.sparkSession.createDataFrame([], schema)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, dims = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dims)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), pa.float64()))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours that the approximate join also returned."""
    kept = approximate.select("req_id", "entry_key", F.lit(1).alias("_found"))
    return exact.join(kept, ["req_id", "entry_key"], "left").agg(
        F.count("*").alias("expected"),
        F.count("_found").alias("found"),
        F.round(F.try_divide(F.count("_found"), F.count("*")), 4).alias("recall"),
    )
