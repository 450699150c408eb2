"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook, and the product of both is a grid of
cells. A vector lives in the cell of its nearest centroids and visits further cells in the order of
their distance until the target recall is reached; there it meets the vectors that live there, tile
by tile in matrix products. Equal vectors are one row with a count, and of the links only sums and
edges that connect leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import broadcast_if_small, components, matrix, runs
from .jaccard import local_components

#: Vectors for the codebooks; vectors that live in one tile of a cell; visitors of one product.
SAMPLE, TILE, STEP = 20_000, 2_048, 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread first centroids: reruns agree."""
    points = np.unique(points, axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)
        centroids = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centroids)])
    return np.unique(centroids, axis=0)


class Grid:
    """Codebooks of the two halves of the vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [_codebook(sample[:, : self.half], k), _codebook(sample[:, self.half :], k)]

    def margins(self, units: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell; per half how far each centroid's region is at least (its bisector with the nearest)."""
        home, out = np.zeros(len(units), np.int64), []
        for part, book in zip((units[:, : self.half], units[:, self.half :]), self.books):
            far = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            near = far.argmin(1)
            apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))[near]
            gap = np.where(apart > 0, (far - far[np.arange(len(far)), near][:, None]) / (2 * np.where(apart > 0, apart, 1)), 0)
            out.append(np.maximum(gap, 0))
            home = home * len(book) + near
        return home, out

    def visits(self, units: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Home cells, and which cells a vector visits: all that the traversal by distance meets up to ``radius``."""
        home, (a, b) = self.margins(units)
        mask = (a[:, :, None] ** 2 + b[:, None, :] ** 2 <= radius**2).reshape(len(units), -1)
        mask[np.arange(len(units)), home] = True
        return home, mask


def visiting_radius(cosine: float, dims: int, recall: float) -> float:
    """Distance up to which cells are visited.

    Linked unit vectors differ by at most ``sqrt(2 - 2 cosine)``. Across two given bisectors a
    difference without preferred direction reaches further than r with probability
    ``exp(-r^2 dims / (2 difference^2))``; a recall of 1 takes the whole difference, which misses none.
    """
    most = np.sqrt(max(2 - 2 * cosine, 0)) + 1e-9
    return float(most if recall >= 1 else min(most, most * np.sqrt(2 / dims * np.log(1 / (1 - recall)))))


def near_duplicates(rows: DataFrame, row_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = 0.98, recall: float = 0.9999) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row: links join vectors of one label with ``cosine`` or more.

    A pair is found if either vector visits the other's cell, and counts for both; none below
    ``cosine`` counts. Vectors that are null, empty, zero or have null or non-finite components link
    with nothing, nor do those with a null label or id or of another length. Repeated rows are
    vectors of their own. Codebooks come from the first ``SAMPLE`` vectors by hash; every vector is
    indexed. An empty table gives no rows; other columns are not read.
    """
    all_rows = rows.select(F.col(row_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = all_rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    kind = all_rows.schema["id"].dataType.simpleString()

    def named(batches):
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(np.array(v).tobytes() + x.encode()) for v, x in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])

    named_rows = written(valid.mapInArrow(named, f"id {kind}, label string, v array<double>, digest binary"), "vectors")
    classes = named_rows.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes, "classes")
    count = classes.count()
    k = int(min(max(np.ceil(np.sqrt(count / 2_000)), 4), 64))
    sample = [np.array(r.v) for r in classes.orderBy(F.xxhash64("digest"), "digest").select("v").limit(SAMPLE).collect()]
    grids = {d: Grid(_unit(np.array([v for v in sample if len(v) == d])), k) for d in {len(v) for v in sample} if d > 1}

    def grid_of(vectors: np.ndarray) -> Grid:
        return grids.get(vectors.shape[1]) or Grid(np.zeros((1, vectors.shape[1])), 1)

    def by_length(batch):
        sizes = pc.list_value_length(batch.column("v"))
        for d in pc.unique(sizes).to_pylist():
            part = batch.filter(pc.equal(sizes, d))
            yield part, matrix(part.column("v"), "float64")

    def place(batches):
        for batch in batches:
            for part, v in by_length(batch):
                home, mask = grid_of(v).visits(_unit(v), visiting_radius(cosine, v.shape[1], recall))
                cells = pa.array([np.flatnonzero(m).astype(np.int32) for m in mask], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), cells], [*part.schema.names, "home", "cells"])

    placed = written(classes.mapInArrow(place, f"digest binary, id {kind}, n long, label string, v array<double>, home int, cells array<int>")
                     .withColumn("dims", F.size("v")), "placed")
    sizes = written(placed.groupBy("label", "dims", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "cells")
    cells = broadcast_if_small(sizes)
    columns = ["label", "dims", "cell", "tile", "role", "id", "n", "home", "v"]
    homes = placed.withColumn("cell", F.col("home")).join(cells, ["label", "dims", "cell"]).withColumn("tile", F.pmod(F.xxhash64("digest"), "tiles").cast("int")).withColumn("role", F.lit(0))
    guests = placed.withColumn("cell", F.explode("cells")).join(cells, ["label", "dims", "cell"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("role", F.lit(1))
    dealt = (
        homes.select(columns).unionByName(guests.select(columns)).withColumn("key", F.concat_ws("/", "label", "dims", "cell", "tile"))
        .drop("label", "dims", "tile").repartition("key").sortWithinPartitions("key", "role")
    )

    def meet(batches):
        key, parts, tile = None, [], None
        for now, batch in runs(batches, "key"):
            if now != key:
                key, parts, tile = now, [], None
            first = int((batch.column("role").to_numpy() == 0).sum())
            if first:
                parts.append(batch.slice(0, first))
            if first == batch.num_rows or not parts:
                continue
            if tile is None:
                there = pa.Table.from_batches(parts).combine_chunks()
                v = _unit(matrix(there.column("v").combine_chunks(), "float64"))
                radius = visiting_radius(cosine, v.shape[1], recall)
                tile = (there.column("id").to_pylist(), there.column("n").to_numpy(), v, grid_of(v).visits(v, radius)[1])
            ids, n, v, visited = tile
            for start in range(first, batch.num_rows, STEP):
                guest = batch.slice(start, STEP)
                their, their_n, home = guest.column("id").to_pylist(), guest.column("n").to_numpy(), guest.column("home").to_numpy()
                links = _unit(matrix(guest.column("v"), "float64")) @ v.T >= cosine
                at = {x: i for i, x in enumerate(ids)}
                own = [(i, at[x]) for i, x in enumerate(their) if x in at and home[i] == batch.column("cell")[0].as_py()]
                if own:
                    links[tuple(np.array(own).T)] = False
                if not links.any():
                    continue
                # the pair is found there too if the one at home visits the guest's home: count it once for each
                back = links & ~visited[:, home].T
                sums = [(x, c) for x, c in zip(their, (links @ n).tolist()) if c] + [(x, c) for x, c in zip(ids, (their_n @ back).tolist()) if c]
                g, h = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
                names = sorted({their[i] for i in g} | {ids[i] for i in h})
                place_of = {x: i for i, x in enumerate(names)}
                square = np.zeros((len(names), len(names)), bool)
                at_guest, at_home = (np.array([place_of.get(x, -1) for x in some]) for some in (their, ids))
                i, j = np.nonzero(links)
                square[at_guest[i], at_home[j]] = square[at_home[j], at_guest[i]] = True
                root = local_components(square)
                edges = [(names[x], names[y]) for x, y in enumerate(root) if x != y]
                kinds = batch.schema.field("id").type
                yield pa.record_batch({
                    "id": pa.array([x for x, _ in sums + edges], kinds), "links": pa.array([c for _, c in sums] + [None] * len(edges), pa.int64()),
                    "other": pa.array([None] * len(sums) + [y for _, y in edges], kinds)})

    found = written(dealt.mapInArrow(meet, f"id {kind}, links long, other {kind}"), "links")
    joined = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("digest", "n", "id").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    linked = named_rows.select("id", "digest").join(of_class, "digest").select("id", "n_links", "component")
    other = all_rows.where(~F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(other).select("id", "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
