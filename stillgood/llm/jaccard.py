"""Exact n-gram Jaccard self-join by grouped prefixes.

Equal sets become one class, classes of equal size and prefix one group. A prefix holds the rarest
shingles of a set: two sets that reach the threshold share one of them, and passages that many
documents repeat come last. Pairs of single groups that meet in few lists are counted, bounded by
what their prefixes share, and verified. Lists, and groups with several members, are not spread
into pairs: they join into clusters, whose sets of like size meet tile by tile in matrix products.
Only links that connect are kept, so no step grows with the square of a group of copies.

How rare a shingle is need not be known: any order that all texts share gives the same links. Tasks
get a map of levels, counted by hash; shingles whose lists turn out long without a level get one,
and the texts that began with them are signed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import in_small_batches, written
from .common import STEP, broadcast_if_small, components, hashed_words, mixed

#: How often a task must see a shingle to name it, and shingles that it holds.
SEEN_OFTEN, FLUSH_SHINGLES = 2, 6_000_000
#: Cells of a map of levels at most (a byte each), and of a part of it. Shingles that share cells
#: take the higher level.
CELLS, PART_CELLS = 1 << 24, 1 << 16
#: Times that levels are mended, and the share of groups that must still be in long lists for it.
MENDED, STILL_LONG = 4, 0.01
#: Shingles that are counted, and texts that are signed, at a time.
COUNTED, SIGNED = 500_000, 500
#: Groups of a list that are compared pair by pair; sets of a tile; columns of one matrix product.
FEW, TILE, COLUMNS = 16, 512, 2_048
SMALL_IDS = 500_000


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of hashed words, or of the whole shorter sequence."""
    if not len(h):
        return np.zeros(0, np.int64)
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * STEP + h[i : len(h) - size + 1 + i]
    return np.unique(mixed(total).view(np.int64))


def _frequent(n: int):
    """Shingles that a task sees often, with their counts; one buffer holds what it saw since it last told."""

    def run(batches):
        seen, held = np.empty(FLUSH_SHINGLES, np.int64), 0

        def out():
            found, start = seen[:held], 0
            found.sort()
            while start < held:
                # a part ends with the last copy of a shingle
                end = int(np.searchsorted(found, found[min(start + COUNTED, held) - 1], side="right"))
                part, start = found[start:end], end
                values, counts = np.unique(part[1:][part[1:] == part[:-1]], return_counts=True)
                often = counts + 1 >= SEEN_OFTEN
                yield pa.record_batch({"shingle": pa.array(values[often]), "n": pa.array(counts[often].astype(np.int64) + 1)})

        for batch in batches:
            for h in hashed_words(batch.column("text")):
                found = shingles(h, n)
                for start in range(0, len(found), FLUSH_SHINGLES):
                    part = found[start : start + FLUSH_SHINGLES]
                    if held + len(part) > FLUSH_SHINGLES:
                        yield from out()
                        held = 0
                    seen[held : held + len(part)] = part
                    held += len(part)
        if held:
            yield from out()

    return run


def level_of(n) -> np.ndarray:
    return np.minimum(np.round(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)


def levels_at(first: np.ndarray, second: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Level of each shingle: the lower one of its cells in two maps of equal size."""
    if not len(first):
        return np.zeros(len(shingle), np.uint8)
    mask = len(first) - 1
    return np.minimum(first[shingle & mask], second[(shingle >> 32) & mask])


def _array(x) -> np.ndarray:
    """``x``, or what it has broadcast."""
    return x if isinstance(x, np.ndarray) else x.value


def _cells(size: int):
    def run(batches):
        for batch in batches:
            s, level = batch.column("shingle").to_numpy(), level_of(batch.column("n").to_numpy())
            at, level = np.r_[s & (size - 1), size + ((s >> 32) & (size - 1))], np.r_[level, level]
            order = np.argsort(at)
            at, level = at[order], level[order]
            edges = np.searchsorted(at, np.arange(0, 2 * size + 1, PART_CELLS))
            some = [(i, slice(low, high)) for i, (low, high) in enumerate(zip(edges, edges[1:])) if low < high]
            yield pa.record_batch({
                "part": pa.array([i for i, _ in some], pa.int32()), "at": pa.array([(at[x] % PART_CELLS).astype(np.uint16).tobytes() for _, x in some], pa.binary()),
                "level": pa.array([level[x].tobytes() for _, x in some], pa.binary())})

    return run


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, part = np.zeros(PART_CELLS, np.uint8), None
    for batch in batches:
        part = batch.column("part")[0].as_py()
        for at, level in zip(batch.column("at"), batch.column("level")):
            np.maximum.at(cells, np.frombuffer(at.as_py(), np.uint16), np.frombuffer(level.as_py(), np.uint8))
    yield pa.record_batch({"part": pa.array([part], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})


def _levels(seen: DataFrame) -> tuple:
    """Two broadcast maps of levels of ``(shingle, n)`` (written before)."""
    size = PART_CELLS
    rows = seen.count()
    while size < min(CELLS, 4 * rows):
        size *= 2
    levels = np.zeros(2 * size, np.uint8)
    for r in seen.mapInArrow(_cells(size), "part int, at binary, level binary").groupBy("part").applyInArrow(_highest, "part int, cells binary").toLocalIterator():
        levels[r.part * PART_CELLS : (r.part + 1) * PART_CELLS] = np.frombuffer(r.cells, np.uint8)
    return tuple(seen.sparkSession.sparkContext.broadcast(x) for x in np.split(levels, 2))


def _without_level(first, second):
    """Long lists whose shingle counts as rarer than that."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(levels_at(_array(first), _array(second), batch.column("shingle").to_numpy()) < level_of(FEW + 1)))

    return run


def _signed(n: int, percent: int, first, second):
    """Size, digest and prefix of every text's set, by two maps of levels or their broadcasts."""

    def signed(batch):
        sizes, digests, prefixes = [], [], []
        for h in hashed_words(batch.column("text")):
            s = shingles(h, n)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            # sorted already, so a stable sort by level is one by level and shingle
            order = np.argsort(levels_at(_array(first), _array(second), s), kind="stable")
            prefixes.append(s[order[: len(s) + 1 - -(-percent * len(s) // 100)]] if len(s) else s)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
        return pa.record_batch({"id": batch.column("id"), "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "prefix": lists})

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SIGNED):
                yield signed(batch.slice(start, SIGNED))

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.record_batch({"id": part.column("id"), "shingles": pa.array([shingles(h, n) for h in hashed_words(part.column("text"))], pa.list_(pa.int64()))})

    return run


def local_components(links: np.ndarray) -> np.ndarray:
    """Smallest row connected to each row of a symmetric matrix of links."""
    label = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        low = np.where(links, label[None, :], len(label)).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Views of the lists of a column."""
    edges = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), edges[1:-1] - edges[0]) if len(column) else []


def _tile(percent: int):
    """Links among the sets of one pair of tiles, as edges to the smallest set of each local component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ids, sets = pa.concat_arrays([b.column("id") for b in held]), [x for b in held for x in _lists(b.column("shingles"))]
        order = pc.sort_indices(ids)
        ids, sets, size = ids.take(order), [sets[i] for i in order.to_pylist()], np.array([len(sets[i]) for i in order.to_pylist()], np.int64)
        flat = np.concatenate(sets)
        flat.sort()
        shared = flat[:-1][flat[1:] == flat[:-1]]
        shared = shared[np.r_[True, shared[1:] != shared[:-1]][: len(shared)]]
        del flat
        # columns of shared shingles, then rows: one number each
        keys = []
        for row, x in enumerate(sets if len(shared) else []):
            at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
            keys.append(at[shared[at] == x] * len(sets) + row)
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        keys.sort()
        both = np.zeros((len(size), len(size)), np.float32)
        for start in range(0, len(shared), COLUMNS):
            low, high = np.searchsorted(keys, [start * len(sets), (start + COLUMNS) * len(sets)])
            some = np.zeros((len(size), COLUMNS), np.float32)
            some[keys[low:high] % len(sets), keys[low:high] // len(sets) - start] = 1
            both += some @ some.T
        links = (100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))) & (both > 0)
        np.fill_diagonal(links, False)
        root = local_components(links)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.record_batch({"a": ids.take(pa.array(moved)), "b": ids.take(pa.array(root[moved]))})

    return run


def _grouped(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of classes, their places in lists, and the lists that several groups are in."""
    members = classes.select("cid", "n", "prefix", F.xxhash64("prefix").alias("p"))
    groups = written(members.groupBy("n", "p").agg(F.min("cid").alias("gid"), F.count("*").alias("members"), F.first("prefix").alias("prefix")), "groups")
    entries = groups.select("gid", "n", (F.col("members") > 1).alias("more"), F.explode("prefix").alias("shingle"))
    return groups, entries, written(entries.groupBy("shingle").agg(F.count("*").alias("m"), F.min("gid").alias("low")).where("m > 1"), "lists")


def _mended(docs: DataFrame, classes: DataFrame, seen: DataFrame, levels, n: int, percent: int):
    """Classes, groups, entries and lists, once hardly a long list is of a shingle that counts as rare."""
    kind = classes.schema["cid"].dataType.simpleString()
    for left in range(MENDED, -1, -1):
        groups, entries, lists = _grouped(classes)
        long = lists.where(F.col("m") > FEW).select("shingle", F.col("m").alias("n"))
        found = written(long.mapInArrow(_without_level(*levels), "shingle long, n long"), "unleveled")
        if not left or (found.agg(F.sum("n")).first()[0] or 0) <= STILL_LONG * groups.count():
            return classes, groups, entries, lists
        seen = written(seen.unionByName(found).groupBy("shingle").agg(F.max("n").alias("n")), "seen")
        levels = _levels(seen)
        # other prefixes stay: they hold none of these shingles
        hit = groups.select("n", F.xxhash64("prefix").alias("p"), F.explode("prefix").alias("shingle")).join(found.select("shingle"), "shingle").select("n", "p").distinct()
        hit = broadcast_if_small(written(hit, "hit"))
        keyed = classes.withColumn("p", F.xxhash64("prefix"))
        anew = written(keyed.join(hit, ["n", "p"], "left_semi").select(F.col("cid").alias("id"), "digest"), "anew")
        texts = docs.join(broadcast_if_small(written(anew.select("id").distinct(), "ids"), SMALL_IDS), "id")
        signed = texts.mapInArrow(_signed(n, percent, *levels), f"id {kind}, n long, digest binary, prefix array<bigint>").join(anew, ["id", "digest"]).dropDuplicates(["id", "digest"])
        classes = written(keyed.join(hit, ["n", "p"], "left_anti").drop("p").unionByName(signed.withColumnRenamed("id", "cid")), "classes")


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, entries: DataFrame, lists: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between classes that connect all that are linked."""
    kind = classes.schema["cid"].dataType.simpleString()
    several = written(
        classes.select("cid", "n", F.xxhash64("prefix").alias("p")).join(groups.where("members > 1").select("n", F.xxhash64("prefix").alias("p"), "gid"), ["n", "p"])
        .select(F.col("cid").alias("a"), F.col("gid").alias("b")), "several")
    met = written(entries.join(lists, "shingle"), "met")
    long = met.where(F.col("m") > FEW)
    in_long = long.groupBy("gid").agg(F.count("*").alias("longs"))
    # short lists: all pairs of compatible size, each with the number of lists both are in
    item = F.struct("gid", "n", "more")
    fits = lambda x, y: (x["gid"] < y["gid"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    pairs = (
        met.where(F.col("m") <= FEW).groupBy("shingle").agg(F.collect_list(item).alias("x"))
        .select(F.explode(F.flatten(F.transform("x", lambda x: F.transform(F.filter("x", lambda y: fits(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("pair"))
        .groupBy(F.col("pair.x").alias("x"), F.col("pair.y").alias("y")).agg(F.count("*").alias("common"))
        .select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), (F.col("x.more") | F.col("y.more")).alias("more"), "common")
    )
    rest = lambda c: F.ceil(F.col(c) * percent / 100) - 1  # noqa: E731  shingles behind the prefix
    pairs = (
        pairs.join(in_long.select(F.col("gid").alias("a"), F.col("longs").alias("la")), "a", "left").join(in_long.select(F.col("gid").alias("b"), F.col("longs").alias("lb")), "b", "left")
        .where((F.col("common") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) + F.greatest(rest("na"), rest("nb"))) * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    )
    pairs = written(pairs.select("a", "b", "na", "nb", "more"), "pairs")
    # long lists, groups of several and pairs that touch them: clusters
    together = long.where("gid <> low").select(F.col("gid").alias("a"), F.col("low").alias("b")).distinct().unionByName(several.where("a <> b")).unionByName(pairs.where("more").select("a", "b"))
    clusters = components(together)
    # sets of a large cluster meet those of like size only: a band holds sizes that may link, or the next one does
    width = 1.000001 * max(math.log(100 / percent), 0.01)
    large = clusters.groupBy("component").count().where(F.col("count") > TILE).select("component", F.lit(True).alias("large"))
    banded = (
        clusters.join(classes.groupBy(F.col("cid").alias("node")).agg(F.min("n").alias("low"), F.max("n").alias("high")), "node").join(large, "component", "left")
        .select("node", "component", F.explode(F.when(F.col("large"), F.sequence(F.floor(F.log("low") / width), F.floor(F.log("high") / width))).otherwise(F.array(F.lit(0).cast("long")))).alias("band"))
    )
    banded = written(banded, "bands")
    sizes = written(banded.groupBy("component", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "sizes")
    tiled = banded.join(sizes, ["component", "band"]).select(F.col("node").alias("id"), "component", "band", F.pmod(F.xxhash64("node", F.lit(7)), "tiles").cast("int").alias("tile"))
    tiled = written(tiled, "tiles")
    alone = pairs.where("NOT more")
    needed = written(tiled.select("id").unionByName(alone.select(F.col("a").alias("id"))).unionByName(alone.select(F.col("b").alias("id"))).distinct(), "needed")
    texts = docs.join(broadcast_if_small(needed, SMALL_IDS), "id")
    sets = written(texts.mapInArrow(_sets(n), f"id {kind}, shingles array<bigint>"), "sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    checked = (
        alone.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(shared * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")
    )
    # (band, step) is the band of the smaller sets and whether the others' band is the next one
    to = [
        tiled.join(sizes.select("component", (F.col("band") - step).alias("band"), "tiles"), ["component", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("id", "component", F.least("band", F.col("band") + step).alias("band"), F.lit(abs(step)).alias("step"), first.alias("i"), second.alias("j"))
        for step, first, second in ((0, F.least("tile", "other"), F.greatest("tile", "other")), (1, F.col("tile"), F.col("other")), (-1, F.col("other"), F.col("tile")))
    ]
    dealt = to[0].unionByName(to[1]).unionByName(to[2]).join(sets, "id")
    return checked.unionByName(dealt.groupBy("component", "band", "step", "i", "j").applyInArrow(_tile(percent), f"a {kind}, b {kind}"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row: sets of ``n``-word shingles link at a Jaccard of ``percent`` / 100.

    Words are what lies between ASCII spaces, A-Z lower-cased. A text of fewer than ``n`` words has
    its whole sequence as the only shingle; null and empty texts have none and link with nothing.
    Every link counts: components are exact. Rows that share an id count as one document, which is
    linked where any of them is; a null id links with nothing and has no component. An empty table
    gives no rows; other columns are not read. Lists of shingles are 64-bit hashes.
    """
    docs = in_small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    kind = docs.schema["id"].dataType.simpleString()
    seen = written(docs.select("text").mapInArrow(_frequent(n), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "seen")
    levels = _levels(seen)
    signed = written(docs.mapInArrow(_signed(n, percent, *levels), f"id {kind}, n long, digest binary, prefix array<bigint>"), "signed")
    classes = written(
        signed.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest", "n").agg(F.min("id").alias("cid"), F.first("prefix").alias("prefix")), "classes")
    found = components(_links(docs, *_mended(docs, classes, seen, levels, n, percent), n, percent))
    of_class = classes.select("digest", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("component", "cid").alias("component"))
    return (
        signed.select("id", "n", "digest").join(of_class, "digest", "left")
        .select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns as they are: of each component the document of the smallest id.

    Of rows that share an id the one of the smallest text stays, nulls first; rows without an id
    link with nothing and stay. Only the ids that go, and those that repeat, meet the texts.
    """
    found = written(jaccard_components(docs, doc_id, text, n, percent), "components").where("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    found = written(found, "components")
    gone = broadcast_if_small(written(found.where("id <> component_id").select(F.col("id").alias(doc_id)), "gone"), SMALL_IDS)
    several = broadcast_if_small(written(found.where("id = component_id AND rows > 1").select(F.col("id").alias(doc_id)), "several"), SMALL_IDS)
    left = docs.join(gone, doc_id, "left_anti")
    first = F.row_number().over(W.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first()))
    row = left.join(several, doc_id, "left_semi").select(F.struct("*").alias("row"), first.alias("first")).where("first = 1").select("row.*")
    columns = [f"`{c}`" for c in docs.columns]
    return left.join(several, doc_id, "left_anti").select(columns).unionByName(row.select(columns))
