"""Near-duplicate passages by compact windows.

Every hash function orders the shingles of a text; its Cartesian tree has one node per compact
window: the passages around a shingle in which that shingle is the smallest. Only nodes as wide as
a passage matter, and for passages of one length they are the runs of the sliding minimum. Where
the windows of two hash functions overlap, an interval of passages shares two min-hashes: its
signature. Intervals of equal signature are joined and verified.

The first pair alone finds every word-for-word repeat, as equal passages have equal min-hashes. What
those repeats connect is known before all pairs are gone through. A passage alike to one of another
component shares most of its shingles with it, so a passage with too many shingles that only its own
component holds has no partner and meets nobody: first a part of the shingles is asked, then, of what
is left, all of them. Equal intervals, and single passages of equal sets, are one member of their list;
members meet tile by tile, and only links that connect leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_small_batches, written
from .common import STEP, TOGETHER, broadcast_if_small, components, encoded, mixed, prefix_sums, word_hashes

#: Words of a passage and of a shingle, percent of shared shingles, pairs of hash functions.
PASSAGE, SHINGLE, PERCENT, BANDS = 50, 5, 80, 8
#: Members of a list that meet in one task; columns of one matrix product; ids with their component,
#: and digests with an id, that may be broadcast.
TILE, COLUMNS, SMALL_LABELS = 256, 2_048, 500_000
#: So many in 256 shingles are asked first; passages whose repeated shingles are sought at a time; pairs of a
#: list that are compared at once, without their numbers of equal shingles.
PART, AT_ONCE, FEW = 102, 10_000, 3
#: Bits per key of the map of repeated keys, and its bits at most (64 MB), as powers of two.
KEY_BITS, MAP_BITS = 4, 29

def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``n``-word shingles in the order of the words; none below ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total *= STEP
        total += h[i : len(h) - n + 1 + i]
    return mixed(total)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width``; a run of one value is a compact window's interval of starts."""
    low, size = values, 1
    while size < width:
        step = min(size, width - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    return low


def passage_digests(sums: np.ndarray, back: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the shingles from ``start`` to ``stop``, wherever in a text they are."""
    return mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def placed(lengths: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start within it and place among all words of every passage of texts of ``lengths`` words laid end to end."""
    counts = np.maximum(lengths - passage + 1, 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, begin, (np.cumsum(lengths) - lengths)[text] + begin


def intervals(s: np.ndarray, text: np.ndarray, at: np.ndarray, width: int, bands: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per band ``(key, first, n)``: the ``n`` passages from the one numbered ``first`` on share the signature ``key``.

    Passages are given by their ``text`` and their place ``at`` among the shingles ``s``; those of one
    interval follow one another. Keys of the first band are odd. A text that holds a passage twice is
    split into single passages.
    """
    sums, back = prefix_sums(s)
    single = passage_digests(sums, back, at, at + width) ^ mixed(text.astype(np.uint64))
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    ordered = np.sort(single)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        split = np.zeros(text.max() + 1, bool)
        split[text[twice[np.searchsorted(twice, single).clip(max=len(twice) - 1)] == single]] = True
        new |= split[text]
    seeds = mixed(np.arange(1, 4 * bands + 1, dtype=np.uint64)).reshape(bands, 2, 2)
    for band in range(bands):
        # the upper halves of two permutations of the shingles
        one, two = (window_minima((((s ^ low) * (odd | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), width)[at] for low, odd in seeds[band])
        fresh = new.copy()
        fresh[1:] |= (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(fresh)
        both = one[first].astype(np.uint64) << np.uint64(32) | two[first]
        key = mixed(both ^ seeds[band, 0, 0]) & ~np.uint64(1) | np.uint64(band == 0)
        yield key.view(np.int64), first, np.diff(np.r_[first, len(at)])


def repeats_within(s: np.ndarray) -> np.ndarray:
    """How many places later each shingle comes again; beyond the end if never."""
    by = np.argsort(s, kind="stable")
    same = s[by[1:]] == s[by[:-1]]
    gap = np.full(len(s), 2 * len(s))
    gap[by[:-1][same]] = (by[1:] - by[:-1])[same]
    return gap


def _last(gap: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Places of the shingles of some passages at a time, and whether each does not come again within its passage."""
    for low in range(0, len(at), AT_ONCE):
        some = at[low : low + AT_ONCE]
        inside = some[:, None] + np.arange(width)
        yield slice(low, low + AT_ONCE), inside, gap[inside] + inside >= some[:, None] + width


def partnered(gap: np.ndarray, lone: np.ndarray, at: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Whether a passage may be alike to one of another component, which holds no shingle that is ``lone``.

    Of the different shingles of a passage at most 100 - ``percent`` in 100 may be missing in such a partner.
    """
    within = lambda mark: (lambda total: total[at + width] - total[at])(np.r_[0, np.cumsum(mark)])
    missing, size = within(lone), np.full(len(at), width)
    again = np.flatnonzero(within(gap < width))
    for some, inside, last in _last(gap, at[again], width):
        missing[again[some]], size[again[some]] = (lone[inside] & last).sum(1), last.sum(1)
    return 100 * missing <= (100 - percent) * size


def set_digests(s: np.ndarray, gap: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the different shingles of every passage, in whatever order and however often they come."""
    each, out = mixed(s ^ STEP), np.zeros(len(at), np.uint64)
    for some, inside, last in _last(gap, at, width):
        out[some] = np.where(last, each[inside], np.uint64(0)).sum(1)
    return mixed(out)


def key_map(keys: DataFrame, most: int = MAP_BITS) -> tuple[np.ndarray, int]:
    """One bit for each place that some key of ``keys`` (written) hashes to, and the mask that gives the place.

    Keys are spread evenly, so their own bits do. A fuller map only lets more keys pass that are not there.
    """
    bits = min(most, max(15, int(keys.count()).bit_length() + KEY_BITS))
    place = F.shiftrightunsigned("key", 1).bitwiseAND(F.lit((1 << bits) - 1))
    # Spark numbers bitmaps of 4 KB from 1, for values from 1
    parts = (keys.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("at"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow())
    found = np.zeros((1 << bits) // 8, np.uint8)
    for at, part in zip(parts.column("at").to_pylist(), parts.column("bits")):
        found[(at - 1) * 4096 : at * 4096] = np.frombuffer(part.as_buffer(), np.uint8)
    return found, (1 << bits) - 1


def may_hold(found: np.ndarray, mask: int, key: np.ndarray) -> np.ndarray:
    """Whether a key may be one of those that the map was made of."""
    place = (key.view(np.uint64) >> np.uint64(1)) & np.uint64(mask)
    return (found[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def once(*columns: np.ndarray) -> np.ndarray:
    """Numbers of rows that differ, the first of each."""
    both = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        both = mixed(both * STEP + column.view(np.uint64))
    return np.unique(both, return_index=True)[1]


def _together(batches: Iterator[pa.RecordBatch], passage: int, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts are hashed together, their shingles end to end, and their numbers of words; the longest has a passage."""
    for batch in batches:
        texts, size, low = [], 0, 0
        for row, text in enumerate(batch.column("text"), 1):
            texts.append(encoded(text.as_py()))
            size += len(texts[-1])
            if size > TOGETHER or row == batch.num_rows:
                h, lengths = word_hashes(texts)
                rows = batch.slice(low, row - low)
                texts, size, low = [], 0, row
                if lengths.max() >= passage:
                    yield rows, shingle_hashes(h, n), lengths


def _windows(passage: int, n: int, wanted=None):
    """Keys of the first pair of all intervals; with ``wanted``, a broadcast map of keys, all of the intervals it may hold."""
    width = passage - n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, lengths in _together(batches, passage, n):
            text, begin, at = placed(lengths, passage)
            for key, first, count in intervals(s, text, at, width, 1):
                if wanted is None:
                    yield pa.record_batch({"key": pa.array(key)})
                    continue
                keep = may_hold(*wanted.value, key)
                key, first, count = key[keep], first[keep], count[keep]
                digest = passage_digests(*prefix_sums(s), at[first], at[first] + count + width - 1)
                yield pa.record_batch({
                    "key": pa.array(key), "id": rows.column("id").take(pa.array(text[first])), "digest": pa.array(digest.view(np.int64)),
                    "start": pa.array(begin[first].astype(np.int32)), "n": pa.array(count.astype(np.int32))})

    return run


def _asked(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(56)) < PART  # bits that are no part of a place in a map


def _first_asked(passage: int, n: int):
    """``PART`` in 256 shingles of texts that have a passage, with the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, lengths in _together(batches, passage, n):
            size = np.where(lengths >= passage, lengths, 0)
            text = np.repeat(np.arange(len(lengths)), lengths)[: len(s)]
            # shingles across two texts only let more passages pass
            keep = np.flatnonzero(_asked(s) & (size[text] > 0))
            yield pa.record_batch({"key": pa.array(s[keep].view(np.int64)), "component": rows.column("component").take(pa.array(text[keep]))})

    return run


def _stretches(passage: int, n: int, percent: int, common):
    """Parts of texts whose passages may have a partner, by the shingles that were asked first; ``common`` is the map of those of several components."""
    width = passage - n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, lengths in _together(batches, passage, n):
            text, begin, at = placed(lengths, passage)
            keep = np.flatnonzero(partnered(repeats_within(s), _asked(s) & ~may_hold(*common.value, s), at, width, percent))
            if not len(keep):
                continue
            text, begin, at = text[keep], begin[keep], at[keep]
            first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
            stop = at[np.r_[first[1:], len(at)] - 1] + width
            row = pa.array(text[first])
            yield pa.record_batch({
                "id": rows.column("id").take(row), "component": rows.column("component").take(row), "start": pa.array(begin[first].astype(np.int32)),
                "shingles": pa.array([s[x:y].view(np.int64) for x, y in zip(at[first], stop)], pa.list_(pa.int64()))})

    return run


def _signed(width: int, percent: int, bands: int, common, others, wanted=None):
    """Keys and components of the intervals of all stretches; with ``wanted``, all of the intervals that this map of keys may hold.

    Passages without a partner by all their shingles are left out; ``common`` and ``others`` are the maps of
    those of several components, asked first and second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            if not len(lists):
                continue
            s, size = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            row, begin, at = placed(size, width)
            gap = repeats_within(s)
            lone = ~np.where(_asked(s), may_hold(*common.value, s), may_hold(*others.value, s))
            keep = np.flatnonzero(partnered(gap, lone, at, width, percent))
            if not len(keep):
                continue
            row, begin, at = row[keep], begin[keep] + batch.column("start").to_numpy()[row[keep]], at[keep]
            sums, names = prefix_sums(s), batch.column("component").dictionary_encode()
            label = names.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            for key, first, count in intervals(s, row, at, width, bands):
                if wanted is None:
                    some = once(key, label[row[first]])
                    yield pa.record_batch({"key": pa.array(key[some]), "component": names.take(pa.array(row[first[some]])).dictionary_decode()})
                    continue
                keep = may_hold(*wanted.value, key)
                key, first, count = key[keep], first[keep], count[keep]
                digest, one = passage_digests(*sums, at[first], at[first] + count + width - 1), count == 1
                digest[one] = set_digests(s, gap, at[first[one]], width)
                some = once(key, digest, label[row[first]])
                key, first, count, digest = key[some], first[some], count[some], digest[some]
                parts = [s[x:y].view(np.int64) for x, y in zip(at[first], at[first] + count + width - 1)]
                yield pa.record_batch({
                    "key": pa.array(key), "component": names.take(pa.array(row[first])).dictionary_decode(), "id": batch.column("id").take(pa.array(row[first])),
                    "digest": pa.array(digest.view(np.int64)), "start": pa.array(begin[first].astype(np.int32)), "shingles": pa.array(parts, pa.list_(pa.int64()))})

    return run


def _passages(passage: int, n: int, owners, places):
    """Digest of every passage of the intervals of the first pair that two broadcast maps may hold: one of ids, one of ids and starts."""
    width = passage - n + 1

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(may_hold(*owners.value, batch.column("owner").to_numpy()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, lengths in _together(wanted(batches), passage, n):
            text, begin, at = placed(lengths, passage)
            owner = rows.column("owner").to_numpy()
            for _, first, count in intervals(s, text, at, width, 1):
                keep = np.repeat(may_hold(*places.value, owner[text[first]] ^ (begin[first] << 1)), count)
                found = passage_digests(*prefix_sums(s), at[keep], at[keep] + width)
                yield pa.record_batch({"digest": pa.array(found.view(np.int64)), "id": rows.column("id").take(pa.array(text[keep])), "start": pa.array(begin[keep].astype(np.int32))})

    return run


def distinct_counts(s: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of every window of ``width``: those that do not come again within it."""
    return np.concatenate([last.sum(1) for _, _, last in _last(repeats_within(s), np.arange(len(s) - width + 1), width)])


def alike(a: np.ndarray, b: np.ndarray, width: int, percent: int) -> bool:
    """Whether any passage of ``a`` and any of ``b`` reach a Jaccard of ``percent`` / 100."""
    if len(np.unique(a)) < len(a) or len(np.unique(b)) < len(b):
        values, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        sets = np.zeros((len(a) + len(b) - 2 * width + 2, len(values)), np.float32)
        for row, start in enumerate((*range(len(a) - width + 1), *range(len(a), len(a) + len(b) - width + 1))):
            sets[row, place[start : start + width]] = 1
        left, right = np.split(sets, [len(a) - width + 1])
        both = left @ right.T
        return bool((both * (100 + percent) >= percent * (left.sum(1)[:, None] + right.sum(1))).any())
    sums = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    sums[1:, 1:] = (a[:, None] == b[None, :]).cumsum(0).cumsum(1)
    both = sums[width:, width:] - sums[:-width, width:] - sums[width:, :-width] + sums[:-width, :-width]
    return bool((both * (100 + percent) >= 2 * percent * width).any())


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of equal shingles of every two lists."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column, both = row[by], column[by], np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        some = np.zeros((len(sets), min(COLUMNS, column[-1] + 1 - start)), np.float32)
        some[row[low:high], column[low:high] - start] = 1
        both += some @ some.T
    return both


def connecting(sets: list[np.ndarray], label: np.ndarray, tile: np.ndarray | None, width: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that verified passages of one list, or of one pair of its tiles, connect; ``tile`` only for two different ones."""
    apart = label[:, None] != label[None, :]
    if tile is not None:  # each of the two tiles also meets itself elsewhere
        apart &= tile[:, None] != tile[None, :]
    if np.count_nonzero(apart) > 2 * FEW:
        # two passages alike share this part of their sizes, so must the intervals around them
        least = np.array([width if len(np.unique(x)) == len(x) else distinct_counts(x, width).min() for x in sets])
        apart &= _shared(sets) * (100 + percent) >= percent * (least[:, None] + least[None, :])
    edges, label = [], label.copy()
    for i, j in np.argwhere(np.tril(apart, -1)):
        if label[i] != label[j] and alike(sets[i], sets[j], width, percent):
            edges.append((label[i], label[j]))
            label[label == label[i]] = label[j]
    return edges


def _tile(width: int, percent: int):
    """Edges between components that verified passages connect; the rows come sorted by list and pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None])
            if not table.num_rows:
                continue
            now = table.combine_chunks().to_batches()[0]
            lists, component = now.column("shingles"), now.column("component").dictionary_encode()
            flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
            label, names = component.indices.to_numpy(zero_copy_only=False).astype(np.int64), component.dictionary
            key, low, high, tile = (now.column(c).to_numpy() for c in ("key", "i", "j", "tile"))
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            if batch is not None:  # the last list may go on
                held = now.slice(first[-1])
            edges = []
            for x, y in zip(first, first[1:] if batch is not None else [*first[1:], len(key)]):
                if y - x > 1:
                    edges += connecting([flat[cut[k] : cut[k + 1]] for k in range(x, y)], label[x:y], tile[x:y] if low[x] != high[x] else None, width, percent)
            a, b = (pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1))
            yield pa.record_batch({"a": names.take(a), "b": names.take(b)})

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, n: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """``(id, component_id, spans)`` per row of ``docs``.

    ``spans`` lists what other places of the corpus, in the same text or another one, repeat word
    for word over at least ``passage`` words: ranges of word positions, end exclusive, merged and
    ascending. ``component_id`` is the smallest id reachable by documents that share such a passage,
    or two passages of ``passage`` words whose sets of ``n``-word shingles reach a Jaccard of
    ``percent`` / 100. Repeats are found for certain; near ones if both hash functions of one of
    ``bands`` pairs agree, so the probability of missing a single pair of passages of Jaccard j is
    (1 - j^2) ^ bands, and documents alike over more words have more such pairs.

    Words are what lies between ASCII spaces, A-Z lower-cased. Null, empty and shorter texts have no
    spans and link with nothing. Rows that share an id are one document; a null id has no spans, no
    component, and repeats nothing. An empty table gives no rows; other columns are not read.
    """
    width = passage - n + 1
    if width < 1:
        raise ValueError("a passage needs at least one shingle")
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = in_small_batches(docs.where("id IS NOT NULL AND text IS NOT NULL"))
    kind = docs.schema["id"].dataType.simpleString()

    broadcast = docs.sparkSession.sparkContext.broadcast
    signed = known.select("text").mapInArrow(_windows(passage, n), "key long")
    keys = written(signed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "keys")
    # most keys come once: their intervals leave no task
    windows = known.mapInArrow(_windows(passage, n, broadcast(key_map(keys))), f"key long, id {kind}, digest long, start int, n int")
    met = written(windows, "met")
    classes = written(met.groupBy("key", "digest").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("id", "start", "n"))), "classes")
    # word for word: every member hangs on one of its class, whichever comes first
    again = classes.where("rows > 1").select("key", "digest", F.col("id").alias("low"))
    stop = F.col("start") + F.col("n") - 1 + passage
    whole = met.join(again, ["key", "digest"]).select("id", "low", "start", stop.alias("stop"))
    # intervals that are equal in part: passage by passage, for one member of each class
    several = classes.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    owner = F.xxhash64("id")
    place = owner.bitwiseXOR(F.shiftleft(F.col("start").cast("long"), 1))
    parted = written(classes.join(several, "key").select(owner.alias("owner"), place.alias("key")), "wanted")
    owners, places = (broadcast(key_map(parted.select(F.col(c).alias("key")))) for c in ("owner", "key"))
    single = written(known.withColumn("owner", owner).mapInArrow(_passages(passage, n, owners, places), f"digest long, id {kind}, start int"), "passages")
    # rows that share an id may hold one place several times
    repeats = single.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("start").alias("first"), F.max("start").alias("last"))
    twice = written(repeats.where("low <> high OR first <> last").select("digest", "low"), "twice")
    part = single.join(broadcast_if_small(twice, SMALL_LABELS), "digest").select("id", "low", "start", (F.col("start") + passage).alias("stop"))
    exact = written(whole.unionByName(part), "exact")
    connected = written(components(exact.select("id", "low").distinct(), "id", "low"), "connected")
    # near passages: what may have a partner in another component, by some of the shingles, then by all
    moved = broadcast_if_small(written(connected.where("node <> component").withColumnRenamed("node", "id"), "moved"), SMALL_LABELS)
    labelled = known.join(moved, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def in_several(rows: DataFrame, name: str):
        found = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        return broadcast(key_map(written(found.select("key"), name)))

    keyed = f"key long, component {kind}"
    common = in_several(labelled.select("component", "text").mapInArrow(_first_asked(passage, n), keyed), "common")
    stretches = written(labelled.mapInArrow(_stretches(passage, n, percent, common), f"id {kind}, component {kind}, start int, shingles array<bigint>"), "stretches")
    rest = stretches.select("component", F.explode("shingles").alias("key")).where(F.shiftrightunsigned("key", 56) >= PART)
    others = in_several(rest, "others")
    # lists of all pairs that hold several components, one member of each class
    open_keys = in_several(stretches.mapInArrow(_signed(width, percent, bands, common, others), keyed), "open")
    signed = stretches.mapInArrow(_signed(width, percent, bands, common, others, open_keys), f"{keyed}, id {kind}, digest long, start int, shingles array<bigint>")
    left = written(signed, "left")
    members = written(left.groupBy("key", "digest").agg(F.first(F.struct("id", "start", "component", "shingles")).alias("one"), F.min("component").alias("low"), F.max("component").alias("high"))
                      .select("key", "digest", "one.*", "low", "high"), "members")
    equal = left.join(members.where("low <> high").select("key", "digest", "low"), ["key", "digest"]).select(F.col("low").alias("a"), F.col("component").alias("b")).where("a <> b")
    lists = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key", "tiles")
    tile = F.pmod(F.xxhash64("id", "start", F.lit(7)), "tiles").cast("int")
    dealt = (members.join(lists, "key").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("key", "component", "shingles", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    by = ["key", "i", "j"]
    near = written(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_tile(width, percent), f"a {kind}, b {kind}").unionByName(equal).distinct(), "near")
    merged = components(near).select(F.col("node").alias("component"), F.col("component").alias("root"))
    every = connected.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(connected, "node", "left_anti").select("node", F.col("node").alias("component")))
    found = every.join(merged, "component", "left").select(F.col("node").alias("id"), F.coalesce("root", "component").alias("component"))
    spans = exact.groupBy("id").agg(merge_ranges(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return (docs.select("id").join(found, "id", "left").join(spans, "id", "left")
            .select("id", F.coalesce("component", "id").alias("component_id"), F.coalesce("spans", none).alias("spans")))


def merge_ranges(ranges):
    """Ascending ranges ``(start, stop)`` with those that touch or overlap made one."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    nothing = F.struct(none.alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))

    def closed(state):
        last = F.struct(state["start"].alias("start"), state["stop"].alias("stop"))
        return F.when(state["stop"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(last)))

    def add(state, r):
        longer = F.struct(state["done"].alias("done"), state["start"].alias("start"), F.greatest(state["stop"], r["stop"]).alias("stop"))
        apart = F.struct(closed(state).alias("done"), r["start"].alias("start"), r["stop"].alias("stop"))
        return F.when(r["start"] <= state["stop"], longer).otherwise(apart)

    return F.aggregate(ranges, nothing, add, closed)
