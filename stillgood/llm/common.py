"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Separators of words: space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A frame of at most so many short rows is small enough to broadcast.
SMALL_ROWS = 100_000


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes know only ASCII letters and the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Which bytes separate words, and a number for every byte.
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of texts that are hashed together, and of a piece of a longer one.
TOGETHER, PIECE = 300_000, 4_000_000


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = np.cumprod(np.full(size, STEP)), np.cumprod(np.full(size, _UNSTEP))
    return _POWERS[size]


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial of ``values``, and the factors that take out where a part starts."""
    power, back = _powers(1 << max(18, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return sums, back


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and end of every word in them, and the number of words of each text."""
    raw = np.frombuffer(b"".join(t + b" " for t in texts).lower(), np.uint8)
    space = np.r_[True, _SPACE[raw]]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return raw, start, stop, np.diff(np.searchsorted(start, ends), prepend=0)


def place_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, back = prefix_sums(_BYTE[raw])
    return mixed((sums[stop] - sums[start]) * back[start])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and the number of words of each text."""
    raw, start, stop, lengths = word_places(texts)
    return place_hashes(raw, start, stop), lengths


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def hashed_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words: short texts are hashed together, long ones piece by piece."""
    held: list[bytes] = []
    size = 0

    def out():
        h, lengths = word_hashes(held)
        yield from np.split(h, np.cumsum(lengths)[:-1])

    for text in column:
        data = encoded(text.as_py())
        if held and size + len(data) > TOGETHER:
            yield from out()
            held, size = [], 0
        if len(data) > PIECE:
            yield np.concatenate([word_hashes([piece])[0] for piece in pieces(data)])
        else:
            held.append(data)
            size += len(data)
    if held:
        yield from out()


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` (written before) with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Slices of sorted batches, each within one value of ``key``; a key may go on in the next slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, start = pc.run_end_encode(batch.column(key)), 0
        for end, value in zip(marks.run_ends.to_pylist(), marks.values.to_pylist()):
            yield value, batch.slice(start, end - start)
            start = end


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long, complete lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)``: the smallest node that ``edges`` connect each of their nodes to.

    Every round takes the smallest label among the neighbours, then the label of the label, so
    chains halve; it is written below ``spark.checkpoint.dir``, which cuts the lineage. Hubs are
    aggregated before the shuffle, and joins leave splitting them to Spark.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        step = written(lower.join(jump, "low", "left")
                       .select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("was")).alias("moved")),
                       "labels")
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
