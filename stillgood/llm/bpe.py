"""Byte-level BPE by a global shuffle of distinct words.

The texts are cut into pre-tokens in blocks (one per input task and ``BLOCK_CHARS``). A block sends
each of its distinct words once, with its position in the block's dictionary, to the task that owns
the word; there sorting brings equal words together, so that each is merged once in the whole
corpus. The ids come back to the block and fill the positions of its documents.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_small_batches

#: Characters of text after which a task begins a new block; bounds the memory of a block.
BLOCK_CHARS = 32_000_000
#: Words whose ids a task holds before it sends them back, and documents in one step of gathering ids.
FLUSH_WORDS, STEP_ROWS = 200_000, 200
OTHER_ORDER = "the documents were read in another order for their words: pass a table as written"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a local vocabulary file, read on the driver and sent along (under a megabyte each)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _splitter(pattern: str, usual: str) -> Callable[[str], list[str]]:
    """``findall`` of ``pattern``; the usual one runs on ``re`` with the classes spelled out.

    ``re`` has no property classes, and large sets are fast there only below U+10000, so other
    texts take the pattern itself. Both cut every text alike.
    """
    exact = regex.compile(pattern).findall
    if pattern != usual:
        return exact
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelled(kind: str) -> str:
        found = (m[0] for m in regex.finditer(kind + "+", chars))
        return "".join(re.escape(x[0]) + (f"-{re.escape(x[-1])}" if len(x) > 1 else "") for x in found)

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    quick = re.compile(
        rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    return lambda text: quick(text) if text.isascii() or max(text) < "\U00010000" else exact(text)


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed bytes, by significance: small numbers cost about their entropy in the shuffle."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of batches, each with the name of its block: the task's part and a number in it."""
    chars = number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column("part")[0].as_py() << 24
        sizes = np.cumsum([len(x.as_py() or "") for x in batch.column("text")])
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = min(batch.num_rows, int(np.searchsorted(sizes, base + BLOCK_CHARS - chars)) + 1)
            chars += int(sizes[end - 1] - base)
            yield batch.slice(start, end - start), first + number
            if chars >= BLOCK_CHARS:
                chars, number = 0, number + 1
            start = end


def _block_words(pattern: str, usual: str):
    def run(batches):
        split, seen, key = _splitter(pattern, usual), {}, None

        def out():
            found = list(seen)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.record_batch({"block": pa.array([key] * len(part), pa.int64()), "code": pa.array(np.arange(i, i + len(part), dtype=np.int32)), "word": pa.array(part, pa.string())})

        for batch, block in _blocks(batches):
            if block != key:
                yield from out()
                seen, key = {}, block
            for text in batch.column("text"):
                seen.update(dict.fromkeys(split(text.as_py() or "")))
        yield from out()

    return run


def _block_codes(pattern: str, usual: str):
    def run(batches):
        split, key = _splitter(pattern, usual), None
        for batch, block in _blocks(batches):
            if block != key:
                key, codes = block, defaultdict()
                codes.default_factory = codes.__len__
            packed = [_packed(np.array([codes[w] for w in split(text.as_py() or "")], np.uint32)) for text in batch.column("text")]
            yield pa.record_batch({"block": pa.array([key] * len(packed), pa.int64()), "id": batch.column("id"), "codes": pa.array(packed, pa.binary())})

    return run


def _merge_words(ranks: dict[bytes, int], pattern: str):
    """Ids of sorted words; what goes back to a block is packed together, ``FLUSH_WORDS`` at a time."""

    def packed(blocks: list, codes: list, ids: list) -> pa.RecordBatch:
        block, code = np.concatenate(blocks), np.concatenate(codes)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        rows = [(int(block[x[0]]), len(x), _packed(np.concatenate([code[x], [len(ids[i]) // 4 for i in x], np.frombuffer(b"".join([ids[i] for i in x]), "<u4")])))
                for x in np.split(order, cuts)]
        return pa.record_batch({"block": pa.array([r[0] for r in rows], pa.int64()), "words": pa.array([r[1] for r in rows], pa.int32()), "codes": pa.array([r[2] for r in rows], pa.binary())})

    def run(batches):
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        last, now, blocks, codes, ids = None, b"", [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, now = word, np.array(encode(word), "<u4").tobytes()
                ids.append(now)
            blocks.append(batch.column("block").to_numpy())
            codes.append(batch.column("code").to_numpy().astype(np.int64))
            if len(ids) >= FLUSH_WORDS:
                yield packed(blocks, codes, ids)
                blocks, codes, ids = [], [], []
        if ids:
            yield packed(blocks, codes, ids)

    return run


def _dictionary(packs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's words end to end, and where and how long those of each code are."""
    parts = [(x[:n], x[n : 2 * n], x[2 * n :]) for n, x in ((n, _unpacked(data)) for n, data in packs)]
    joined = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint32)
    code, long, flat = joined(0), joined(1).astype(np.int64), joined(2)
    if len(code) and (np.sort(code) != np.arange(len(code))).any():
        raise RuntimeError(OTHER_ORDER)
    size, begin = np.empty_like(long), np.empty_like(long)
    size[code], begin[code] = long, np.cumsum(long) - long
    return flat, begin, size


def _fill(table: dict[int, bytes] | None):
    """One block: its words' ids by code, gathered at the documents' positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        is_word = pa.compute.is_valid(block.column("words"))
        packs, docs = block.filter(is_word), block.filter(pa.compute.invert(is_word)).select(["id", "codes"])
        del block
        flat, begin, size = _dictionary(list(zip(packs.column("words").to_pylist(), packs.column("codes").to_pylist())))
        del packs
        for step in docs.to_batches(max_chunksize=STEP_ROWS):
            ids = []
            for packed in step.column("codes").to_pylist():
                codes = _unpacked(packed)
                if len(codes) and codes.max() >= len(size):
                    raise RuntimeError(OTHER_ORDER)
                long = size[codes]
                ids.append(flat[np.repeat(begin[codes] - (np.cumsum(long) - long), long) + np.arange(long.sum())].tobytes())
            columns = {"id": step.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            yield pa.record_batch(columns | ({} if table is None else {"decoded": _bytes(ids, table)}))

    return run


def _bytes(ids: list[bytes | None], table: dict[int, bytes]) -> pa.Array:
    return pa.array([b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in ids], pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text",
           usual: str | None = None, decoded: bool = False) -> DataFrame:
    """``(id, n_tokens, ids[, decoded])`` per row of ``docs``; ``ids`` holds little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is merged by ``ranks`` on its own, without special tokens. Null and
    empty texts give no tokens; repeated rows and null ids give a row each; an empty table gives
    none; other columns are not read. ``docs`` is read twice (words, then positions), which must
    give the same rows in the same tasks, as a scan of files does; otherwise the job fails.
    ``usual`` is the pattern with a quick form, see ``_splitter``. ``decoded`` adds the bytes that the
    ids stand for, looked up in the token table as ``decode`` does.
    """
    usual = usual or pattern
    rows = in_small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part")))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.select("text", "part").mapInArrow(_block_words(pattern, usual), "block long, code int, word string")
    merged = found.repartition("word").sortWithinPartitions("word").mapInArrow(_merge_words(ranks, pattern), "block long, words int, codes binary")
    coded = rows.mapInArrow(_block_codes(pattern, usual), f"block long, id {id_type}, codes binary")
    parts = merged.withColumn("id", F.lit(None).cast(id_type)).unionByName(coded.withColumn("words", F.lit(None).cast("int")))
    table = {i: token for token, i in ranks.items()} if decoded else None
    return parts.groupBy("block").applyInArrow(_fill(table), f"id {id_type}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` and ``decoded``, the bytes of its ids by the token table; unknown ids end the job."""

    def run(batches):
        table = {i: token for token, i in ranks.items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(batch.column("ids").to_pylist(), table)], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
