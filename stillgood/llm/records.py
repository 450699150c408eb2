"""Token ids as files of length-delimited binary records, with an offset index for shuffled reads.

A record is framed by its length and by masked checksums of the length and of the content::

    uint64 length, uint32 masked CRC-32 of the length, content, uint32 masked CRC-32 of the content

(little-endian; CRC-32 as in zlib, rotated by 15 bits, plus a constant, so that checksums of content
that holds checksums stay telling). The content is the row's id, a byte that says whether it is null,
a byte with the width of a token id (2 or 4), and the token ids. Rows are dealt by ranges of their id,
so files in the order of their names hold ascending ids. The index is a Parquet table with a row per
record; Spark commits it as a whole, and only files that it names count, so a task that is run again
leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Bytes after which a task begins a new file, and characters of text for each task that writes.
FILE_BYTES, TASK_CHARS = 64_000_000, 32_000_000
#: Distinct words whose ids a Python worker keeps; words not met for half as many new ones go.
KEPT_WORDS = 1_000_000
#: Layout of what comes before and after the content, and of the beginning of the content.
HEAD, TAIL, CONTENT = "<QI", "<I", "<q?B"
HEAD_BYTES, TAIL_BYTES, CONTENT_BYTES = map(struct.calcsize, (HEAD, TAIL, CONTENT))
MASK = 0xA282EAD8
INDEX = "file string, offset long, size long, id long, n_tokens long"

#: How a tokenizer has to cut texts so that words between ASCII spaces may be encoded one by one.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(content: bytes) -> bytes:
    length = struct.pack("<Q", len(content))
    return b"".join((length, struct.pack(TAIL, masked(length)), content, struct.pack(TAIL, masked(content))))


def unframe(record: memoryview | bytes, at: int = 0) -> tuple[bytes, int]:
    """Content of the record at ``at`` and where the next one begins; damage raises."""
    if len(record) - at < HEAD_BYTES:
        raise ValueError("a record ends early")
    length, check = struct.unpack_from(HEAD, record, at)
    if masked(bytes(record[at : at + 8])) != check:
        raise ValueError("the length of a record is damaged")
    begin, end = at + HEAD_BYTES, at + HEAD_BYTES + length
    if end + TAIL_BYTES > len(record):
        raise ValueError("a record ends early")
    content = bytes(record[begin:end])
    if struct.unpack_from(TAIL, record, end)[0] != masked(content):
        raise ValueError("the content of a record is damaged")
    return content, end + TAIL_BYTES


def pack(row_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack(CONTENT, row_id or 0, row_id is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(content: bytes) -> tuple[int | None, np.ndarray]:
    row_id, is_null, width = struct.unpack_from(CONTENT, content)
    return None if is_null else row_id, np.frombuffer(content, f"<u{width}", offset=CONTENT_BYTES).astype("<u4")


class Encoder:
    """Ids of texts as the tokenizers library gives them for whole texts, without special tokens added.

    Where the tokenizer cuts at white space before anything else (``BY_WORDS``), words between ASCII
    spaces are encoded once and kept. That is exact: composition never crosses a space, and no match
    of the cutting pattern holds one. Texts are lower-cased (A-Z) first unless they hold the beginning
    of a special token or a mark that could compose with a letter. Other tokenizers, and such texts,
    take the library's own way.
    """

    #: Letters that stay as they are: ASCII ones, and with Latin-1 ones after lower-casing.
    ASCII, LATIN = re.compile(b"[a-z]+").fullmatch, re.compile("[a-zß-öø-ÿ]+").fullmatch
    #: Bytes that begin U+0300 to U+036F, the marks that compose with ASCII letters.
    MARKS = re.compile(b"[\xcc\xcd]").search

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        self.tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
        self.by_words = all(spec.get(k) == v for k, v in BY_WORDS.items())
        special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.special = re.compile(b"|".join(map(re.escape, special))).search if special else lambda data: None
        self.by_words = self.by_words and not any(re.search(rb"[ \t\n\r\x0b\x0c]", t) for t in special)
        # letters stand for bytes in the vocabulary as the library's own cutter writes them
        self.letters = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]} if self.by_words else {}
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, data: bytes) -> str | None:
        """A word of letters as the vocabulary writes it; such a run stands as one piece."""
        if self.ASCII(data):
            return data.decode()
        word = data.decode()
        low = word.lower()
        return low.translate(self.letters) if self.LATIN(low) and len(low) == len(word) else None

    def _word(self, data: bytes) -> bytes:
        if data in self.older:
            found = self.older[data]
        elif (letters := self._letters(data)) is not None:
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        elif data[-1:] in (b".", b",", b";", b":", b"!", b"?") and self._letters(data[:-1]) is not None:
            # the mark ends the run of letters and begins a piece of its own
            found = self._ids(data[:-1]) + self._ids(data[-1:])
        else:
            found = self._library(data.decode())
        if len(self.kept) * 2 >= KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        self.kept[data] = found
        return found

    def _ids(self, data: bytes) -> bytes:
        found = self.kept.get(data)
        return self._word(data) if found is None else found

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        if not self.by_words or self.special(data):
            return np.frombuffer(self._library(text), "<u4")
        words = (data if self.MARKS(data) else data.lower()).split()
        found = list(map(self.kept.get, words))
        if None in found:
            found = [self._ids(w) if x is None else x for w, x in zip(words, found)]
        return np.frombuffer(b"".join(found), "<u4")


def _encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, kept from task to task with its words.

    Functions travel by value and bring new globals with every task; a library's module stays.
    """
    held = vars(tokenizers).setdefault("_worker_encoder", {})
    if vocabulary not in held:
        held.clear()
        held[vocabulary] = Encoder(vocabulary)
    return held[vocabulary]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Files:
    """Files of one task, closed before the index names what is in them."""

    def __init__(self, path: str, part: int):
        self.system, self.folder = _open(path)
        self.name = f"{part:06d}-{{:04d}}-{uuid.uuid4().hex}.rec"
        self.number, self.sink = 0, None

    def add(self, content: bytes) -> tuple[str, int, int]:
        if self.sink is None:
            self.system.create_dir(f"{self.folder}/data", recursive=True)
            self.sink, self.at = self.system.open_output_stream(f"{self.folder}/data/{self.name.format(self.number)}"), 0
        record = frame(content)
        self.sink.write(record)
        self.at += len(record)
        return self.name.format(self.number), self.at - len(record), len(record)

    def full(self) -> bool:
        return self.sink is not None and self.at >= FILE_BYTES

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.number, self.sink = self.number + 1, None


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
                 task_chars: int = TASK_CHARS) -> DataFrame:
    """Encodes the texts, writes their records below ``path/data`` and returns the index, ``path/index``.

    ``doc_id`` is an integer column; ``vocabulary`` is the text of a tokenizer's JSON file and travels
    with the job. Every text is encoded whole, ``end_id`` comes after it. Null and empty texts give
    ``end_id`` alone; rows with one id stand next to each other, equal ids ordered by text, null ids come
    last; an empty table gives an empty index and no file; other columns are not read. A hot id is
    spread over tasks, since ranges are taken over (id, text hash, row). ``path`` has to be a new folder
    that all executors reach, of a file system that pyarrow opens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(1, -(-chars // task_chars))
    rows = rows.withColumn("order", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    keys = [F.col("id").asc_nulls_last(), F.col("order"), F.col("text"), F.col("salt")]
    dealt = rows.repartitionByRange(tasks, keys[0], keys[1], keys[3]).sortWithinPartitions(keys[0], keys[1], keys[3])
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(vocabulary), np.array([] if end_id is None else [end_id], "<u4")
        files, rows = None, []

        def out():
            files.close()
            file, offset, size, ids, n = zip(*rows)
            return pa.record_batch({"file": pa.array(file), "offset": pa.array(offset, pa.int64()), "size": pa.array(size, pa.int64()),
                                    "id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

        for batch in batches:
            for row_id, text, part in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("part").to_pylist()):
                files = files or _Files(path, part)
                ids = np.concatenate([encoder.encode(text.as_py()), end])
                rows.append((*files.add(pack(row_id, ids)), row_id, len(ids)))
                if files.full():
                    yield out()
                    rows = []
        if rows:
            yield out()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


ROWS = "id long, start long, n_tokens long, ids binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    ids, start, n, data = zip(*found)
    return pa.record_batch({"id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(data, pa.binary())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every record, file by file; ``start`` counts the ids before it.

    Reads the files themselves: each whole file is one task's, streamed, and every checksum is tested.
    The index says which files there are and how many ids came before each of them (one row per file).
    """
    files = read_index(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records"), F.sum("size").alias("size"))
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    files = written(files.withColumn("start", F.coalesce(before, F.lit(0))), "files")

    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                system, folder = _open(path)
                found, held, left, start, read = [], b"", file["records"], file["start"], 0
                with system.open_input_stream(f"{folder}/data/{file['file']}") as source:
                    while left:
                        need = HEAD_BYTES
                        if len(held) >= need:
                            need += struct.unpack_from(HEAD, held)[0] + TAIL_BYTES
                        if len(held) < need:
                            more = source.read(max(need - len(held), 1 << 20))
                            read += len(more)
                            if not more:
                                raise ValueError(f"{file['file']} ends early")
                            held += more
                            continue
                        view, at = memoryview(held), 0
                        while left and len(held) - at >= HEAD_BYTES and len(held) - at >= HEAD_BYTES + struct.unpack_from(HEAD, held, at)[0] + TAIL_BYTES:
                            content, at = unframe(view, at)
                            row_id, ids = unpack(content)
                            found.append((row_id, start, len(ids), ids.tobytes()))
                            start, left = start + len(ids), left - 1
                        held = held[at:]
                        if found:
                            yield _rows(found)
                            found = []
                    if read - len(held) != file["size"] or held or source.read(1):
                        raise ValueError(f"{file['file']} holds more than its index names")

    count = files.count()
    return files.repartition(max(1, count)).mapInArrow(run, ROWS)


def read_shuffled(spark: SparkSession, path: str, seed: int, tasks: int | None = None) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every record in an order that ``seed`` decides, read by the offset index.

    ``start`` is the place in that order's own task and says nothing of the files. Tasks open only the
    ranges they need. The same seed, files and number of tasks give the same order.
    """
    index = read_index(spark, path).select("file", "offset", "size")
    chance = F.xxhash64(F.lit(seed), "file", "offset")
    dealt = index.withColumn("chance", chance)
    dealt = dealt.repartition(tasks, "chance") if tasks else dealt.repartition("chance")

    def run(batches):
        system, folder = _open(path)
        open_files, start = {}, 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] not in open_files:
                    if len(open_files) >= 64:
                        open_files.pop(next(iter(open_files))).close()
                    open_files[row["file"]] = system.open_input_file(f"{folder}/data/{row['file']}")
                content, _ = unframe(open_files[row["file"]].read_at(row["size"], row["offset"]))
                row_id, ids = unpack(content)
                found.append((row_id, start, len(ids), ids.tobytes()))
                start += len(ids)
            if found:
                yield _rows(found)

    return dealt.sortWithinPartitions("chance", "file", "offset").mapInArrow(run, ROWS)
