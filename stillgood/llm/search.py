"""Ranked lexical search over an index cut by documents, term- and document-at-a-time by turns.

``build_index`` deals the documents into blocks, as they come, and writes for each block its terms'
postings: no posting crosses the network. ``search`` reads the postings of the queries' terms, block
by block. Within a block a query first sums its short lists term by term; the sums are then one more
iterator, with a bound like every list's, beside the long lists, which are gone through document by
document (in windows) and skipped where the bounds cannot reach the k-th best score so far.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import LOWER, UPPER, broadcast_if_small, runs

#: A term; A-Z are lower-cased, nothing else is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters and documents after which a block is full: its index stays in a task's memory.
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 65_536
#: Documents of a window, and the share of a block's documents up to which a list is short.
WINDOW, SHORT_SHARE = 1_024, 1 / 64
#: Terms of queries that travel with one job; more queries are put in several jobs.
QUERY_TERMS = 200_000
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: letters and digits of ASCII, and all that lies beyond it."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _packed(part: int, number: int, ids: pa.Array, codes: dict, flat: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one block: the block's own (ids, lengths), then one per term with packed postings."""
    block, values = (part << 24) + number, ids.to_pylist()
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, 0 if values[i] is None else values[i]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = np.array([len(x) for x in flat], np.int64)
    document = np.repeat(place, lengths)
    both, tf = np.unique(np.concatenate([*flat, np.zeros(0, np.uint32)]).astype(np.int64) << 16 | document, return_counts=True)
    code, docs = both >> 16, (both & 0xFFFF).astype("<u2")
    df = np.bincount(code, minlength=len(codes))
    width = next(w for w in (1, 2, 4) if not len(tf) or int(tf.max()) < 1 << 8 * w)
    ends = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)

    def rows(count, columns):
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), x).cast(kind)
    yield rows(1, {"block": pa.array([block], pa.int64()), "ids": listed(ids.take(pa.array(order, pa.int64())), schema.field("ids").type),
                   "n": listed(pa.array(lengths[order]), schema.field("n").type)})
    names, tf = list(codes), tf.astype(f"<u{width}")
    for a in range(0, len(names), 100_000):
        b = min(a + 100_000, len(names))
        cut = ends[a : b + 1] - ends[a]

        def binary(data, size):
            offsets = pa.py_buffer((cut * size).astype("<i4").tobytes())
            return pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(data[ends[a] : ends[b]].tobytes())])

        yield rows(b - a, {"block": pa.array(np.full(b - a, block)), "term": pa.array([t.decode("utf-8", "replace") for t in names[a:b]]), "df": pa.array(df[a:b]),
                           "docs": binary(docs, 2), "tf": binary(tf, width), "width": pa.array(np.full(b - a, width, np.int32))})


def _index(schema: pa.Schema, block_chars: int):
    def run(batches):
        number = chars = 0
        part, ids, flat = 0, [], []
        codes = defaultdict()
        codes.default_factory = codes.__len__

        def out():
            return _packed(part, number, pa.chunked_array(ids).combine_chunks(), codes, flat, schema)

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                flat.append(np.array([codes[t] for t in terms(text)], np.uint32))
                chars += len(text)
                if chars >= block_chars or len(flat) >= BLOCK_DOCS:
                    part = batch.column("part")[0].as_py()
                    ids.append(batch.column("id").slice(start, i + 1 - start))
                    yield from out()
                    codes.clear()
                    start, number, chars, ids, flat = i + 1, number + 1, 0, [], []
            if start < batch.num_rows:
                part = batch.column("part")[0].as_py()
                ids.append(batch.column("id").slice(start))
        if flat:
            yield from out()

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Writes the index of all terms of all whole texts below the shared folder and returns it.

    ``(block, term, df, docs, tf, width)`` for each term of a block, ``(block, ids, n)`` once a block with
    its documents in ascending order of id. Null and empty texts have no terms but are listed; null ids
    and repeated rows are documents like others; an empty table gives an empty index; other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    id_type = rows.schema["id"].dataType
    kind = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.binary()), ("tf", pa.binary()), ("width", pa.int32()),
                      ("ids", pa.list_(_arrow(id_type))), ("n", pa.list_(pa.int64()))])
    ddl = f"block long, term string, df long, docs binary, tf binary, width int, ids array<{id_type.simpleString()}>, n array<long>"
    return written(rows.mapInArrow(_index(kind, block_chars), ddl), "index")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class _List:
    """Postings of a term, or the summed short lists: ascending documents, scores, and where windows begin."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, windows: int):
        self.docs, self.scores = docs, scores
        self.starts = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
        self.most = int(scores.max(initial=0))
        # most[w] per window; reduceat wants non-empty cuts
        self.tops = np.zeros(windows, np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.tops[full] = np.maximum.reduceat(scores, self.starts[full])


class _Block:
    """One block's documents and, on demand, the lists of the queries' terms with their scores."""

    def __init__(self, ids: list, lengths: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        self.floor = 10 + 90 * lengths * n_docs // max(n_terms, 1)
        self.windows = -(-len(ids) // WINDOW)
        self.packed: dict[str, tuple] = {}
        self.lists: dict[str, _List] = {}

    def list(self, term: str, weight: int) -> _List:
        if term not in self.lists:
            docs, tf, width = self.packed.pop(term)
            docs, tf = np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(tf, f"<u{width}").astype(np.int64)
            self.lists[term] = _List(docs, weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.floor[docs])), self.windows)
        return self.lists[term]

    def search(self, query: list[tuple[str, int]], least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, scores and how many postings were scored; all that could be among the k best with at least ``least``."""
        lists = [self.list(t, w) for t, w in query if t in self.lists or t in self.packed]
        limit = len(self.ids) * SHORT_SHARE
        short, long = [x for x in lists if len(x.docs) <= limit], [x for x in lists if len(x.docs) > limit]
        scored, least = 0, max(least, 1)
        if short:  # term at a time
            docs, scores = np.concatenate([x.docs for x in short]), np.concatenate([x.scores for x in short])
            order = np.argsort(docs, kind="stable")
            docs, scores, scored = docs[order], scores[order], len(docs)
            firsts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
            sums = np.add.reduceat(scores, firsts) if len(firsts) else scores
            long.append(_List(docs[firsts], sums, self.windows))
            if len(sums) >= k:  # k documents have at least this much already
                least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        if not long:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        long.sort(key=lambda x: -x.most)
        rest = np.cumsum([0] + [x.most for x in reversed(long)])[::-1]
        bounds = np.sum([x.tops for x in long], axis=0)
        kept_docs, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w in np.flatnonzero(bounds >= least):
            if bounds[w] < least:
                continue
            low = w * WINDOW
            scores = np.zeros(WINDOW, np.int64)
            # a document that is in none of the first lists cannot reach the bound by the others
            needed = int(np.searchsorted(-rest, -least, side="right"))
            for x in long[:needed]:
                a, b = x.starts[w], x.starts[w + 1]
                scores[x.docs[a:b] - low] += x.scores[a:b]
                scored += b - a
            found = np.flatnonzero(scores)
            for i in range(needed, len(long)):
                found = found[scores[found] + rest[i] >= least]
                a, b = long[i].starts[w], long[i].starts[w + 1]
                if not len(found) or a == b:
                    continue
                at = np.searchsorted(long[i].docs[a:b], found + low)
                at[at == b - a] = 0
                hit = long[i].docs[a + at] == found + low
                scores[found[hit]] += long[i].scores[a + at[hit]]
                scored += len(found)
            found = found[scores[found] >= least]
            kept_docs, kept = np.r_[kept_docs, found + low], np.r_[kept, scores[found]]
            if len(kept) > k:
                best = np.lexsort((kept_docs, -kept))[:k]
                kept_docs, kept = kept_docs[best], kept[best]
            if len(kept) == k:
                least = max(least, int(kept.min()))
        return kept_docs, kept, scored


def _searcher(queries: list[list[tuple[str, int]]], n_docs: int, n_terms: int, k: int, id_kind: str):
    """The k best of each query over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        kind, block, key = None, None, None

        def visit():
            for q, query in enumerate(queries):
                held = best[q]
                docs, scores, _ = block.search(query, -held[-1][0] if len(held) == k else 1, k)
                if len(docs):
                    new = [(-int(s), block.ids[d] is None, block.ids[d]) for d, s in zip(docs, scores)]
                    best[q] = sorted(held + new, key=lambda x: x[:2] + (() if x[1] else x[2:]))[:k]

        for now, batch in runs(batches, "block"):
            kind = batch.schema.field("ids").type.value_type
            if now != key:
                if block:
                    visit()
                key = now
                block = _Block(batch.column("ids")[0].as_py(), np.array(batch.column("n")[0].as_py(), np.int64), n_docs, n_terms)
                batch = batch.slice(1)
            for term, docs, tf, width in zip(*(batch.column(c).to_pylist() for c in ("term", "docs", "tf", "width"))):
                block.packed[term] = (docs, tf, width)
        if block:
            visit()
            out = [(q, -s, i) for q, held in enumerate(best) for s, _, i in held]
            yield pa.record_batch({"query": pa.array([x[0] for x in out], pa.int64()), "id": pa.array([x[2] for x in out], kind), "score": pa.array([x[1] for x in out], pa.int64())})

    return run


def search(index: DataFrame, queries: DataFrame, query_id: str, text: str = "text", k: int = 10, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` documents of highest score above 0 of each query.

    ``score`` sums ``w * (10**9 * tf div (1000 * tf + 8 * m))`` over the query's distinct terms, with
    ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 10 + 90 * n * N div L``: N documents hold a
    term, L counts all terms, n one document's, df the documents with the term. Equal scores rank by id,
    null ids last; repeated documents rank each. Rows with one query id make one query; null ids and
    queries without terms find nothing. ``index`` is what ``build_index`` wrote. The postings of the
    queries' terms are shuffled by block; the queries travel with the job, ``query_terms`` at a time.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    asked = written(asked.where("query_id IS NOT NULL").distinct(), "asked")
    blocks = index.where("term IS NULL")
    sums = blocks.select(F.size(F.filter("n", lambda x: x > 0)).cast("long").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    total = sums.agg(F.sum("d").alias("docs"), F.sum("t").alias("terms"), F.count("*").alias("blocks")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    id_type, query_type = index.schema["ids"].dataType.elementType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    wanted = written(asked.select("term").distinct(), "wanted")
    found = index.where("term IS NOT NULL").join(broadcast_if_small(wanted), "term")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.sum("df").cast("double") + 1))).cast("long")
    weights = written(found.groupBy("term").agg(weight.alias("w")), "weights")
    weighed = written(asked.join(weights, "term").select("query_id", "term", "w"), "weighed")
    jobs = -(-2 * weighed.count() // query_terms)
    jobs = 1 if jobs <= 2 else jobs
    out = None
    for job in range(jobs):
        mine = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(jobs)) == job) if jobs > 1 else weighed
        lists = mine.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")).collect()
        names, plain = [r["query_id"] for r in lists], [[(t["term"], t["w"]) for t in r["terms"]] for r in lists]
        rows = found if jobs == 1 else index.where("term IS NOT NULL").join(broadcast_if_small(written(mine.select("term").distinct(), "wanted")), "term")
        columns = ["block", "term", "docs", "tf", "width", "ids", "n"]
        dealt = rows.select(*columns).unionByName(blocks.select(*columns))
        dealt = dealt.repartition(max(1, total["blocks"]), "block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
        best = dealt.mapInArrow(_searcher(plain, n_docs, n_terms, k, id_type), f"query long, id {id_type}, score long")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        named = index.sparkSession.createDataFrame(list(enumerate(names)), f"query long, query_id {query_type}")
        best = best.join(F.broadcast(named), "query").select("query_id", "rank", "id", "score")
        out = best if out is None else out.unionByName(best)
    return out
