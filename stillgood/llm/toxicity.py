"""Toxicity by a linear-chain conditional random field over the words of a text.

Only documents are labelled, so words are tagged from a distance: words and word beginnings that
occur far more often in toxic than in clean training documents form a lexicon, and their tokens in
toxic documents count as toxic. The field learns from those tags how much a lexicon weight and the
tag before matter; forward-backward marginals of the tokens make the document's score and spans.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_small_batches, written
from .common import broadcast_if_small

TOKEN = re.compile(r"\w+")
#: A class's beginnings of words that may be in the lexicon, besides whole words.
STEMS = (5, 4)
#: Bounds of the fit: lexicon entries, documents and characters of the sample (half of each class).
LEXICON, SAMPLE_DOCS, SAMPLE_CHARS = 20_000, 600, 20_000_000
#: Features that a counting task holds before it passes them on.
FLUSH_FEATURES = 400_000


def features(word: str) -> list[str]:
    """The word itself and its beginnings; the first character tells which."""
    return [f"={word}", *(f"{k}{word[:k]}" for k in STEMS if len(word) > k)]


@dataclass
class Field:
    """``weights``: of bias, lexicon weight, being in the lexicon, for the toxic tag (the other has 0)."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of the document: intercept, highest marginal, log(1 + expected toxic tokens).
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, int, float]]]:
        """Number of tokens; of those in the lexicon: index, start, end, highest weight."""
        found = [w.lower() for w in TOKEN.findall(text)]
        known = {w: max(s) for w in set(found) if (s := [self.lexicon[f] for f in features(w) if f in self.lexicon])}
        if not known:
            return len(found), []
        spans = enumerate(TOKEN.finditer(text))
        return len(found), [(i, m.start(), m.end(), known[w]) for i, m in spans if (w := m[0].lower()) in known]

    def marginals(self, n: int, hits: list[tuple[int, int, int, float]]) -> np.ndarray:
        """Probability of the toxic tag for each hit, given the whole text.

        Words outside the lexicon all look alike to the field, so a run of k of them is the k-th
        power of one 2 x 2 matrix and the passes only stop at hits.
        """
        if not hits:
            return np.zeros(0)
        step = np.exp(self.moves)
        plain = step * np.exp([0.0, self.weights[0]])
        powers: dict[int, np.ndarray] = {0: np.eye(2)}

        def power(k: int) -> np.ndarray:
            if k not in powers:
                half = power(k // 2)
                whole = half @ half @ (plain if k % 2 else np.eye(2))
                powers[k] = whole / whole.sum()
            return powers[k]

        at = np.array([h[0] for h in hits])
        emit = np.exp(np.stack([np.zeros(len(hits)), self.weights[0] + self.weights[1] * np.array([h[3] for h in hits]) + self.weights[2]], 1))
        gaps = np.diff(np.r_[-1, at]) - 1
        forward, now = [], np.array([1.0, 0.0])
        for gap, e in zip(gaps.tolist(), emit):
            now = now @ power(gap) @ step * e
            now = now / now.sum()
            forward.append(now)
        back, after = np.empty((len(hits), 2)), power(n - 1 - int(at[-1])) @ np.ones(2)
        for i in range(len(hits) - 1, -1, -1):
            back[i] = after = after / after.sum()
            after = power(int(gaps[i])) @ (step @ (emit[i] * after))
        both = np.array(forward) * back
        return both[:, 1] / both.sum(1)

    def score(self, p: np.ndarray) -> float:
        x = self.document @ np.array([1.0, p.max() if len(p) else 0.0, np.log1p(p.sum())])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _descend(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam, from a fixed start: reruns agree."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _runs(plain: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``plain``, and for each pair of tags the sum over the steps at which a run takes it.

    The latter is the upper right of a power of [[plain, that entry of plain], [0, plain]]. Both are
    scaled alike, and nothing is subtracted.
    """
    block = np.zeros((2, 2, 4, 4))
    block[:, :, :2, :2] = block[:, :, 2:, 2:] = plain / plain.sum()
    for a in (0, 1):
        for b in (0, 1):
            block[a, b, a, 2 + b] = plain[a, b] / plain.sum()
    out, left = np.tile(np.eye(4), (len(lengths), 2, 2, 1, 1)), lengths.copy()
    while left.any():
        odd = left % 2 > 0
        out[odd] = out[odd] @ block
        out[odd] /= out[odd][:, :1, :1, :2, :2].sum((3, 4), keepdims=True)
        block = block @ block
        block /= block[0, 0, :2, :2].sum()
        left //= 2
    return out[:, 0, 0, :2, :2], out[:, :, :, :2, 2:]


def tag_gradient(texts: list[tuple[int, list[tuple[int, int, int, float]], int]]):
    """Gradient of the mean negative log likelihood of the tags of ``(tokens, hits, toxic)``, each with a token.

    Forward-backward over all texts at once. It stops at hits only, as the words between them all
    look alike, so a text's length costs nothing but its hits do.
    """
    texts = sorted(texts, key=lambda t: -len(t[1]))
    at = [np.array([h[0] for h in hits], np.int64) for _, hits, _ in texts]
    sizes, total = np.array([len(x) for x in at]), len(texts)
    step_of = np.concatenate([np.arange(k) for k in sizes])
    # the first hits of all texts, then the second ones
    by = np.argsort(step_of, kind="stable")
    edges = np.searchsorted(step_of[by], np.arange(sizes.max() + 1))
    flat = lambda parts: np.concatenate(parts)[by]
    lex = flat([np.array([h[3] for h in hits], float) for _, hits, _ in texts])
    tag = np.repeat([float(toxic) for _, _, toxic in texts], sizes)[by]
    gap = flat([np.diff(np.r_[-1, x]) - 1 for x in at])
    tail = np.array([n - 1 - (x[-1] if len(x) else -1) for (n, _, _), x in zip(texts, at)])
    lengths, place = np.unique(np.r_[gap, tail], return_inverse=True)
    gap_at, tail_at = place[: len(gap)], place[len(gap) :]
    tagged, both = tag.sum(), (tag * ((gap == 0) & (step_of[by] > 0))).sum()
    left = tagged - both - sum(toxic for (_, _, toxic), k, z in zip(texts, sizes, tail) if k and not z)
    true = np.array([[sum(n for n, _, _ in texts) - tagged - left, tagged - both], [left, both]])

    def gradient(x: np.ndarray) -> np.ndarray:
        up = np.stack([np.ones(len(lex)), np.exp(np.clip(x[0] + x[1] * lex + x[2], -30, 30))], 1)
        step = np.exp(x[3:].reshape(2, 2))
        power, taken = _runs(step * [1.0, np.exp(np.clip(x[0], -30, 30))], lengths)
        before, enter, forward, late, ahead = (np.empty((len(lex), 2)) for _ in range(5))
        now = np.tile([1.0, 0.0], (total, 1))
        for low, high in zip(edges, edges[1:]):
            before[low:high] = some = now[: high - low]
            enter[low:high] = mid = (some[:, None] @ power[gap_at[low:high]])[:, 0]
            some = mid @ step * up[low:high]
            forward[low:high] = now[: high - low] = some / some.sum(1, keepdims=True)
        after = power[tail_at].sum(2)
        for low, high in zip(edges[-2::-1], edges[:0:-1]):
            late[low:high] = some = after[: high - low]
            some = (up[low:high] * some) @ step.T
            ahead[low:high] = some = some / some.sum(1, keepdims=True)
            some = (power[gap_at[low:high]] @ some[:, :, None])[:, :, 0]
            after[: high - low] = some / some.sum(1, keepdims=True)
        expected = forward * late
        off = expected[:, 1] / expected.sum(1) - tag
        joint = enter[:, :, None] * step * (up * late)[:, None, :]
        inside = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        plain = np.zeros((2, 2))
        for start, which, stop in ((before, gap_at, ahead), (now, tail_at, np.ones((total, 2)))):
            some = np.einsum("ti,tabij,tj->tab", start, taken[which], stop)
            plain += (some / np.einsum("ti,tij,tj->t", start, power[which], stop)[:, None, None]).sum(0)
        return np.r_[off.sum() + plain[:, 1].sum(), (off * lex).sum(), off.sum(), (inside + plain - true).ravel()] / total + 0.01 * x

    return gradient


def _train(model: Field, texts: list[tuple[str, int]], rate: float) -> Field:
    """Likelihood of the tags over all sample documents at once, then the document's logistic."""
    seen = [(model.hits(text), toxic) for text, toxic in texts]
    seen = [((n, hits), toxic) for (n, hits), toxic in seen if n]
    if len({toxic for _, toxic in seen}) < 2:
        return Field()
    gradient = tag_gradient([(n, hits, toxic) for (n, hits), toxic in seen])
    x = _descend(gradient, np.r_[-4.0, 0.2, 1.0, np.zeros(4)], 40, 0.25)
    model.weights, model.moves = x[:3], x[3:].reshape(2, 2)
    rows = [(model.marginals(n, hits), toxic) for (n, hits), toxic in seen]
    inputs = np.array([[1.0, p.max() if len(p) else 0.0, np.log1p(p.sum())] for p, _ in rows])
    y = np.array([toxic for _, toxic in rows], float)
    # the sample has as many toxic documents as clean ones; weights bring back the true share
    weight = np.where(y > 0, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))

    def slope(z: np.ndarray) -> np.ndarray:
        return ((1 / (1 + np.exp(-inputs @ z)) - y) * weight) @ inputs / len(y) + 0.001 * np.r_[0, z[1:]]

    model.document = _descend(slope, np.array([-2.0, 2.0, 1.0]), 400, 0.1)
    return model


def _count(batches):
    toxic, clean = Counter(), Counter()

    def out():
        names = list(dict.fromkeys([*toxic, *clean]))
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.record_batch({"feature": pa.array(part), "toxic": pa.array([toxic[x] for x in part], pa.int64()), "clean": pa.array([clean[x] for x in part], pa.int64())})

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update({f for w in {w.lower() for w in TOKEN.findall(text.as_py() or "")} for f in features(w)})
            if len(toxic) + len(clean) > FLUSH_FEATURES:
                yield from out()
                toxic.clear()
                clean.clear()
    yield from out()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        held_out_modulus: int = 4, held_out: int = 2, min_count: int = 3, min_share: float = 0.005, min_odds: float = 2.5) -> Field:
    """Lexicon from all training documents, field from a bounded sample of them.

    Training documents have a label and ``crc32(id) % held_out_modulus`` other than ``held_out``; each
    row of them counts, copies too. A lexicon feature is in ``min_count``
    toxic documents and a ``min_share`` of them, at log odds of ``min_odds`` or more; the first
    ``LEXICON`` of these are taken. The sample has the first ``SAMPLE_DOCS`` / 2 documents of each
    class by hash, among those with a word, whole and of any length, up to ``SAMPLE_CHARS`` together. Null ids, null labels and
    labels without a document teach nothing; of several labels of an id the highest counts; without
    both classes every text scores low.
    """
    marks = (
        labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id"))
        .agg((F.max(toxic) > 0).cast("int").alias("toxic")).where(F.crc32(F.col("id").cast("string")) % held_out_modulus != held_out)
    )
    marks = broadcast_if_small(written(marks, "labels"))
    rows = in_small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(marks, "id"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Field()
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    lexicon = (
        rows.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= max(min_count, min_share * n_toxic)).select("feature", F.round(odds, 6).alias("odds")).where(F.col("odds") >= min_odds)
        .orderBy(F.desc("odds"), "feature").limit(LEXICON).collect()
    )
    return _train(Field({r.feature: r.odds for r in lexicon}), _sample(rows), n_toxic / (n_toxic + n_clean))


def _sample(rows: DataFrame) -> list[tuple[str, int]]:
    """Whole texts of the first documents of each class by hash, ``SAMPLE_CHARS`` or one document at most.

    Ids and lengths are chosen first; only the texts of those chosen go to the driver.
    """
    worded = rows.where(F.col("text").rlike(r"(?U)\w"))
    order, chosen = F.xxhash64(F.col("id").cast("string")), []
    for mark in (0, 1):
        first = worded.where(F.col("toxic") == mark).select("id", F.length("text").alias("n"), order.alias("h")).orderBy("h", "id").limit(SAMPLE_DOCS // 2).collect()
        total = np.cumsum([r["n"] for r in first])
        chosen += [(r["id"], place) for place, (r, t) in enumerate(zip(first, total)) if not place or t <= SAMPLE_CHARS // 2]
    ids = dict(chosen)
    kind = rows.schema["id"].dataType.simpleString()
    texts = worded.join(F.broadcast(rows.sparkSession.createDataFrame(list(ids.items()), f"id {kind}, place int")), "id")
    texts = texts.groupBy("id", "toxic", "place").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["toxic"]) for r in sorted(texts, key=lambda r: (r["toxic"], r["place"]))]


def score(docs: DataFrame, model: Field, doc_id: str = "doc_id", text: str = "text", min_marginal: float = 0.5) -> DataFrame:
    """``(id, score, spans)`` per row of ``docs``; ``spans`` has start, end (code points) and probability of toxic tokens.

    Whole texts are read. Null and empty texts have no spans and the score of a text without
    toxic words; repeated rows and null ids get a row each; other columns are not read.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column("text"):
                n, hits = model.hits(value.as_py() or "")
                p = model.marginals(n, hits)
                scores.append(model.score(p))
                spans.append([{"start": h[1], "end": h[2], "probability": float(x)} for h, x in zip(hits, p) if x >= min_marginal])
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, kind)})

    rows = in_small_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, score double, spans array<struct<start: int, end: int, probability: double>>")


def without_toxic(docs: DataFrame, model: Field, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores below ``threshold``.

    Null and empty texts score as texts without toxic words; each repeated row is judged for itself;
    columns may have any name (they are numbered on the way through Python).
    """
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = []
            for value in batch.column(at):
                n, hits = model.hits(value.as_py() or "")
                keep.append(model.score(model.marginals(n, hits)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = in_small_batches(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))))
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
