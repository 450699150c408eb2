"""Ordering, top-k and exact rank cuts without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGN_BIT = -(1 << 63)
MAX_COUNTS = 1 << 17  # histogram rows one refinement pass may send to the driver


def largest_group(df: DataFrame, *keys: str | Column) -> int:
    """Rows in the biggest group: the proof that a per-group window is bounded."""
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


def bin_of(value: Column, width: int) -> Column:
    """Integer bin of a long, floored, without floating-point division error."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("long")


def order_hex(value: Column) -> Column:
    """A long as 16 hex digits whose string order is the numeric order."""
    return F.hex(value.cast("long").bitwiseXOR(F.lit(SIGN_BIT)))


def shuffle_hex(row_id: Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random order: digest of the id and a seed, then the id."""
    digest = F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.concat(F.substring(digest, 1, 15), order_hex(row_id))


@dataclass(frozen=True)
class Cut:
    """The ``rank``-th smallest sort key of a group."""

    group: object
    rank: int
    key: str


def rank_cuts(
    df: DataFrame,
    group: Column,
    sort_key: Column,
    ranks: dict,
    total: int | None = None,
    finish_rows: int = 20_000,
) -> list[Cut]:
    """Find exact order statistics of a string sort key, per group.

    ``ranks`` maps a group value to 1-based ranks.  Each pass counts rows by the
    next few characters below the prefixes still open, so only small histograms
    reach the driver; once the open buckets together hold ``finish_rows`` rows
    or fewer, their keys are sorted directly; ``total`` says so up front.  Keys
    must be unique, of one length, and drawn from hex digits (plus constant
    characters).
    """
    keyed = df.select(group.alias("g"), sort_key.alias("s"))
    open_targets = [(g, r, "", r) for g, rs in ranks.items() for r in rs]
    depth = 0
    while total is None or total > finish_rows or depth:
        prefixes = len({(g, prefix) for g, _, prefix, _ in open_targets})
        chunk = next((d for d in (4, 3, 2) if prefixes * 16**d <= MAX_COUNTS), 1)
        counts = _histogram(keyed, open_targets, depth, depth + chunk)
        stepped, remaining = [], {}
        for g, rank, prefix, left in open_targets:
            for bucket in sorted(counts.get((g, prefix), {})):
                size = counts[(g, prefix)][bucket]
                if left <= size:
                    if not bucket and size > finish_rows:
                        raise ValueError("sort keys repeat; append a unique id to them")
                    stepped.append((g, rank, prefix + bucket, left))
                    remaining[(g, prefix + bucket)] = size
                    break
                left -= size
        open_targets, depth = stepped, depth + chunk
        if sum(remaining.values()) <= finish_rows or all(n == 1 for n in remaining.values()):
            break
    keys = _open_keys(keyed, open_targets, depth)
    return [Cut(g, rank, keys[(g, prefix)][left - 1]) for g, rank, prefix, left in open_targets]


def _open(keyed: DataFrame, targets: list, depth: int) -> DataFrame:
    """Rows under a prefix that is still open, matched by an equi-join."""
    rows = keyed.withColumn("p", F.substring("s", 1, depth))
    if depth == 0:
        wanted = sorted({g for g, *_ in targets}, key=str)
        named = F.col("g").isin([g for g in wanted if g is not None])
        return rows.filter(named | F.col("g").isNull() if None in wanted else named)
    spark = keyed.sparkSession
    schema = f"g {keyed.schema['g'].dataType.simpleString()}, p string"
    prefixes = spark.createDataFrame(sorted({(g, p) for g, _, p, _ in targets}, key=str), schema)
    here = rows["g"].eqNullSafe(prefixes["g"]) & (rows["p"] == prefixes["p"])
    return rows.join(F.broadcast(prefixes), here, "left_semi")


def _histogram(keyed: DataFrame, targets: list, depth: int, end: int) -> dict:
    if not targets:
        return {}
    grouped = (
        _open(keyed, targets, depth)
        .groupBy("g", "p", F.substring("s", depth + 1, end - depth).alias("b"))
        .count()
        .collect()
    )
    out: dict = {}
    for row in grouped:
        out.setdefault((row["g"], row["p"]), {})[row["b"]] = row["count"]
    return out


def _open_keys(keyed: DataFrame, targets: list, depth: int) -> dict:
    if not targets:
        return {}
    out: dict = {}
    for row in _open(keyed, targets, depth).select("g", "p", "s").collect():
        out.setdefault((row["g"], row["p"]), []).append(row["s"])
    return {k: sorted(v) for k, v in out.items()}


def smallest(df: DataFrame, sort_key: Column, n: int, total: int | None = None) -> Column | None:
    """Predicate true for exactly the ``n`` smallest sort keys; None when n <= 0."""
    if n <= 0:
        return None
    cuts = rank_cuts(df, F.lit(0), sort_key, {0: [n]}, total)
    return sort_key <= F.lit(cuts[0].key) if cuts else F.lit(True)


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; the planner prunes per map task before shuffling."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def best_candidate(candidates: DataFrame, req: str = "req_id", score: str = "rerank_score") -> DataFrame:
    """Highest score per request; equal scores keep similarity order (``rank``)."""
    kept = [c for c in candidates.columns if c != req]
    folded = candidates.groupBy(req).agg(
        F.max_by(F.struct(*kept), F.struct(F.col(score), -F.col("rank"))).alias("best")
    )
    return folded.select(req, "best.*")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the one with the smallest ``seq``."""
    return topk(df, keys, [F.col(seq)], 1).drop("rank")


def recent(df: DataFrame, ts: str, row_id: str, n: int = 100) -> DataFrame:
    """Newest ``n`` rows (a per-task heap, never a full sort)."""
    return df.orderBy(F.desc(ts), F.desc(row_id)).limit(n)


def class_counts(df: DataFrame, label: str, max_classes: int = 10_000) -> dict:
    rows = df.groupBy(label).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values; not a class label")
    return {r[label]: r["count"] for r in rows}


def _with_cuts(df: DataFrame, label: str, sort_key: Column, ranks: dict, total: int) -> DataFrame:
    """``df`` with the ascending cuts of its class; rows without a label are a class of their own."""
    per_label: dict = {}
    for cut in rank_cuts(df, F.col(label), sort_key, ranks, total):
        per_label.setdefault(cut.group, []).append(cut.key)
    kind = df.schema[label].dataType.simpleString()
    rows = [(g, sorted(keys)) for g, keys in per_label.items()]
    cuts = df.sparkSession.createDataFrame(rows, f"_class {kind}, cuts array<string>")
    return df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: exactly floor(n_c * test_size + 1/2) rows of each class."""
    key = shuffle_hex(F.col(row_id), seed)
    counts = class_counts(df, label)
    held_out = {g: int(n * test_size + 0.5) for g, n in counts.items()}
    ranks = {g: [n] for g, n in held_out.items() if n >= 1}
    return (
        _with_cuts(df, label, key, ranks, sum(counts.values()))
        .withColumn("is_test", F.coalesce(key <= F.col("cuts")[0], F.lit(False)))
        .drop("cuts")
    )


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Adds ``fold``: per-class fold sizes differ by at most one row."""
    counts = class_counts(df, label)
    key = shuffle_hex(F.col(row_id), seed)
    ranks = {
        g: sorted({-(-n * f // folds) for f in range(1, folds)} - {0, n}) for g, n in counts.items()
    }
    below = F.size(F.filter("cuts", lambda c: c < key))
    return (
        _with_cuts(df, label, key, {g: r for g, r in ranks.items() if r}, sum(counts.values()))
        .withColumn("fold", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(below))
        .drop("cuts")
    )
