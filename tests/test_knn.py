import numpy as np
import pytest
from pyspark.sql import functions as F

from stillgood.operators import knn
from stillgood.operators.knn import knn_join, nearest_one, probe_depth


def clustered(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = centres[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, dims))
    rows[: n // 3] = rows[0]  # a third are copies of one vector
    return rows


def brute(requests, entries, k, skip=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(requests) @ unit(entries).T, 6)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((-s, j) for j, s in enumerate(row) if skip is None or j != skip[i])
        out[i] = [(j, -s) for s, j in order[:k]]
    return out


def frames(spark, requests, entries, skip=False):
    req = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(requests)], "req_id long, embedding array<double>")
    if skip:
        req = req.withColumn("skip_key", F.col("req_id"))
    ent = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(entries)], "entry_key long, embedding array<double>")
    return req, ent


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.req_id, r["rank"])):
        out.setdefault(r.req_id, []).append((r.entry_key, r.similarity))
    return out


@pytest.mark.parametrize("method, options", [("broadcast", {}), ("broadcast", {"tile_rows": 7}), ("cells", {"tile_rows": 20}), ("auto", {"max_broadcast_bytes": 100})])
def test_exact_methods_agree_with_brute_force(spark, method, options):
    vectors = clustered(150)
    req, ent = frames(spark, vectors, vectors, skip=True)
    got = collected(knn_join(req, ent, 4, method, **options))
    want = brute(vectors, vectors, 4, skip=range(150))
    assert got.keys() == want.keys()
    for i in want:
        assert [k for k, _ in got[i]] == [k for k, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-6)


@pytest.mark.parametrize("method", ["broadcast", "cells", "probes"])
def test_small_and_empty_tables(spark, method):
    vectors = clustered(3)
    req, ent = frames(spark, vectors, vectors)
    assert all(len(v) == 3 for v in collected(knn_join(req, ent, 5, method)).values())
    assert knn_join(req, ent.filter("false"), 5, method).count() == 0
    assert knn_join(req.filter("false"), ent, 5, method).count() == 0


def test_probing_finds_clustered_neighbours(spark):
    vectors = clustered(200, seed=2)
    req, ent = frames(spark, vectors, vectors)
    got, want = collected(knn_join(req, ent, 3, "probes", nprobe=4)), brute(vectors, vectors, 3)
    found = sum(len({k for k, _ in got[i]} & {k for k, _ in want[i]}) for i in want)
    assert found / (3 * len(want)) > 0.9


def test_floor_keeps_equality(spark):
    req, ent = frames(spark, np.array([[1.0, 0.0]]), np.array([[3.0, 4.0]]))
    assert nearest_one(req, ent, 0.6).count() == 1
    assert nearest_one(req, ent, 0.600001).count() == 0


def test_broadcast_refuses_what_does_not_fit(spark):
    req, ent = frames(spark, clustered(10), clustered(10))
    with pytest.raises(ValueError):
        knn_join(req, ent, 1, "broadcast", max_broadcast_bytes=64)


def test_depth_is_the_first_that_holds_the_share():
    assert probe_depth({0: 100}, 100, 0.9) == 1
    assert probe_depth({0: 95, 1: 3, 2: 2}, 100, 0.9) == 1
    assert probe_depth({0: 91, 1: 5, 2: 4}, 100, 0.9) == 2  # 0.91 is within the error of 0.9
    assert probe_depth({0: 50, 7: 50}, 100, 0.9) == 8
    assert probe_depth({}, 0, 0.9) == 1


@pytest.mark.parametrize("target, every", [(0.9, 1), (0.9, 10), (0.9, 1000), (1.0, 10)])
def test_recall_target_is_reached(spark, target, every):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(500, 12))  # no clusters: neighbours lie in many cells
    req, ent = frames(spark, vectors, vectors, skip=True)
    got = collected(knn_join(req, ent, 5, "probes", target_recall=target, measured=F.col("req_id") % every == 0))
    want = brute(vectors, vectors, 5, skip=range(500))
    found = sum(len({k for k, _ in got[i]} & {k for k, _ in want[i]}) for i in want)
    assert found >= target * 5 * len(want)


def test_a_request_is_sent_once_to_neighbouring_cells(spark):
    vectors = np.random.default_rng(3).normal(size=(120, 12))
    req, ent = frames(spark, vectors, vectors, skip=True)
    cells = knn._Cells(knn._requests(req), knn._entries(ent), 5, 8192, 16)
    sent = cells._probe(cells.req, lambda part, names, angle: np.ones(angle.shape, bool)).collect()
    assert len(cells.stats) > 1 and len(sent) == 120
    assert all(sorted(r.cells) == sorted(cells.stats) for r in sent)


def test_near_ties_are_settled_in_double_precision():
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    entries = unit(base + 2e-3 * rng.normal(size=(700, 16)))
    requests, skip = unit(base + 2e-3 * rng.normal(size=(40, 16))), np.arange(40)
    best = knn._Best(requests, skip, 5, 700)
    for part in np.array_split(rng.permutation(700), 6):
        best.meet(entries[np.sort(part)], np.sort(part))
    position, scaled, found = best.found()
    exact = np.rint(np.einsum("ij,kj->ik", requests, entries) * knn.SCALE).astype(int)
    exact[np.arange(40), skip] = -knn.SCALE - 1
    want = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    assert found.all() and (scaled == np.take_along_axis(exact, want, axis=1)).all() and (position == want).all()
