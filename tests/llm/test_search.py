"""Graph search against brute force."""

import math

import numpy as np
import pytest

from limpid.llm import graph_search as G


def slow_nearest(rows, k=5):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, a in good:
        if q % 50 == 0:
            near = sorted({(-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in good if i != q and len(b) == len(a)})
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(50, rows[50][1])] * 2      # copies, and a repeated row
    rows += [(150, rows[7][1]), (200, None), (250, [0.0] * 4), (300, [1.0, None, 2.0, 3.0]), (350, [float("nan"), 1.0, 1.0, 1.0]),
             (400, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, []), (550, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id bigint, embedding array<float>, shard int, members string")
    got = {}
    for r in G.nearest(frame.where("vec_id % 50 = 0"), G.build_index(frame, shard_rows=25), block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = slow_nearest(rows)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, len(near) + 1))
        assert [(x[1], pytest.approx(x[2], abs=1e-12)) for x in near] == want[q]
    empty = frame.where("false")
    index = G.build_index(frame, shard_rows=25)
    assert G.nearest(empty, index).count() == 0
    assert G.nearest(frame, G.build_index(empty)).count() == 0


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    want = slow_nearest([tuple(r) for r in rows])
    got = {}
    for r in G.op6_vector_search(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) / (5 * len(want)) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_small_graphs_are_whole(n):
    units = G.unit_rows(np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32))
    order, layers = G.build_graph(units)
    assert sorted(order.tolist()) == list(range(n)) and len(layers[0]) == n
    nodes, score = G.search_graph(units[order], layers, units, 16)
    assert (order[nodes[:, 0]] == np.arange(n)).mean() > 0.98
    assert (np.diff(np.where(np.isfinite(score), score, -9), axis=1) <= 1e-6).all()


def test_clustered_vectors_stay_reachable():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = (np.repeat(centres, 60, axis=0) + 0.01 * rng.normal(size=(1800, 16))).astype(np.float32)
    units = G.unit_rows(vectors)
    order, layers = G.build_graph(units)
    nodes, _ = G.search_graph(units[order], layers, units[::10], 64)
    best = np.argsort(-(units[::10] @ units.T), axis=1)[:, :5]
    found = [len(set(order[a[a >= 0][:5]].tolist()) & set(b.tolist())) / 5 for a, b in zip(nodes, best)]
    assert np.mean(found) >= 0.9


def test_every_found_node_is_scored_exactly(spark):
    """Many vectors of nearly one direction: neighbours and ties are those of double precision."""
    rng = np.random.default_rng(8)
    one = rng.normal(size=6).astype(np.float32)
    rows = [(i, (one * np.float32(2.0 ** (i % 30))).tolist()) for i in range(0, 30)]
    rows += [(1000 + i, np.nextafter(one, np.float32(9) * rng.choice([-1, 1], 6).astype(np.float32)).tolist()) for i in range(40)]
    rows += [(2001 + i, rng.normal(size=6).tolist()) for i in range(100)] + [(50 * k, (one * np.float32(3 + k)).tolist()) for k in range(1, 6)]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[i] for i in order], "vec_id bigint, embedding array<float>")
    got = {}
    for r in G.nearest(frame.where("vec_id % 50 = 0"), G.build_index(frame)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(pytest.approx(r.score, abs=1e-15))
    want = slow_nearest(rows)
    assert {q: [s for _, s in near] for q, near in want.items()} == got


def test_recall_over_shards_of_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    vectors = (centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = G.build_index(frame, shard_rows=700)
    assert index.count() == 5
    got = {}
    for r in G.nearest(frame.where("vec_id % 50 = 0"), index).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = slow_nearest(rows)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) / (5 * len(want)) >= 0.95
