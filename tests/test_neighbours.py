import numpy as np
import pytest

from postloom.operators import neighbours
from postloom.operators.neighbours import (
    _nearest, pair_gaps, boxes_within, connected, cut_space, density_cluster, distance_blocks, home_of, knn_graph, within_blocks,
)


def points(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def clumps(seed, n=240, d=3, copies=60):
    rnd = np.random.default_rng(seed)
    centres = rnd.uniform(0, 1, (6, d))
    x = centres[rnd.integers(0, 6, n)] + rnd.normal(0, 0.03, (n, d))
    x = np.vstack([x, rnd.uniform(-1, 2, (20, d)), np.repeat(x[:1], copies, axis=0)])
    return x[rnd.permutation(len(x))]


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("leaf_rows", [10_000, 20])
def test_knn_against_all_pairs(spark, leaf_rows):
    x, k = clumps(1), 7
    dist = distances(x)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in knn_graph(points(spark, x), k, leaf_rows).collect()}
    assert len(got) == len(x) * k
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), dist[i])) if j != i][:k]
        for rank, j in enumerate(order, 1):
            n, gap = got[i, rank]
            assert gap == pytest.approx(dist[i, j], abs=1e-12)
            assert n == j or dist[i, n] == pytest.approx(dist[i, j], abs=1e-12)


def test_fewer_points_than_neighbours(spark):
    rows = knn_graph(points(spark, np.array([[0.0], [1.0], [1.0]])), 5).orderBy("id", "rank").collect()
    assert [(r.id, r.neighbour) for r in rows] == [(0, 1), (0, 2), (1, 2), (1, 0), (2, 1), (2, 0)]


def brute_clusters(x, size, samples, eps):
    near = distances(x) <= eps
    core = near.sum(axis=1) - 1 >= samples
    label = np.arange(len(x))
    changed = True
    while changed:
        best = np.array([label[near[i] & core].min() if core[i] else -1 for i in range(len(x))])
        changed = bool((best[core] != label[core]).any())
        label[core] = best[core]
    out = {}
    for i in range(len(x)):
        out[i] = int(label[i]) if core[i] and (label[core] == label[i]).sum() >= size else None
    return out


@pytest.mark.parametrize("leaf_rows,eps", [(10_000, 0.08), (25, 0.08), (25, 0.3), (10, 5.0), (25, 0.01)])
def test_clusters_against_all_pairs(spark, leaf_rows, eps):
    x = clumps(2)
    got = {r.id: r.component for r in density_cluster(points(spark, x), 20, 8, eps, leaf_rows).collect()}
    assert got == brute_clusters(x, 20, 8, eps)


def test_boxes_cover_space():
    x = clumps(3)
    t = cut_space(x, 16)
    home = home_of(t, x)
    assert t.n == 16 and (x >= t.low[home]).all() and (x <= t.high[home]).all()
    rows, leaves = boxes_within(t, x, np.full(len(x), 0.2))
    found = set(zip(rows.tolist(), leaves.tolist()))
    near = distances(x) <= 0.2
    assert all((i, int(home[j])) in found for i, j in zip(*np.nonzero(near)))


def test_connected_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame(chain + star + [(5000, 5001)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1200))
    assert got[5001] == 5000 and len(got) == 201 + 200 + 2


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-6, 0.0), (1.0, 1e7), (1e160, 0.0)])
def test_products_decide_as_sums_do(scale, shift):
    rnd = np.random.default_rng(5)
    a, b = (np.round(rnd.normal(0, 1, (n, 6)), 1) * scale + shift for n in (300, 170))
    gaps = np.concatenate([block for _, block in distance_blocks(a, b)])
    i, j = (x.ravel() for x in np.indices(gaps.shape))
    assert (pair_gaps(a, b, i, j) == gaps.ravel()).all()
    for epsilon in (gaps[3, 5], gaps.min(), gaps.max(), 2.5 * scale):
        assert (np.concatenate([block for _, block in within_blocks(a, b, epsilon)]) == (gaps <= epsilon)).all()
    ids = [[2 * x, 2 * x + 1] for x in range(len(b))]
    reach = np.where(np.arange(300) % 3 == 0, np.inf, np.median(gaps))
    for row, (found, dist) in enumerate(_nearest(a, reach, b, ids, 7)):
        near = sorted((g, x) for g, pair in zip(gaps[row], ids, strict=True) for x in pair if g <= reach[row])[:8]
        assert list(zip(dist, found, strict=True)) == near


def test_leaves_and_what_a_task_sends_stay_bounded(spark, monkeypatch):
    x = np.random.default_rng(6).normal(0, 1, (400, 12))
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    leaves, batch = neighbours._plan(points(spark, x).withColumnRenamed("id", "rep"), 4)
    assert leaves.n == 16 and batch >= 100
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    assert neighbours._plan(points(spark, x).withColumnRenamed("id", "rep"), 4)[0].n == 50


def test_copies_travel_in_rounds(spark, monkeypatch):
    """A round sends no more copies than a share of the points, and later rounds ask within what earlier ones found."""
    x = np.random.default_rng(5).standard_normal((600, 6))
    df = points(spark, x)
    rows = lambda g: sorted(tuple(r) for r in g.collect())
    asked, sent, real, met = [], [], neighbours._asked, neighbours._met
    monkeypatch.setattr(neighbours, "_asked", lambda *a: (asked.append(real(*a)), asked[-1])[1])

    def watch(queries, route, homes, fn, schema, batch_rows, leaves):
        sent.append(sum(real(queries, route).get(leaf, 0) for leaf in leaves))
        return met(queries, route, homes, fn, schema, batch_rows, leaves)

    monkeypatch.setattr(neighbours, "_met", watch)
    want = rows(neighbours.knn_graph(df, 4, leaf_rows=50))
    cluster = rows(neighbours.density_cluster(df, 5, 3, 1.2, leaf_rows=50))
    assert len(sent) <= 3  # one round each
    sent.clear(), asked.clear()
    monkeypatch.setattr(neighbours, "ROUND_SHARE", 1)
    monkeypatch.setattr(neighbours, "ROUND_ROWS", 1)
    assert rows(neighbours.knn_graph(df, 4, leaf_rows=50)) == want
    assert len(sent) > 2 and max(sent) <= 600 and sum(sent) < sum(asked[0].values())
    assert rows(neighbours.density_cluster(df, 5, 3, 1.2, leaf_rows=50)) == cluster
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :4]
    assert np.allclose(near.ravel(), [r[3] for r in want])
