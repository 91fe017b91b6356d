import numpy as np
import pytest

from postloom.llm.collision_search import PROJECTIONS, SHARE, THRESHOLD, WIDEN, Block, search

SCHEMA = "vec_id bigint, embedding array<float>, score string, block int"


def nearest(rows, queries, k):
    """{query: [(vec_id, score)]} by all inner products."""
    out = {}
    for q, v in queries:
        v = np.array(v, dtype=np.float32).astype(float)
        scores = [(i, float((np.array(x, dtype=np.float32).astype(float) * v).sum())) for i, x in rows if i != q and len(x) == len(v)]
        out[q] = sorted(scores, key=lambda r: (-r[1], r[0]))[:k]
    return out


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 5 = 0"), k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(3)
    for scale in (1.0, rnd.uniform(0.2, 3.0, size=(700, 1))):  # unit length, and any
        x = rnd.standard_normal((700, 24))
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * scale
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got, want = run(spark, rows, block_rows=200), nearest(rows, rows[::5], 10)
        assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.95 * 10 * len(want)
        exact = {q: dict(nearest(rows, [rows[q]], 700)[q]) for q in list(want)[:20]}
        assert all(abs(s - exact[q][i]) < 1e-12 for q in exact for i, s in got[q])


def test_ties_copies_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(60)] + [(60, [2.0, 4.0, 4.0]), (61, [-1.0, 0.0, 0.0])]
    bad = [(65, None), (70, []), (75, [0.0, 0.0, 0.0]), (80, [nan, 1.0, 1.0]), (85, [1.0, inf, 0.0]), (90, [1.0, None, 1.0]), (None, same)]
    got = run(spark, rows + bad + rows[:10], k=4, block_rows=16)
    want = nearest(rows, [r for r in rows if r[0] % 5 == 0], 4)
    assert got == want  # ties go to the smaller vec_id
    assert run(spark, bad) == {}
    assert run(spark, [(0, same), (1, same)], k=20) == {0: [(1, 9.0)]}  # fewer candidates than asked for
    assert run(spark, [(0, same), (5, [1.0, 1.0])]) == {}  # no vector of the same length
    assert run(spark, []) == {}


@pytest.mark.parametrize("size", [1, 2, 255, 256, 700])
def test_candidates_are_those_in_enough_windows(size):
    """Places of any width; queries that widen more or less than others beside them."""
    rng = np.random.default_rng(size)
    x = rng.standard_normal((size, 8))
    block = Block(np.arange(size), x, 5)
    values = np.empty((PROJECTIONS, size))
    np.put_along_axis(values, block.order, block.sorted, axis=1)
    need = min(size, int(np.ceil(SHARE * size)) + 6)
    queries = rng.standard_normal((20, 8)) * np.exp(rng.standard_normal((20, 1)))
    for q, got in zip(queries, block.candidates(queries), strict=True):
        unit = 2.0 ** -np.frexp(np.abs(x).max())[1]
        assert block.norm == pytest.approx(unit * np.sqrt((x**2).sum(axis=1).max()))
        centre = (q * (block.norm / np.sqrt((q**2).sum()))) @ block.axes[:-1]
        half, found = block.first, np.zeros(size, dtype=bool)
        for times in range(block.start, 200):
            half = block.first * WIDEN**times
            low, high = np.clip(centre - half, block.low, block.high), np.clip(centre + half, block.low, block.high)
            found = ((values >= low[:, None]) & (values <= high[:, None])).sum(axis=0) >= THRESHOLD * PROJECTIONS
            if found.sum() >= need:
                break
        assert got.tolist() == np.flatnonzero(found).tolist()


def test_recall_beside_long_vectors(spark):
    """Norms that differ much, and one vector that is far longer than all others."""
    rnd = np.random.default_rng(11)
    unit = rnd.standard_normal((2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    one = np.ones((2000, 1))
    one[3] = 10.0
    for scale in (one, np.exp(rnd.standard_normal((2000, 1)))):
        rows = [(i, v.tolist()) for i, v in enumerate(unit * scale)]
        asked = rows[::25]
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
        got = {}
        for r in search(df, df.where("vec_id % 25 = 0"), 20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = nearest(rows, asked, 20)
        assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("scale", [1e-170, 1e-300, 1e160, 1e-20])
def test_any_magnitude_ends(spark, scale):
    rnd = np.random.default_rng(2)
    rows = [(i, (v * scale).tolist()) for i, v in enumerate(rnd.standard_normal((60, 5)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = search(df, df.where("vec_id % 20 = 0"), 7, block_rows=30).collect()
    assert len(got) == 3 * 7 and {r.query_id for r in got} == {0, 20, 40}
    if scale == 1e-20:
        want = {q: sorted(((float((np.array(v) * np.array(rows[q][1])).sum()), -i) for i, v in rows if i != q), reverse=True)[:7] for q in (0, 20, 40)}
        assert all({-i for _, i in want[q]} >= {r.vec_id for r in got if r.query_id == q and r["rank"] <= 3} for q in want)
