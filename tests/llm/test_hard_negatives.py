from itertools import groupby

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.llm.hard_negatives import labelled, mine, quantised, scores, stream, window

SCHEMA = "vec_id bigint, label int, v array<bigint>, score string, block int, tag string"
LIMIT = (1 << 63) - 1


def brute(rows, anchors, k=5, n=3, low=50, high=95):
    """All pairs with whole numbers."""
    out = []
    usable = lambda r: r[0] is not None and r[1] is not None and r[2] and all(x is not None for x in r[2])
    unique = lambda rs: list({(i, label, tuple(v)): (i, label, v) for i, label, v in rs if usable((i, label, v))}.values())
    rows = unique(rows)
    for a, label, v in unique(anchors):
        dot = lambda x: max(-LIMIT, min(LIMIT, sum(p * q for p, q in zip(v, x, strict=True))))
        met = sorted((-dot(x), i, other == label) for i, other, x in rows if len(x) == len(v) and (i != a or other != label))
        for less, p, _ in [m for m in met if m[2]][:k]:
            fits = [m for m in met if not m[2] and -50 * less <= -100 * m[0] <= -95 * less] if (low, high) == (50, 95) else []
            out += [(a, p, rank, i, -less, -s) for rank, (s, i, _) in enumerate(fits[:n], 1)]
    return sorted(out)


def run(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    asked = spark.createDataFrame([(*r, "x", 1, "y") for r in anchors], SCHEMA)
    return sorted(tuple(r) for r in mine(df, asked, **options).collect())


def test_same_as_all_pairs(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 4)), rnd.integers(-3, 9, 6).tolist()) for i in range(900)]
    got = run(spark, rows, rows[::30], block_rows=128)  # many ties, several blocks
    assert got == brute(rows, rows[::30]) and len(got) > 200


def test_unusable_rows_copies_and_one_label(spark):
    same = [4, 5, 6]
    rows = [(i, 0, same) for i in range(40)] + [(i, 1, [3, 5, 6]) for i in range(40, 80)] + [(80, 1, [2, 4, 5]), (80, 1, [2, 4, 5]), (80, 2, [2, 4, 5])]
    bad = [(None, 0, same), (90, None, same), (91, 0, None), (92, 0, []), (93, 0, [None, 1, 1]), (94, 0, [1, 1])]
    anchors = [rows[0], rows[45], rows[-1], *bad]
    assert run(spark, rows + bad, anchors, block_rows=16) == brute(rows + bad, anchors)
    assert run(spark, rows[:40], rows[:2]) == []  # no other label
    assert run(spark, [], []) == []
    assert run(spark, rows, []) == []


def test_zero_positive_takes_zero_negatives_of_smaller_id(spark):
    rows = [(10, 0, [1, 0]), (20, 0, [0, 7]), (1, 1, [0, 3]), (2, 1, [0, 4]), (3, 2, [0, 9]), (30, 2, [0, 1])]
    assert run(spark, rows, rows[:1]) == [(10, 20, 1, 1, 0, 0), (10, 20, 2, 2, 0, 0), (10, 20, 3, 3, 0, 0)]
    assert run(spark, [(1, 0, [1]), (2, 0, [-4]), (3, 1, [-3])], [(1, 0, [1])]) == []  # no window below a negative score


def test_scores_beyond_doubles_and_beyond_64_bits(spark):
    big = 1 << 40
    rows = [(1, 0, [big, 3]), (2, 0, [big, 5]), (3, 1, [1, 7]), (4, 1, [big // 2, 1]), (5, 0, [big // 2, 9]), (6, 1, [big // 4 + 1, 9])]
    assert run(spark, rows, rows) == brute(rows, rows)
    a = np.array([[1 << 30, -5], [3, 4]])
    assert scores(a, a).tolist() == [[(1 << 60) + 25, 3 * (1 << 30) - 20], [3 * (1 << 30) - 20, 25]]
    huge = np.array([[1 << 62, 1 << 62]])
    assert scores(huge, huge).tolist() == [[LIMIT]] and scores(huge, -huge).tolist() == [[-LIMIT]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 60), st.integers(0, 1), st.integers(0, 30)), max_size=60, unique_by=lambda r: (r[0], r[3])))
def test_stream_opens_windows_in_order(pairs):
    keys = sorted((a, 0, -s, kind, i) for a, s, kind, i in pairs)
    want = []
    for a, own in groupby(keys, key=lambda k: k[0]):
        own = list(own)
        for p in [k for k in own if k[3] == 0]:
            low, high = window(-p[2])
            fits = [k for k in own if k[3] == 1 and low <= -k[2] <= high][:3]
            want += [(a, p[4], n, k[4], -p[2], -k[2]) for n, k in enumerate(fits, 1)]
    assert sorted(stream((k, None) for k in keys)) == sorted(want)


@given(st.integers(-400, 4000), st.integers(-400, 4000))
def test_window_is_the_inequality(p, n):
    low, high = window(p)
    assert (low <= n <= high) == (50 * p <= 100 * n <= 95 * p)


def test_labels_move_and_components_round_down(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, 9, [0.5, -0.001]), (8, 9, [0.999, 1.0]), (14, 2147483647, [1.0]), (9, None, [1.0]), (10, 1, [nan]), (11, 1, [inf]), (12, 1, [None]), (13, 1, None), (15, 1, [3e38])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = {r.vec_id: (r.label, r.v) for r in labelled(df).collect()}
    assert got == {7: (0, [128, -1]), 8: (9, [255, 256]), 14: (8, [256]), 15: (1, [LIMIT])}
    assert df.where("vec_id = 7").select(quantised(F.col("embedding"), 2).alias("v")).head().v == [1, -1]
