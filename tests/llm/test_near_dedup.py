import random
import re

from postloom.llm import near_dedup
from postloom.llm.near_dedup import near_duplicates, sketch_limit

SCHEMA = "doc_id bigint, text string, n string, node int, comp int"


def brute(rows):
    """{row: (n_shingles, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def answers(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "t", "n_shingles", "component_id", "kept"]
    out = got.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_near_copies_against_all_pairs(spark, monkeypatch):
    # Small blocks, so that hot buckets are dealt to several groups.
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "FAN", 4)
    rnd = random.Random(3)
    word = lambda: "w%d" % rnd.randrange(400)
    base = [word() for _ in range(160)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):  # similarities on both sides of the threshold
            w[rnd.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(40)]
    rows += [(2000 + i, rows[0][1].upper()) for i in range(30)]  # a group of copies
    assert answers(spark, rows) == brute(rows)


def test_nulls_blanks_short_texts_and_repeats(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a"), (7, "b a"), (None, "a b c d e f"), (8, "a b c d e f"), (None, None),
        (9, "one and the same"), (9, "one and the same"), (9, "another text of the same id here"), (10, "x" * 50_000 + " " + "y z " * 30_000),
        (11, "x" * 50_000 + " " + "y z " * 30_001), (None, "only nulls have this text"), (None, "only nulls have this text"),
    ]
    want = [(d, n, d if n == 0 else c) for d, n, c in brute(rows)]
    assert answers(spark, rows) == sorted(want, key=str)
    assert answers(spark, []) == []


def test_sketch_limit_lets_the_threshold_pass():
    # Half of 256 samples differ in two places each at 0.5, a quarter at 0.75.
    assert sketch_limit(0.75) > 512 * (1 - (1 - 2 / 1024) ** 128)
    assert sketch_limit(0.75) < 512 * (1 - (1 - 2 / 1024) ** 256)
