import re
from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm.filter_audit import audit, cells

DOCS, LABELS = "doc_id bigint, text string, source string, mask int, n int, good string", "doc_id bigint, quality int, toxic int, part string"


def failed(rows):
    """The letters that each document fails."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
                 doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)]
        out.append("".join(x for x, f in zip("ABCDE", fails, strict=True) if f))
    return out


def brute(rows, labels):
    """Every order walked document by document."""
    masks = failed(rows)
    marked = lambda doc, at: doc is not None and any(r[0] == doc and r[at] == 1 for r in labels)
    out = Counter()
    removed_by = Counter()
    for (doc, _, source), mask in zip(rows, masks, strict=True):
        part = source or ""
        for order in map("".join, permutations("ABCDE")):
            alive = True
            for step, letter in enumerate(order, 1):
                fails, key = letter in mask, (part, order, step)
                out[key, "unique_fails"] += mask == letter
                out[key, "redundant"] += fails and not alive
                out[key, "removed"] += fails and alive
                out[key, "good_lost"] += fails and alive and marked(doc, 1)
                out[key, "toxic_lost"] += fails and alive and marked(doc, 2)
                removed_by[part, letter] += fails and alive
                alive = alive and not fails
                out[key, "kept"] += alive
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((*key, *(out[key, c] for c in names), removed_by[key[0], key[1][key[2] - 1]]) for key in {k for k, _ in out})


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS)
    known = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    return sorted(tuple(r) for r in audit(docs, known).collect())


def rows():
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [prose, prose + " $", prose.upper(), "short", "Short *", "", None, " ".join(["same"] * 80), "A|B " * 60, prose + "\n# x", " " * 60, "ÄÖÜ " + prose]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(100 + i, t, "s1") for i, t in enumerate(texts[:6])]  # copies in another part
    out += [(3, "short", "s0"), (3, "short", "s0"), (None, prose, None), (None, "short", ""), (3, "another text", "s2"), (-5, "short", "s9"), (200, "long " * 50_000, "s2")]
    return out


LABELLED = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (100, None, 1), (102, 1, None), (None, 1, 1), (999, 1, 1), (7, 1, 0)]


def test_same_as_walking_every_order(spark):
    got = run(spark, rows(), LABELLED)
    assert got == brute(rows(), LABELLED) and len(got) == 600 * len({r[2] or "" for r in rows()})


def test_no_rows_and_no_labels(spark):
    assert run(spark, [], []) == [] and run(spark, [], LABELLED) == []
    assert run(spark, rows()[:4], []) == brute(rows()[:4], [])


def test_cells_are_few_and_hold_all(spark):
    many = [(i, "copy", "hot") for i in range(500)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in many], DOCS)
    known = spark.createDataFrame([(1, 1, 1, "x"), (0, 1, 0, "x")], LABELS)
    assert sorted(tuple(r) for r in cells(docs, known).collect()) == [("hot", 1, 1, 1, 0), ("hot", 17, 499, 1, 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 6), st.sampled_from([None, "", "A B", "x", "a $", "Z" * 60]), st.sampled_from([None, "", "p"])), max_size=12))
def test_any_rows(spark, drawn):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None)]
    assert run(spark, drawn, labels) == brute(drawn, labels)
