"""Merges of topics beside merging pair after pair."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest

from postloom.operators import topics
from postloom.operators.topics import (
    class_tfidf, document_term_parts, document_terms, gram_counts, gram_id, gram_ids, ngrams, representative_docs, topic_hierarchy, topic_similarity, topic_terms, topic_tokens,
)
from postloom.session import settle, written
from pyspark.sql import functions as F


def sequential(pairs):
    s = {frozenset(p[:2]): p[2] for p in pairs}
    groups = {t: [t] for p in pairs for t in p[:2]}
    out = []
    while True:
        mean = lambda a, b: sum(s.get(frozenset((x, y)), 0.0) for x in groups[a] for y in groups[b]) / (len(groups[a]) * len(groups[b]))
        ranked = sorted((-mean(a, b), a, b) for a in groups for b in groups if a < b)
        if not ranked or ranked[0][0] >= 0:
            return sorted(out)
        m, a, b = ranked[0]
        groups[a] += groups.pop(b)
        out.append((a, b, pytest.approx(-m), len(groups[a])))


def test_rounds_merge_as_pair_after_pair(spark):
    rnd = np.random.default_rng(8)
    pairs = [(a, b, float(rnd.random())) for a in range(9) for b in range(a + 1, 9) if rnd.random() < 0.4] + [(100, 101, 0.5)]
    df = spark.createDataFrame(pairs, "topic_a int, topic_b int, similarity double")
    for local in (0, 12, 10**6):  # rounds only, rounds and then one place, one place only
        assert sorted(tuple(r) for r in topic_hierarchy(df, local).collect()) == sequential(pairs)
    assert topic_hierarchy(df.limit(0)).count() == 0


def test_numbers_are_equal_where_texts_are(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["a"],), ([],), (["ab", "a"],)], "t array<string>")
    rows = df.select(ngrams(F.col("t"), 1, 3).alias("x"), gram_ids(F.col("t"), 1, 3).alias("y")).collect()
    met = {}
    for r in rows:
        assert len(r.x) == len(r.y)
        for x, y in zip(r.x, r.y, strict=True):
            assert met.setdefault(x, y) == y
    assert len(set(met.values())) == len(met)


def test_number_of_a_text(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["a1"],), ([],)], "t array<string>")
    for r in df.select(F.transform(ngrams(F.col("t"), 1, 3), gram_id).alias("x"), gram_ids(F.col("t"), 1, 3).alias("y")).collect():
        assert r.x == r.y


DOCS = [(1, 0, "red blue red"), (2, 0, "blue green"), (3, 1, "red red grey"), (4, 2, "green grey"), (4, 2, "green grey"), (5, None, "blue grey"), (6, 1, None), (7, -1, "")]


def brute_weights(docs, low, high):
    tf = Counter((t, " ".join(w[i : i + n])) for _, t, text in docs for w in [(text or "").split()] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    topics = {t for _, t, _ in docs if t is not None}
    df, f = Counter(g for _, g in tf), Counter()
    tf = {k: v for k, v in tf.items() if low * len(topics) <= df[k[1]] <= high * len(topics)}
    for (_, g), v in tf.items():
        f[g] += v
    size = Counter()
    for (t, _), v in tf.items():
        size[t] += v
    average = math.floor(sum(size.values()) / len(size))
    return {(t, g): (v, pytest.approx(v / size[t] * math.log(1 + average / f[g]))) for (t, g), v in tf.items() if t is not None}


@pytest.mark.parametrize("ids", [False, True])
def test_terms_are_shuffled_once(spark, ids):
    docs = spark.createDataFrame(DOCS, "doc_id int, topic int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    terms = topic_terms(docs, min_df=0.25, max_df=0.5, stop_words=[], ids=ids)
    assert len(re.findall(r"hashpartitioning\([^)]*\bterm#", plan(terms))) == 1
    weights = class_tfidf(terms)
    assert "hashpartitioning" not in plan(weights) and "Generate" not in plan(weights)
    rows = weights.collect()
    assert weights.columns == ["topic", "term", "tf", "weight"]
    want = brute_weights(DOCS, 0.25, 0.5)
    if not ids:
        assert {(r.topic, r.term): (r.tf, r.weight) for r in rows} == want
    assert len(rows) == len(want)
    assert sum(r.tf for r in rows) == sum(tf for tf, _ in want.values())


def test_no_terms_have_no_weights(spark):
    docs = spark.createDataFrame([], "doc_id int, topic int, text string")
    weights = class_tfidf(topic_terms(docs))
    assert weights.count() == 0
    assert topic_similarity(weights).count() == 0


ODD = [
    (1, 0, "The Caf\u00e9 \u212aelvin \u0130stanbul x-ray's\x0b\u00a0tail a b2b  C3PO\tC3PO C3PO"),
    (2, 0, "red\u2028blue RED, blue; red... blue\r\n\x1cgreen \x85 \u3000 z"),
    (3, 1, None),
    (4, 1, ""),
    (5, None, "the the the and"),
    (6, 1, " ".join(f"w{i % 7} blue" for i in range(50))),
    (6, 1, " ".join(f"w{i % 7} blue" for i in range(50))),
    (7, 2, "single"),
]


@pytest.mark.parametrize("n", [(1, 3), (2, 2), (1, 1), (1, 25)])
def test_runs_counted_as_numbers_are_the_runs_of_the_tokens(spark, n):
    docs = spark.createDataFrame(ODD, "doc_id int, topic int, text string").coalesce(1)
    tokens = docs.select("doc_id", "topic", ngrams(topic_tokens(F.col("text"), ["the", "and"]), *n).alias("g"))
    want = sorted(Counter((r.doc_id, r.topic, g) for r in tokens.collect() for g in r.g).items(), key=str)
    for parts in (1, 3):
        got = Counter()
        for p in range(parts):
            for r in gram_counts(docs, ["doc_id", "topic"], n, ["the", "and"], p, parts).collect():
                got[(r.doc_id, r.topic, r.term)] += r.tf
        assert sorted(got.items(), key=str) == want != []


def test_terms_in_passes(spark, monkeypatch):
    """Long texts are read in passes of which each has terms of its own, and nothing else changes."""
    docs = spark.createDataFrame(ODD, "doc_id int, topic int, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    whole = topic_terms(docs, max_df=1.0, stop_words=[])
    weights = class_tfidf(whole)
    best = rows(representative_docs(document_terms(docs, stop_words=[]), weights))
    alike = lambda w: {(r.topic_a, r.topic_b): pytest.approx(r.similarity) for r in topic_similarity(w).collect()}
    assert alike(class_tfidf(topic_terms(docs, max_df=1.0, stop_words=[], totals=True), totals=True)) == alike(weights) != {}
    monkeypatch.setattr(topics, "PASS_CHARS", 100)
    assert topics.passes(docs) == topics.MOST_PASSES
    parts = topic_terms(docs, max_df=1.0, stop_words=[])
    assert "hashpartitioning" not in parts._jdf.queryExecution().executedPlan().toString()
    assert rows(parts) == rows(whole) != []
    assert rows(class_tfidf(topic_terms(docs, max_df=1.0, stop_words=[], totals=True))) == rows(weights)
    pieces = document_term_parts(docs, stop_words=[])
    assert len(pieces) == topics.MOST_PASSES
    assert rows(representative_docs(pieces, weights)) == best != []


def test_shuffles_go_when_rows_are_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    rows = written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 10).alias("g")).count(), "counts")
    again = settle(rows.repartition(3, "g"))
    for _ in range(50):  # they go in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert rows.count() == again.count() == 10
