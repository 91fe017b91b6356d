"""The registered queries beside their SQL, and the pipeline beside its operators."""

from collections import Counter

import pytest

import corpus_pipeline
from postloom.llm.mixing import mixed_rows
from postloom.llm.near_dedup import near_duplicates
from postloom.llm.queries import QUERIES, SQL
from postloom.llm.toxicity import score, train
from tests.compare import compare, duck
from tests.llm.test_near_dedup import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_beside_its_sql(spark, con, name):
    assert compare(spark, con, SMALL, name, QUERIES[name], SQL[name]) == ""


def test_pipeline_stages(spark):
    """Each stage against what its operator or brute force says of its own input."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SMALL)
    toxic = {r.doc_id for r in score(docs, train(docs, labels)).where("predicted = 1").collect()}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - toxic
    twice = kept.union(kept.limit(5))
    unique = corpus_pipeline.near_dedup(spark, twice, SMALL)
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in rows])}
    found = unique.collect()
    assert unique.columns == docs.columns and sorted(r.doc_id for r in found) == sorted(want)
    masked = corpus_pipeline.secrets(spark, unique, SMALL)
    texts = {r.doc_id: r.text for r in found}
    changed = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and changed.keys() == texts.keys()
    assert all(("[SECRET]" in r.text) or r.text == texts[d] for d, r in changed.items()) and all(r.n_chars == len(r.text) for r in changed.values())
    mixed = corpus_pipeline.mixing(spark, masked, SMALL)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mixed_rows(masked).collect())
    packed = corpus_pipeline.packing(spark, mixed, SMALL).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_pipeline_runs_on_nothing(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (None, "x")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()), key=str) == [(1, "a b c d e f"), (None, "x")]
    assert near_duplicates(docs).count() == 5


def test_groups_leave_one_whatever_their_ids(spark):
    near = lambda n, x: " ".join([*(f"word{i}" for i in range(60)), x] if n else [*(f"other{i}" for i in range(60)), x])
    rows = [(1, near(1, "a"), "x"), (1, near(1, "b"), "x"), (2, near(1, "c"), "x"), (None, near(0, "d"), "x"), (None, near(0, "e"), "x"), (5, None, "x"), (5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, _doc string, _row int")
    found = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert Counter(r.doc_id for r in found) == {1: 1, None: 1, 5: 2} and all(r._doc == "x" and r._row == 3 for r in found)
