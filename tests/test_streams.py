"""Streams over many batches: parts, folds, repeats, and what a batch reads."""

import pytest
from pyspark.sql import functions as F

from postloom.operators.merge import merge_by_link
from postloom.plans.clean import clean_corpus
from postloom.queries import catalog, views
from postloom.session import scratch_path
from postloom.streaming import jobs, parts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("batches", [0, 1, 7, 8, 9, 50, 63, 64, 65, 600])
def test_cover_reads_few_parts(batches):
    there = {(k, n) for k in range(5) for n in range(batches // parts.FAN**k)}
    chosen = parts.cover(there)
    held = [b for k, n in chosen for b in range(n * parts.FAN**k, (n + 1) * parts.FAN**k)]
    assert held == list(range(batches))
    assert len(chosen) <= (parts.FAN - 1) * 4
    if batches:
        before = parts.cover(there, batches - 1)
        assert sum(parts.FAN**k for k, _ in before) == batches - 1


def test_cover_refuses_holes():
    with pytest.raises(ValueError):
        parts.cover({(0, 0), (0, 2)}, 3)
    assert parts.cover({(0, 0), (0, 2)}) == [(0, 0)]


def test_folds_replace_repeat_and_clear(spark):
    """Sums by key over 20 batches, each run twice, with folds of two levels of 3."""
    table = scratch_path(spark, "parts")
    old, parts.FAN = parts.FAN, 3
    try:
        def add(batch):
            rows = spark.createDataFrame([(i, batch) for i in range(3)] + [(batch, 100)], "k bigint, v bigint").coalesce(1)
            before = parts.paths(spark, table, batch)
            assert (spark.read.parquet(*before).agg(F.count_if(F.col("v") < 100)).head()[0] if before else 0) <= 3 * batch
            parts.add(spark, table, batch, rows, lambda p: spark.read.parquet(*p), lambda d: d.groupBy("k").agg(F.max("v").alias("v")), lambda d, p: d.coalesce(1).write.mode("overwrite").parquet(p))

        for batch in range(20):
            add(batch)
            add(batch)
        assert len(parts.paths(spark, table)) <= 2 * 3
        got = {r.k: r.v for r in spark.read.parquet(*parts.paths(spark, table)).groupBy("k").agg(F.max("v").alias("v")).collect()}
        assert got == {k: 100 for k in range(20)}
        assert len([1 for k, _ in parts.complete(spark, table) if k == 0]) < 20  # folded parts go one fold later
    finally:
        parts.FAN = old


def _stream(spark, rows, n):
    """``rows`` dealt into ``n`` files by key, one a batch."""
    path = scratch_path(spark, "src")
    rows.repartitionByRange(n, "row_key").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_merge_over_many_batches(spark):
    posts = views.flat(spark, SF).where("row_key < 400")
    table = scratch_path(spark, "merged")
    old, parts.FAN = parts.FAN, 3
    try:
        jobs.stream_merge(_stream(spark, posts, 11), table, f"{table}/_progress").awaitTermination()
        assert len(parts.paths(spark, f"{table}/picks")) <= 5
        assert sorted(map(tuple, jobs.read_merged(spark, table).collect())) == sorted(map(tuple, merge_by_link(posts).collect()))
    finally:
        parts.FAN = old


def _found(spark, n):
    """``n`` posts of a third as many links, dealt over 8 tasks."""
    rows = [(i, f"run_{i % 4}.csv", f"t{i % 5} | t{i % 7}", f"title {i % 11}", "x" * (i % 13), None, f" l{i % (n // 3)} " if i % 10 else "") for i in range(n)]
    return spark.createDataFrame(rows, "row_key bigint, source_file string, SearchTerm string, Title string, Description string, Qualifications string, Link string").repartition(8)


@pytest.mark.parametrize("batch_bytes, batches", [(None, 3), (1, 24)])
def test_batches_do_not_grow_with_the_files_of_the_writer(spark, monkeypatch, batch_bytes, batches):
    posts = _found(spark, 600)
    if batch_bytes:
        monkeypatch.setattr(catalog, "_BATCH_BYTES", batch_bytes)
    table = scratch_path(spark, "merged")
    src = catalog._arrivals(spark, posts, "posts")
    jobs.stream_merge(src, table, f"{table}/_progress").awaitTermination()
    assert sum(parts.FAN**k for k, _ in parts.cover(parts.complete(spark, f"{table}/picks"))) == batches
    assert sorted(map(tuple, jobs.read_merged(spark, table).collect())) == sorted(map(tuple, merge_by_link(posts).collect()))


def test_merge_writes_no_batch_before_it_is_grouped(spark, monkeypatch):
    def never(df):
        raise AssertionError("a batch was checkpointed")

    monkeypatch.setattr(jobs, "settle", never)
    posts, table = _found(spark, 60), scratch_path(spark, "merged")
    jobs.stream_merge(_stream(spark, posts, 2), table, f"{table}/_progress").awaitTermination()
    assert sorted(map(tuple, jobs.read_merged(spark, table).collect())) == sorted(map(tuple, merge_by_link(posts).collect()))


def test_clean_reads_the_folders_it_names(spark):
    posts = views.flat(spark, SF).where("row_key < 60").select("row_key", "Title", "Description")
    out = scratch_path(spark, "cleaned")
    again = posts.union(posts.withColumn("row_key", F.col("row_key") + 1000))  # every post comes again in later batches
    old, parts.FAN = parts.FAN, 2
    try:
        jobs.stream_clean(_stream(spark, again, 5), out, f"{out}/_progress", views.rule_scores).awaitTermination()
        want = clean_corpus(posts, views.rule_scores)
        assert sorted(map(tuple, jobs.read_cleaned(spark, out).collect())) == sorted(map(tuple, want.collect()))
        every = jobs._read_digests(spark, parts.paths(spark, f"{out}/seen"))
        some = jobs.seen_digests(spark, f"{out}/seen", 4, ["p00", "p01"])
        assert every.count() == every.select("digest").distinct().count()
        assert "PartitionFilters: [prefix" in some._jdf.queryExecution().executedPlan().toString()
        assert {r.prefix for r in some.collect()} <= {"p00", "p01"}
    finally:
        parts.FAN = old
