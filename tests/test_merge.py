import random

from pyspark.sql import functions as F

from postloom.operators import dedupe, merge, sampling, stats, topics
from postloom.schema import POST_COLUMNS
from postloom.session import scratch_path
from postloom.sources import files
from postloom.streaming import jobs

SCHEMA = "source_file string, row_key bigint, " + ", ".join(f"{c} string" for c in POST_COLUMNS)
ROWS = [
    ("b.csv", 1, "Data | BI", "Title b", "short", "x", "L1"),
    ("a.csv", 2, "BI |Mining", "Title a", "longest text", None, " L1 "),
    ("a.csv", 1, "\ufeffBI", "Tit", None, "xyz", "L1"),
    ("a.csv", 3, None, None, " ", "", "L2"),
    ("a.csv", 4, "X", "t", "d", "q", "  "),
    ("a.csv", 5, "X", "t", "d", "q", None),
]


def posts(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


WANT = [("", "", "", "", "L2"), ("BI | Mining | Data", "Title a", "longest text", "xyz", "L1")]


def test_merge_by_link(spark):
    got = merge.ordered_output(merge.merge_by_link(posts(spark))).collect()
    assert [tuple(r) for r in got] == WANT


def test_merge_does_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    rows = [
        (f"f{rnd.randrange(4)}.csv", i, f"t{rnd.randrange(5)} | t{rnd.randrange(5)}", "x" * rnd.randrange(4), str(i), "", f"L{rnd.randrange(3) * rnd.randrange(2)}")
        for i in range(300)
    ]
    results = []
    for n in (1, 7):
        rnd.shuffle(rows)
        results.append(sorted(map(tuple, merge.merge_by_link(posts(spark, rows).repartition(n)).collect())))
    assert results[0] == results[1]


def test_merge_gathers_no_group(spark):
    plan = merge.merge_by_link(posts(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "partial_min" in plan


def test_dedupe_keeps_the_first_and_treats_nulls_alike(spark):
    rows = [("f", i, "s", t, d, "q", "l") for i, (t, d) in enumerate([("a", "b"), ("a", "b"), (None, "b"), (None, "b"), ("a", "c ")])]
    df = posts(spark, rows)
    assert sorted(r.row_key for r in dedupe.dedupe_posts(df).collect()) == [0, 2, 4]
    assert sorted(r.row_key for r in dedupe.dedupe_posts(df.select("row_key", "Title", "Description")).collect()) == [0, 2, 4]
    same = posts(spark, [("f", 0, "s", "a", "b —c", "q", "l"), ("f", 1, "s", "a ", "b -c", "q", "l")])
    assert dedupe.dedupe_posts(same).count() == 2
    assert dedupe.dedupe_posts(same, normalize_first=True).count() == 1


def test_run_files(spark, tmp_path):
    cells = 'SearchTerm,Title,Description,Qualifications,Link\n'
    (tmp_path / "r1.csv").write_text("\ufeff" + cells + 'BI,"A, ""b""","line 1\nline 2",NA,L1\n', encoding="utf-8")
    (tmp_path / "r2.csv").write_text("Link,Title,Extra,SearchTerm,Qualifications,Description\nL2,T2,e,BI,q,null\n")
    (tmp_path / "r3.csv").write_text("Title,Link\nx,y\n")
    (tmp_path / "r4.csv").write_text(cells)
    (tmp_path / "r5.csv").write_text("")
    got = {r.source_file: tuple(r[c] for c in POST_COLUMNS) for r in files.read_runs(spark, f"{tmp_path}/r*.csv").collect()}
    assert got == {"r1.csv": ("BI", 'A, "b"', "line 1\nline 2", None, "L1"), "r2.csv": ("BI", "T2", None, "q", "L2")}
    checked = {r.file.rsplit("/", 1)[1]: r for r in files.validate_columns(files.list_run_files(spark, f"{tmp_path}/r*.csv")).collect()}
    assert checked["r3.csv"].missing == ["SearchTerm", "Description", "Qualifications"]
    assert [n for n, r in sorted(checked.items()) if r.usable] == ["r1.csv", "r2.csv"]  # r4 has a header only


def test_row_keys_are_stable_and_unique(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run.csv").write_text("SearchTerm,Title,Description,Qualifications,Link\n" + "".join(f"s,t{i},d,q,L{i}\n" for i in range(5)))
    (tmp_path / "b" / "other.csv").write_text("Link,Title,Description,Qualifications,SearchTerm\nL0,t0,d,q,s\nL0,t0,d,q,s\n")
    once, again = (
        sorted((r.source_file, r.row_key, r.Title) for r in files.read_runs(spark, f"{tmp_path}/*/*.csv").collect()) for _ in range(2)
    )
    assert once == again and len({k for _, k, _ in once}) == 12
    for run in {r[1].split("-")[0] for r in once}:
        down = [t for _, k, t in sorted(once, key=lambda r: r[1]) if k.startswith(run)]
        assert down in (["t0", "t1", "t2", "t3", "t4"], ["t0", "t0"])
    plan = files.read_runs(spark, f"{tmp_path}/*/*.csv")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_headers_are_read_by_a_job(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('"Link","say ""hi"", you",,Title\n\nL,x,,T\n')
    (tmp_path / "blank.csv").write_text("Link,Title\n \n\n")
    (tmp_path / "long.csv").write_text("Link,Title\n" + "L,T\n" * 5_000)
    got = {r.file.rsplit("/", 1)[1]: r for r in files.list_run_files(spark, f"{tmp_path}/*.csv").collect()}
    assert got["a%20b.csv"].columns == ["Link", 'say "hi", you', "", "Title"]
    assert [n for n, r in sorted(got.items()) if r.has_rows] == ["a%20b.csv", "long.csv"]
    rows = files.read_runs(spark, f"{tmp_path}/*.csv", ("Title", "Link"))
    assert rows.groupBy("source_file", "Title", "Link").count().orderBy("count").collect()[0]["Title"] == "T"
    assert rows.count() == 5_001 == rows.select("row_key").distinct().count()
    assert files.read_runs(spark, f"{tmp_path}/none*.csv").count() == files.list_run_files(spark, f"{tmp_path}/none*.csv").count() == 0


def test_texts_of_run_files_are_not_shuffled(spark, tmp_path):
    """Inputs above the limit of a broadcast: the table of files is small as written, and only it moves."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("Link,Title\n" + f"L{i},{'t' * 100}\n" * 4_000)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        rows = files.read_runs(spark, f"{tmp_path}/*.csv", ("Title", "Link"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        headers = files.list_run_files(spark, f"{tmp_path}/*.csv")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in headers
        assert rows.count() == 12_000 == rows.select("row_key").distinct().count()
    finally:
        spark.conf.set(key, before)


def test_flat_posts_round_trip(spark):
    df = spark.createDataFrame(
        [("s", 't "q"', " padded\n\nx,", ["a", "", None, "b"], "L"), ("s", None, "d", None, "M")],
        "SearchTerm string, Title string, Description string, Qualifications array<string>, Link string",
    )
    path = scratch_path(spark, "flat")
    files.write_flat_posts(df, path)
    got = sorted((tuple(r[c] for c in POST_COLUMNS) for r in files.read_runs(spark, f"{path}/*.csv").collect()), key=lambda r: r[4])
    assert got == [("s", 't "q"', " padded\n\nx,", "a | b", "L"), ("s", None, "d", None, "M")]


def test_annotations(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text":"a","label":["JOB","X"]}\n{"text":"b","label":[]}\n{"text":"c"}\n{"text":"d","label":[""]}\n')
    assert [tuple(r) for r in files.read_labelled_jsonl(spark, f"{tmp_path}/c.jsonl").collect()] == [("a", "JOB")]
    (tmp_path / "s.jsonl").write_text('{"text":"abc","label":[[0,2,"H"]]}\n{"text":"x"}\n')
    rows = {r.text: [tuple(s) for s in r.spans] for r in files.read_span_jsonl(spark, f"{tmp_path}/s.jsonl").collect()}
    assert rows == {"abc": [(0, 2, "H")], "x": []}
    df = spark.createDataFrame([(1, 'é "x"\n')], "id bigint, text string")
    files.write_annotation_jsonl(df, f"{tmp_path}/out", labelled=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"text":"é \\"x\\"\\n","label":[]}']


def test_report_invariants(spark):
    rows = [("Business Intelligence", 300, 300, 5995, 5, 6000), ("Data Analytics", 62, 61, 1220, 0, 1220)]
    schema = "search_term string, pages_attempted bigint, pages_visited bigint, jobs_collected bigint, job_parse_failures bigint, links_discovered bigint"
    per_term = spark.createDataFrame(rows, schema)
    report = files.run_report(per_term, "20251006_234206").head()
    assert report.totals.links_discovered == 7220 and report.total_rows == 7215 == report.totals.jobs_collected
    terms = spark.createDataFrame([("Business Intelligence",), ("Data Analytics",), ("Absent",)], "search_term string")
    got = {r.search_term: r for r in stats.crawl_totals(per_term, terms).collect()}
    assert got["Absent"].pages_visited == 0 and got["TOTAL"].pages_visited == 361 and len(got) == 4


def test_stratified_split_is_exact(spark):
    rows = [(i, "JOB" if i % 10 else ("RARE" if i % 50 else "ONE")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    out = sampling.stratified_split(df, "label", "id")
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts[("JOB", "test")] == 360 and counts[("RARE", "test")] == 32 and counts[("ONE", "test")] == 8
    assert out.count() == 2000
    again = sampling.stratified_split(df.repartition(5), "label", "id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_topic_numbers(spark):
    rows = [(i, c) for i, c in enumerate([7, 7, 7, 3, 3, 9, 9, None, 4])]
    got = {r.id: r.topic for r in topics.assign_topics(spark.createDataFrame(rows, "id bigint, component bigint")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: -1, 8: 3}


def test_similarity_tiles_agree(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(t, f"w{w}", rnd.random()) for t in range(-1, 9) for w in rnd.sample(range(30), 12)]
    weights = spark.createDataFrame(rows, "topic int, term string, weight double")
    one = {(r.topic_a, r.topic_b): r.similarity for r in topics.topic_similarity(weights).collect()}
    monkeypatch.setattr(topics, "_TILE", 3)
    monkeypatch.setattr(topics, "_TERMS_PER_BLOCK", 5)
    many = {(r.topic_a, r.topic_b): r.similarity for r in topics.topic_similarity(weights).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)
    assert all(a < b for a, b in one)


def test_membership_chunks_agree(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, i % 7 - 1, [rnd.random(), rnd.random()]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, topic int, v array<double>")
    one = {r.doc_id: r.probability for r in topics.topic_membership(docs).collect()}
    monkeypatch.setattr(topics, "CENTROID_CELLS", 4)
    many = {r.doc_id: r.probability for r in topics.topic_membership(docs).collect()}
    assert all(abs(one[k] - many[k]) < 1e-12 for k in one) and all(0 <= p <= 1 for p in one.values())


def test_replayed_batch_counts_once(spark):
    """A batch that runs again replaces what it wrote."""
    table = scratch_path(spark, "replay")
    src = scratch_path(spark, "src")
    posts(spark).coalesce(1).write.parquet(src)

    def run(checkpoint):
        stream = spark.readStream.schema(posts(spark).schema).parquet(src)
        jobs.stream_merge(stream, table, checkpoint).awaitTermination()
        return sorted(map(tuple, jobs.read_merged(spark, table).collect()))

    assert run(f"{table}/_a") == run(f"{table}/_b") == sorted(WANT)


def test_plug_in_encoder_sees_each_text_once(spark):
    import numpy as np

    from postloom.operators.embed import as_array, embed_text

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id bigint, text string")

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    for distinct in (True, False):
        got = {r.id: r.v for r in as_array(embed_text(df, "text", encoder, distinct=distinct)).collect()}
        assert got[1] == got[3] and abs(got[1][0] - 2 / 5**0.5) < 1e-12 and got[4] == [0.0, 1.0]


def test_report_of_absent_classes(spark):
    preds = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "true string, pred string")
    rows = {r.label: r for r in stats.classification_report(preds).collect()}
    assert rows["B"].support == 0 and rows["B"].f1 == 0 and rows["C"].recall == 0
    assert rows["accuracy"].f1 == round(1 / 3, 6) and rows["A"].precision == 0.5
    assert stats.confusion_matrix(preds).count() == 9
    assert stats.confusion_matrix(preds).agg(F.sum("n")).head()[0] == 3
