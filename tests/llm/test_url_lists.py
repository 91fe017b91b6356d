import datetime

from postloom.llm.url_lists import evaluate, intervals

D = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
ENTRY = "list string, verdict string, domain string, prefix string, action string, day date, host string"


def entries(spark, rows):
    return spark.createDataFrame([(a, v, d, p, x, None if n is None else D(n), "clash") for a, v, d, p, x, n in rows], ENTRY)


def test_intervals(spark):
    rows = [
        ("l", "block", "A.org", "/", "add", 5), ("l", "block", "a.org", "/", "remove", 9), ("l", "block", "a.org", "/", "add", 9), ("l", "block", "a.org", None, "add", 9),
        ("l", "allow", "a.org", "/x", "add", 7), ("l", "block", "b.org", "/", "remove", 3), (None, "block", "c", "/", "add", 1), ("l", "what", "c", "/", "add", 1),
        ("l", "block", None, "/", "add", 1), ("l", "block", "c", "/", "add", None), ("l", "block", "c", "/", None, 1),
    ]
    got = sorted(((r.verdict, r.domain, r.prefix, r.start, r.stop) for r in intervals(entries(spark, rows)).collect()), key=str)
    assert got == sorted([("block", "a.org", "/", D(5), D(9)), ("block", "a.org", "/", D(9), None), ("allow", "a.org", "/x", D(7), None)], key=str)


def test_as_of_the_fetch(spark):
    listed = entries(spark, [
        ("one", "block", "example.org", "/", "add", 10), ("one", "block", "example.org", "/", "remove", 20), ("two", "block", "example.org", "/", "add", 15),
        ("ok", "allow", "good.example.org", "/", "add", 12), ("one", "block", "good.example.org", "/bad", "add", 0), ("two", "allow", "x.net", "/", "add", 0), ("one", "block", "x.net", "/", "add", 0),
    ])
    shots = [
        (1, "http://EXAMPLE.org/a", 9), (2, "http://example.org./a", 10), (3, "https://u:p@www.example.org:80/a?x#y", 19), (4, "http://example.org", 20), (5, "http://good.example.org/", 11),
        (6, "http://good.example.org/ok", 12), (7, "http://a.good.example.org/bad/thing", 12), (8, "http://notexample.org/", 15), (9, "http://x.net/", 1), (10, None, 15), (11, "no url", 15),
        (12, "http://example.org/", None), (None, "http://example.org/", 15), (2, "http://example.org./a", 10), (13, "http://example.org/" + "p" * 100_000, 15),
    ]
    df = spark.createDataFrame([(i, u, None if n is None else D(n), "x", 1) for i, u, n in shots], "page_id bigint, url string, day date, host string, best int")
    got = [(r.page_id, r.verdict, r.domain, r.prefix, r.lists, r.n_open) for r in evaluate(df, listed).collect()]
    want = [
        (1, "none", None, None, None, 0), (2, "block", "example.org", "/", "one", 1), (3, "block", "example.org", "/", "one,two", 2), (4, "block", "example.org", "/", "two", 1),
        (5, "block", "example.org", "/", "one", 1), (6, "allow", "good.example.org", "/", "ok", 2), (7, "block", "good.example.org", "/bad", "one", 3), (8, "none", None, None, None, 0),
        (9, "block", "x.net", "/", "one", 2), (10, "none", None, None, None, 0), (11, "none", None, None, None, 0), (12, "none", None, None, None, 0),
        (None, "block", "example.org", "/", "one,two", 2), (2, "block", "example.org", "/", "one", 1), (13, "block", "example.org", "/", "one,two", 2),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.verdict for r in evaluate(df, listed.limit(0)).collect()} == {"none"}
    assert evaluate(df.limit(0), listed).count() == 0
