"""Names of one and several tokens."""

import pytest

from postloom.operators.entities import strip_entities


@pytest.mark.parametrize(
    "text,names,want",
    [
        ("We love New York, new hires!", ["new york"], "We love , new hires!"),
        ("New York City and York City Hall", ["New York", "york  city hall"], "City and"),
        ("a b c d", ["a b", "b c"], "d"),  # names that overlap
        ("Acme Acme-Corp acme", ["ACME"], "-Corp"),
        ("O'Neil works", ["o'neil"], "works"),
        ("Python and Java at Foo Bar", ["python", "foo bar", "at"], "Python and Java"),
        ("  kept  ", ["x"], "kept"),
        ("", ["x"], ""),
        (None, ["x"], None),
        ("nothing", [], "nothing"),
        ("nothing", [None, " "], "nothing"),
    ],
)
def test_names_go(spark, text, names, want):
    docs = spark.createDataFrame([(1, text, "h", "d"), (1, text, "h", "d")], "id int, Description string, hits string, Digest string")
    out = strip_entities(docs, spark.createDataFrame([(n,) for n in names], "token string"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, want, "h", "d")] * 2


def test_phrases_protect_their_tokens(spark):
    docs = spark.createDataFrame([("Red Hat and Red Cross",)], "Description string")
    names = spark.createDataFrame([("red",), ("hat",), ("red cross",)], "token string")
    assert strip_entities(docs, names).head()[0] == "and"
    assert strip_entities(docs, names, mode="phrase").head()[0] == "Red Hat and"


def test_many_names(spark):
    docs = spark.createDataFrame([(f"start Name{i} Of{i} end",) for i in range(50)], "Description string")
    names = spark.range(20_000).selectExpr("concat('name', id, ' of', id) as token")
    assert {r[0] for r in strip_entities(docs, names).collect()} == {"start end"}
