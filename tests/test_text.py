import unicodedata

import pytest
from pyspark.sql import functions as F

from postloom.functions import arrays, labels, text

NORMALIZE = [
    ("a—–b", "a-b"),
    ("ﬁ x…", "fi x..."),
    ("x \n\n\n\ny", "x\n\ny"),
    ("  a \t b\t\n", "a b"),
    ("one\u200btwo\u2060three", "onetwothree"),
    ("e\u0301t\u00e9", "été"),
    ("\u3000wide\u3000gap", "wide gap"),
    ("", ""),
    ("plain", "plain"),
    ("a---b -- c", "a-b - c"),
    ("한국\u1112\u1161\u11ab", "한국한"),
    ("½ ² ① Ａ", "1⁄2 2 1 A"),
]


def column(spark, values, fn, schema="i int, s string"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r.v for r in df.withColumn("v", fn(F.col("s"))).orderBy("i").collect()]


def test_normalize_text(spark):
    assert column(spark, [a for a, _ in NORMALIZE], text.normalize_text) == [b for _, b in NORMALIZE]


def test_every_mapped_character(spark):
    chars = text.DASHES + text.BULLETS + text.ODD_SPACES + text.DROPPED
    want = ["x-y"] * len(text.DASHES + text.BULLETS) + ["x y"] * len(text.ODD_SPACES) + ["xy"] * 2
    assert column(spark, [f"x{c}y" for c in chars], text.normalize_text) == want


def test_skipping_composition_is_safe():
    import re

    java = text._may_change_under_nfkc()
    skip = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m.group(1).zfill(4), java))
    for cp in range(0x3000):
        c = chr(cp)
        if not skip.search(c):
            assert unicodedata.normalize("NFKC", "a" + c) == "a" + c
    assert all(unicodedata.normalize("NFKC", "a" + chr(c)) == "a" + chr(c) for c in range(0xC0, 0x100))


def test_normalize_is_idempotent(spark):
    once = column(spark, [a for a, _ in NORMALIZE], text.normalize_text)
    assert column(spark, once, text.normalize_text) == once


def test_strip_matches_python(spark):
    values = [f"{c}a{c}b{c}" for c in text.SPACE_CHARS]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert all(c.isspace() for c in text.SPACE_CHARS)


def test_words_match_python(spark):
    values = ["", " ", "a b", "x\x1cy\u2003z", "\u00a0", "a\u200bb c\n\nd"]
    assert column(spark, values, text.count_words) == [len(v.split()) for v in values]


@pytest.mark.parametrize("n", [1, 3])
def test_at_most_words(spark, n):
    values = ["", "a", "a b c", "a b c d", "a\u2003b", "a-b: c"]
    got = column(spark, values, lambda c: text.at_most_words(c, n))
    assert got == [0 < len(v.split()) <= n for v in values]


def test_clean_string_slug_url(spark):
    assert column(spark, ["\ufeff a ", None], text.clean_string) == ["a", ""]
    assert column(spark, ["Straße / C#", "--", "Data  Mining!"], text.slugify) == ["strasse_c", "term", "data_mining"]
    assert column(spark, ["C++ a*b~c é/"], text.quote_plus) == ["C%2B%2B+a%2Ab~c+%C3%A9%2F"]


def test_resolve_link(spark):
    values = ["/job/1", "//cdn/x", "job/2", "https://o.example/y", "mailto:a@b"]
    got = column(spark, values, lambda c: text.resolve_link(c, "https://h.example/list/"))
    assert got == [
        "https://h.example/job/1", "https://cdn/x", "https://h.example/list/job/2", "https://o.example/y", "mailto:a@b",
    ]


def test_qualifications(spark):
    values = [" • SQL ;", "C++.", "- * Data\n  Mining –", "…", None]
    assert column(spark, values, text.clean_qualification) == ["SQL ", "C++", "Data Mining ", "…", ""]
    df = spark.createDataFrame([(["SQL", "- sql.", "", "C++", "STRASSE", "straße", "c++"],)], "q array<string>")
    assert df.select(arrays.dedupe_qualifications(F.col("q")).alias("v")).head().v == ["SQL", "C++", "STRASSE"]


def test_sentences(spark):
    values = ["", "  ", "One.", "One. Two! Three?", "v3.5 is out", "A.\nB", "Wait... what?! Yes"]
    assert column(spark, values, text.count_sentences) == [0, 0, 1, 3, 1, 2, 3]


def test_label_rule(spark):
    rows = [
        (0.38, 0.45, 0.17),  # strong blurb is asked first
        (0.45, 0.45, 0.10),
        (0.30, 0.30, 0.40),  # close to the top
        (0.25, 0.375, 0.375),  # gap of 0.125
        (0.20, 0.39, 0.41),
        (0.10, 0.40, 0.40),  # tie goes to the first column
        (0.25, 0.35, 0.40),  # a gap of exactly 0.15 is no longer close
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r.v for r in df.select(labels.predict_label(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    want_last = "job" if 0.40 - 0.25 < 0.15 else "offer_detail"
    assert got == ["blurb_legal", "job", "job", "job", "offer_detail", "blurb_legal", want_last]


def test_empty_placeholder(spark):
    assert column(spark, ["a\n\n b ", " \n", None], text.split_lines) == [["a", "b"], [""], [""]]
