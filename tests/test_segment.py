import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from postloom.operators import segment
from postloom.operators.entities import strip_entities
from postloom.operators.spans import align_spans

S = " ".join


def run(spark, docs, **kw):
    df = spark.createDataFrame(list(enumerate(docs)), "des_id bigint, Description string")
    got = {}
    for r in segment.make_paragraphs(df, **kw).orderBy("des_id", "par_id").collect():
        got.setdefault(r.des_id, []).append(r.text)
        assert r.par_id == len(got[r.des_id]) - 1
    return [got.get(i, []) for i in range(len(docs))]


def test_special_documents(spark):
    long_sentence = S(["word"] * 400) + "."
    docs = [
        "",
        "\n \n",
        "Title\nOther\nLast",  # headers only: one closing paragraph
        "About us\nWe do things. We do more.\nBenefits",  # trailing header
        long_sentence + " Next one. " + S(["more"] * 200) + ".",  # first sentence over the limit
        None,
    ]
    got = run(spark, docs)
    assert got[0] == [] and got[1] == [] and got[5] == []
    assert got[2] == ["Title\nOther\nLast"]
    assert got[3] == ["About us\nWe do things. We do more.", "Benefits"]
    # The first sentence is over the limit by itself, so it is a paragraph of its own.
    assert got[4] == [long_sentence, "Next one.", S(["more"] * 200) + "."]


def test_worked_examples(spark):
    short = "One two three four. Five six seven eight."
    docs = [
        f"Duties:\n{short}",  # a header leads its text
        f"{short}\nDuties\n{short}",  # and opens a new paragraph
        f"Team\nDuties\n{short}",  # headers in a row stay together
        f"Duties\n{short}\nTail:",  # the last one has nothing to lead
    ]
    assert run(spark, docs) == [
        [f"Duties:\n{short}"],
        [short, f"Duties\n{short}"],
        [f"Team\nDuties\n{short}"],
        [f"Duties\n{short}", "Tail:"],
    ]


def test_properties_of_paragraphs(spark):
    rnd = random.Random(5)

    def doc():
        lines = []
        for _ in range(rnd.randrange(0, 40)):
            kind = rnd.random()
            if kind < 0.2:
                lines.append(S(["Head"] * rnd.randrange(1, 6)) + rnd.choice(["", ":"]))
            elif kind < 0.4:
                lines.append("")
            else:
                lines.append(
                    S(S(["w%d" % rnd.randrange(9)] * rnd.randrange(1, 60)) + rnd.choice([".", "!", "?", ""]) for _ in range(rnd.randrange(1, 12)))
                )
        return "\n".join(lines)

    docs = [doc() for _ in range(60)]
    for sep in ("\n\n", "\n"):
        for text, paragraphs in zip(docs, run(spark, docs, para_sep=sep)):
            # Nothing is lost, added or moved, and nothing is blank.
            assert S(paragraphs).split() == text.split()
            assert all(p.strip() for p in paragraphs)
            for p in paragraphs:
                # A paragraph beyond the word bound is one sentence that cannot be cut.
                assert len(p.split()) <= 320 or len(re.findall(r"[.!?…]+\s", p)) == 0


def test_no_word_is_lost(spark):
    docs = ["A b c d e.\n" * 400 + "Head\n" + S(["x"] * 900) + ". End of it."]
    assert S(S(p) if isinstance(p, list) else p for p in run(spark, docs)[0]).split() == docs[0].split()


def test_long_chain_of_sentences(spark):
    text = S(f"s{i}." for i in range(3000))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(segment.pack_sentences(F.col("t")).alias("v")).head().v
    assert got == [S(f"s{j}." for j in range(i, min(i + 3, 3000))) for i in range(0, 3000, 3)]


def test_segmentation_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "des_id bigint, Description string")
    plan = segment.make_paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_align_spans(spark):
    df = spark.createDataFrame(
        [(1, "Job title: x", [(0, 3, "H"), (4, 9, "H"), (4, 8, "H"), (3, 9, "H"), (9, 10, "H"), (11, 12, "H"), (11, 40, "H"), (5, 5, "H")])],
        "des_id bigint, text string, spans array<struct<start:int,end:int,label:string>>",
    )
    got = sorted((r.start, r.end) for r in align_spans(df).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_strip_entities(spark):
    df = spark.createDataFrame(
        [
            (1, 0, "Amazon Web Services and Acme, in  Paris use Python."),
            (1, 1, "Acme"),
            (2, 0, ""),
            (3, 0, "nothing to do"),
        ],
        "des_id bigint, par_id int, Description string",
    )
    names = spark.createDataFrame([(w,) for w in "amazon services acme paris python web".split()], "token string")

    def texts(**kw):
        return [r.Description for r in strip_entities(df, names, **kw).orderBy("des_id", "par_id").collect()]

    want = ["and , in  use Python.", "", "", "nothing to do"]
    assert texts() == want
    want[0] = "Amazon Web Services and , in  use Python."
    assert texts(mode="phrase") == want


def test_strip_entities_needs_no_keys(spark):
    rows = [(1, "ab london cd"), (1, "xy london zw"), (None, "keep me"), (None, "ab london cd"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "des_id bigint, Description string")
    few = spark.createDataFrame([("london",), (None,), ("paris",)], "token string")
    many = few.union(spark.range(6000).selectExpr("concat('name', id)"))
    want = sorted([(1, "ab cd"), (1, "xy zw"), (None, "keep me"), (None, "ab cd"), (2, None), (2, "")], key=str)
    for names in (few, many):
        assert sorted((tuple(r) for r in strip_entities(df, names).collect()), key=str) == want


def test_tagger_slot(spark):
    from postloom.operators.entities import tokens

    df = spark.createDataFrame([(1, 0, "Bob likes Java daily")], "des_id bigint, par_id int, Description string")

    def capitals(c):
        return F.transform(
            tokens(c), lambda t: F.struct(t.alias("token"), F.when(t.rlike("^[A-Z]"), "PERSON").otherwise("").alias("ent"))
        )

    assert strip_entities(df, None, tagger=capitals).head().Description == "likes Java daily"


def test_align_spans_against_a_walk(spark):
    text = "Años, 3 x_y—z!  été\n(ab)\x1f9.5 " * 30
    spans = [(a, a + n, str(n)) for a in range(-2, len(text) + 3) for n in (1, 2, 5, 40)]
    rows = [(1, text, [*spans, None, (0, None, "n")]), (2, None, spans), (3, text, None), (4, "", spans), (5, "a", [(0, 1, "x"), (0, 1, "x")])]
    df = spark.createDataFrame(rows, "des_id bigint, text string, spans array<struct<start:int,end:int,label:string>>")
    got = sorted(map(tuple, align_spans(df).collect()))
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    blank = lambda c: c.isspace()
    edge = [False] * (len(text) + 1)
    begun = [0]
    for i, c in enumerate(text):
        edge[i] = not (i and word(text[i - 1]) and word(c))
        begun.append(begun[-1] + (not blank(c) and (edge[i] or not word(c))))
    edge[-1] = True
    want = [(5, 0, 1, "x")] * 2
    for a, b, label in spans:
        if 0 <= a < b <= len(text) and edge[a] and edge[b] and not blank(text[a]) and not blank(text[b - 1]):
            want.append((1, begun[a], begun[b], label))
    assert got == sorted(want)


def test_align_spans_of_a_long_text_in_time(spark):
    n = 400_000
    text = "word, " * (n // 6)
    df = spark.createDataFrame([(1, text)], "des_id bigint, text string").withColumn(
        "spans", F.expr(f"transform(sequence(0, {n - 100}, 60), x -> struct(cast(x as int) as start, cast(x + 4 as int) as end, 'w' as label))")
    )
    began = time.monotonic()
    got = align_spans(df).agg(F.count("*"), F.max("end")).head()
    assert tuple(got) == ((n - 100) // 60 + 1, 20 * ((n - 100) // 60) + 1)
    assert time.monotonic() - began < 40  # 63 s and more when places are counted from the front for each span
