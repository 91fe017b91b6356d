import random
import re
from collections import Counter

from postloom.llm.quality import quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def rows():
    rnd = random.Random(2)
    word = lambda: "w%d" % rnd.randrange(3000)
    body = lambda n: " ".join(word() for _ in range(n))
    out = [(None, None, None), (1, "", "h"), (2, " \n\t\x0b", "h"), (3, "é😀 # a b", "h"), (4, "a b c " * 40, "h"), (5, "a b", None), (6, "x" * 100_000, "h"), (7, "one two three\n" * 30_000, "h")]
    out += [(100 + i, "\n".join([body(60), "Click here  to SUBSCRIBE %03d now" % i, body(20)]), "hot") for i in range(120)]
    out += [(300 + i, "\n".join([body(3)] + [" ".join(f"{k}{w}" for w in "one two three four five six seven eight nine ten".split()) for k in "abcdefgh"]), "hot") for i in range(60)]
    out += [(400 + i, out[10][1], "hot") for i in range(40)]  # copies of a clean document
    out += [(450, out[10][1], None), (451, out[10][1], None), (451, out[10][1], None)]
    return out


def test_counts_and_verdicts(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id bigint, text string, source string, host string, words int").repartition(5)
    out = quality(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(
        ((d, *base(t)) for d, t, _ in given), key=str
    )
    kept = {r.doc_id: r for r in got if r.doc_id is not None}
    # The line differs in digits only and is in all; what is left is a document.
    assert all(kept[100 + i].kept and kept[100 + i].removed_words == 6 for i in range(120))
    # Eight of nine lines are the site's, so nearly nothing is left.
    assert all(not kept[300 + i].kept and not kept[300 + i].base_failed for i in range(60))
    # A document copied often is no boilerplate, here or at another host.
    assert all(kept[i].kept for i in (*range(400, 440), 450, 451))
    assert quality(df.limit(0)).count() == 0


def test_lines_of_one_template_are_found(spark):
    """100 distinct pages with the same 20 lines and two of their own."""
    rnd = random.Random(5)
    # Only letters: digits count as equal.
    line = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    for _ in range(3):
        template = [line(4) for _ in range(20)]
        pages = [(i, "\n".join([line(30), *template, line(30)]), "h") for i in range(100)]
        got = quality(spark.createDataFrame(pages, "doc_id bigint, text string, source string")).collect()
        assert len(got) == 100 and all(r.removed_words == 80 and r.n_words == 140 and r.kept for r in got)


def test_limit_does_not_grow_with_the_host(spark):
    pages = [(i, " ".join("w%s" % "".join(chr(97 + int(c)) for c in str(i * 100 + k)) for k in range(60)) + ("\nall rights are reserved" if i < 25 else ""), "h") for i in range(3000)]
    got = quality(spark.createDataFrame(pages, "doc_id bigint, text string, source string")).where("removed_words = 4").collect()
    assert sorted(r.doc_id for r in got) == list(range(25))
