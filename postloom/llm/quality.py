"""Quality rules in column expressions: repetition within a text, line frequency across texts.

Lines are normalised (A-Z to a-z, digits to 0, runs of blanks to one) and hashed.
A line is boilerplate of its host if more distinct documents of that host hold
it than the limit allows. Documents are told apart by their whole text: exact
copies count as one, so a text that is merely copied often does not lose its own
lines; texts that differ anywhere count each.
Boilerplate lines are removed; a document with too little left is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.store import stored

# The characters between words, and symbols.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A line is boilerplate in more than this many documents of a host, however many the host has.
LINE_DOCS = 20
#: A document with a smaller share of its words left is depleted.
LEFT_SHARE = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _hash(value: Column) -> Column:
    """60 bits of an MD5, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more."""

    def covered(places: Column) -> Column:
        span = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(span, F.lit(0), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, h: F.coalesce(F.get(s, i)["h"] == h, F.lit(False))
        places = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i + 1, x["h"]) | ((i > 0) & same(s, i - 1, x["h"]))), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(places, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(let(windows, count))


def text_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("again"))
    return let(
        let(words(text), of_words),
        lambda s: F.struct(
            s["n"].cast("bigint").alias("n_words"),
            s["chars"].cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
            dup.cast("bigint").alias("n_dup_lines"),
            s["again"].cast("bigint").alias("n_repeat_words"),
        ),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """(host, t, at, line, words): the lines with words of each distinct text of a host; line is the hash of the normalised line."""
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[0-9]", "0"), BLANKS, " "))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    hashed = F.transform(lines, lambda x: F.struct(_hash(normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD + "+")).alias("words")))
    own = docs.select(host_key(), F.xxhash64("text").alias("t"), hashed.alias("lines"))
    each = own.select("host", "t", F.posexplode("lines").alias("at", "x")).select("host", "t", "at", "x.line", "x.words")
    # Rows with the same text bring the same lines.
    return each.groupBy("host", "t", "at").agg(*(F.min(c).alias(c) for c in ("line", "words")))


def host_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string"))).alias("host")


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words), one row per row of ``docs``.

    docs: doc_id bigint, text string, source string (the host); other columns are
    not read. base_failed: fewer than 50 words, or more than half of the words
    in repeated windows. kept: not base_failed, and at least ``left_share`` of the
    words outside boilerplate lines, i.e. lines in more than ``line_docs`` documents
    of the host. A null text counts as empty and fails; a null
    source is a host of its own; repeated rows get equal answers and count once.
    """
    lines = stored(host_lines(docs), "host-lines")
    common = lines.groupBy("host", "line").agg(F.countDistinct("t").alias("held")).where(F.col("held") > line_docs).select("host", "line")
    removed = lines.join(common, ["host", "line"]).groupBy("host", "t").agg(F.sum("words").alias("removed"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host_key(), F.xxhash64("text").alias("t"), text_counts(F.col("text")).alias("c"))
    out = own.join(removed, ["host", "t"], "left").select("doc_id", "c.*", F.coalesce("removed", F.lit(0)).cast("bigint").alias("removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left_share * F.col("n_words")))
