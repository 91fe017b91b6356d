"""Cutting a description into header-aware paragraphs.

A description is one cell, so every step is an expression over arrays of its
own lines: no shuffle, no window, whatever the size of the corpus. Positions
are found first (``filter`` over a ``sequence``) and the pieces are sliced from
them afterwards, which keeps the work linear in the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import (
    at_most_words,
    count_sentences,
    count_tokens,
    count_words,
    let,
    sentences,
    strip,
)

# lines: array<string>  ->  array<int>, numbers of the lines that open a section
HeaderDetector = Callable[[Column], Column]


def _indices(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def is_short_line(line: Column, max_words: int = 3) -> Column:
    """A non-blank line with few words, or one that ends in a colon."""
    return let(strip(line), lambda bare: at_most_words(bare, max_words) | bare.endswith(":"))


def short_line_headers(max_words: int = 3) -> HeaderDetector:
    return lambda lines: F.filter(_indices(lines), lambda i: is_short_line(lines[i], max_words))


def _runs(last: Column, first: Column | int = 0) -> Column:
    """Runs that end at each position of ``last``: array<struct<a,b>>."""
    return F.transform(
        last,
        lambda b, k: F.struct(
            F.when(k == 0, F.lit(first)).otherwise(F.get(last, k - 1) + 1).alias("a"), b.alias("b")
        ),
    )


def _join(items: Column, a: Column, b: Column, sep: str) -> Column:
    return F.array_join(F.slice(items, a + 1, b - a + 1), sep)


def segments(lines: Column, detector: HeaderDetector) -> Column:
    """array<struct<text, n_sents>>: from each section start to the next."""
    starts = let(
        detector(lines),
        lambda found: F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), found))),
    )
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda a, k: let(
                _join(lines, a, F.coalesce(F.get(s, k + 1), F.size(lines)) - 1, "\n"),
                lambda t: F.struct(t.alias("text"), count_sentences(t).alias("n_sents")),
            ),
        ),
    )


def islands(segs: Column) -> Column:
    """array<struct<text, tail>>: one-sentence segments lead the next longer one."""

    def build(last: Column, texts: Column) -> Column:
        closed = F.transform(
            _runs(last),
            lambda r: F.struct(strip(_join(texts, r["a"], r["b"], "\n")).alias("text"), F.lit(False).alias("tail")),
        )
        rest_from = F.when(F.size(last) > 0, F.element_at(last, -1) + 1).otherwise(F.lit(0))
        rest = strip(_join(texts, rest_from, F.size(texts) - 1, "\n"))
        return F.concat(closed, F.array(F.struct(rest.alias("text"), F.lit(True).alias("tail"))))

    def with_texts(segs: Column) -> Column:
        return let(
            F.transform(segs, lambda s: s["text"]),
            lambda texts: let(
                F.filter(_indices(segs), lambda i: segs[i]["n_sents"] > 1),
                lambda last: F.filter(build(last, texts), lambda x: x["text"] != ""),
            ),
        )

    return let(segs, with_texts)


def pack_sentences(c: Column, max_tokens: int = 320, sentences_per_chunk: int = 3) -> Column:
    """Greedy chunks of whole sentences, bounded in words and in sentences.

    Where a chunk ends depends on its first sentence alone, so the next start
    is computed for every sentence at once; a fold then only follows the
    chain. It runs in blocks so that its growing list stays short.
    """

    def chunks(sents: Column) -> Column:
        return let(
            F.transform(sents, count_words),
            lambda words: let(F.transform(sents, lambda _, i: next_start(words, i)), lambda nxt: cut(sents, nxt)),
        )

    def next_start(words: Column, i: Column) -> Column:
        held = words[i]
        fits = F.lit(True)
        step = F.lit(1)
        for ahead in range(1, sentences_per_chunk):
            more = F.get(words, i + ahead)
            held = held + F.coalesce(more, F.lit(0))
            fits = fits & more.isNotNull() & (held <= max_tokens)
            step = step + fits.cast("int")
        return i + step

    def cut(sents: Column, nxt: Column) -> Column:
        empty = F.array().cast("array<int>")
        blocks = F.sequence(F.lit(0), F.size(sents) - 1, F.lit(512))

        def walk(state: Column, i: Column) -> Column:
            return F.when(
                i == state["at"],
                F.struct(F.get(nxt, i).alias("at"), F.concat(state["starts"], F.array(i)).alias("starts")),
            ).otherwise(state)

        def block(state: Column, first: Column) -> Column:
            span = F.sequence(first, F.least(first + 511, F.size(sents) - 1))
            inner = F.aggregate(span, F.struct(state["at"].alias("at"), empty.alias("starts")), walk)
            return let(
                inner,
                lambda r: F.struct(
                    r["at"].alias("at"), F.concat(state["done"], F.array(r["starts"])).alias("done")
                ),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("done"))
        heads = F.aggregate(blocks, start, block, lambda s: F.flatten(s["done"]))
        return let(
            heads,
            lambda h: F.transform(h, lambda a: _join(sents, a, F.get(nxt, a) - 1, " ")),
        )

    return let(
        sentences(c),
        lambda s: F.when(F.size(s) > 0, chunks(s)).otherwise(F.array().cast("array<string>")),
    )


def split_long(
    text: Column,
    threshold: int = 120,
    max_words: int = 320,
    sentences_per_chunk: int = 3,
    held_sentences: int = 2,
    para_sep: str = "\n\n",
) -> Column:
    """array<string>: a long text cut at blank lines, short parts joined on."""

    def pieces(parts: Column) -> Column:
        last = F.filter(
            _indices(parts),
            lambda i: (count_sentences(parts[i]) > held_sentences) | (i == F.size(parts) - 1),
        )
        grouped = let(
            last, lambda p: F.transform(_runs(p), lambda r: _join(parts, r["a"], r["b"], "\n"))
        )
        packed = F.transform(
            grouped,
            lambda g: F.when(
                count_words(g) > max_words, pack_sentences(g, threshold, sentences_per_chunk)
            ).otherwise(F.array(g)),
        )
        return F.flatten(packed)

    parts = F.filter(F.transform(F.split(text, para_sep), strip), lambda p: p != "")
    return F.when(count_tokens(text) < threshold, F.array(strip(text))).otherwise(let(parts, pieces))


def paragraphs(
    c: Column,
    threshold: int = 120,
    max_words: int = 320,
    sentences_per_chunk: int = 3,
    para_sep: str = "\n\n",
    detector: HeaderDetector | None = None,
) -> Column:
    """array<string>: the paragraphs of one description, in order."""
    detector = detector or short_line_headers()
    found = let(F.split(c, "\n"), lambda lines: islands(segments(lines, detector)))
    cut = F.transform(
        found,
        lambda x: F.when(x["tail"], F.array(x["text"])).otherwise(
            split_long(x["text"], threshold, max_words, sentences_per_chunk, para_sep=para_sep)
        ),
    )
    return F.filter(F.flatten(cut), lambda p: p != "")


# --- row-producing forms -------------------------------------------------------


def detect_headers(docs: DataFrame, detector: HeaderDetector | None = None) -> DataFrame:
    """(des_id, line, text) of every header line."""
    detector = detector or short_line_headers()
    rows = let(
        F.split("Description", "\n"),
        lambda lines: F.transform(
            detector(lines), lambda i: F.struct(i.alias("line"), strip(lines[i]).alias("text"))
        ),
    )
    return explode_once(docs, ["des_id"], rows, "s").select("des_id", "s.line", "s.text")


def split_segments(docs: DataFrame, detector: HeaderDetector | None = None) -> DataFrame:
    """(des_id, seg, text, n_sents)."""
    detector = detector or short_line_headers()
    segs = let(F.split("Description", "\n"), lambda lines: segments(lines, detector))
    return explode_once(docs, ["des_id"], segs, "s", "seg").select("des_id", "seg", "s.text", "s.n_sents")


def attach_headers(docs: DataFrame, detector: HeaderDetector | None = None) -> DataFrame:
    """(des_id, island, text, tail)."""
    detector = detector or short_line_headers()
    found = let(F.split("Description", "\n"), lambda lines: islands(segments(lines, detector)))
    return explode_once(docs, ["des_id"], found, "s", "island").select("des_id", "island", "s.text", "s.tail")


def split_long_segments(
    df: DataFrame, threshold: int = 120, max_words: int = 320, held_sentences: int = 2, para_sep: str = "\n\n"
) -> DataFrame:
    """Adds ``part`` and replaces ``text`` by the pieces of each long row."""
    keep = [c for c in df.columns if c != "text"]
    cut = split_long(F.col("text"), threshold, max_words, held_sentences=held_sentences, para_sep=para_sep)
    return explode_once(df, keep, cut, "_piece", "part").withColumnRenamed("_piece", "text")


def make_paragraphs(posts: DataFrame, **options) -> DataFrame:
    """(des_id, par_id, text) with dense ``par_id`` from 0 in every post."""
    return explode_once(posts, ["des_id"], paragraphs(F.col("Description"), **options), "text", "par_id")


def collect_ordered_paragraphs(paras: DataFrame, text: str = "text") -> DataFrame:
    """(des_id, texts, n_texts): stripped non-empty texts in order, or one ``""``.

    A group is one post, whose text came from a single cell.
    """
    ordered = F.sort_array(F.collect_list(F.struct("par_id", F.coalesce(strip(F.col(text)), F.lit("")).alias("t"))))
    kept = F.filter(F.transform(ordered, lambda s: s["t"]), lambda t: t != "")
    return (
        paras.groupBy("des_id")
        .agg(kept.alias("texts"))
        .withColumn("texts", F.when(F.size("texts") == 0, F.array(F.lit(""))).otherwise(F.col("texts")))
        .withColumn("n_texts", F.size("texts"))
    )
