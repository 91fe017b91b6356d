"""Character annotations on token boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD_CHARS, count_tokens, let


#: Characters of a text that are looked through for one place.
BLOCK = 4096


def align_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """(des_id, start, end, label) in tokens, end exclusive.

    ``spans`` is array<struct<start,end,label>> in characters. A span whose
    ends do not fall between tokens is dropped: an end is a boundary when the
    character inside the span is no blank and the two characters around it are
    not both part of one word.
    """
    t = F.col(text)
    word, blank = f"[{WORD_CHARS}]", f"[{SPACE}]"

    def aligned(n: Column, blocks: Column) -> Column:
        """Spans in tokens of a text of ``n`` characters; places are looked up in blocks, not from the front."""
        block = lambda i: F.floor(i / BLOCK).cast("int")
        at = lambda i: F.substr(F.get(blocks, block(i)), (i % BLOCK + 1).cast("int"), F.lit(1))  # 0-based

        def fits(s: Column) -> Column:
            a, b = s["start"], s["end"]
            starts = ~at(a).rlike(blank) & ~((a > 0) & at(a - 1).rlike(word) & at(a).rlike(word))
            ends = ~at(b - 1).rlike(blank) & ~((b < n) & at(b - 1).rlike(word) & at(b).rlike(word))
            return F.when((a >= 0) & (a < b) & (b <= n), starts & ends)

        def part(a: Column, b: Column) -> Column:
            near = F.substr(F.get(blocks, block(a)), a % BLOCK + 1, b - a)
            return F.when(block(a) == block(b - 1), near).otherwise(F.substr(t, a + 1, b - a))

        def totals(places: Column) -> Column:
            """Tokens before each of some boundaries, 0 first: those between two neighbours are counted once."""
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1))
            counts = F.transform(places, lambda p, i: F.when(p == 0, 0).otherwise(count_tokens(part(before(i), p))))
            return F.aggregate(counts, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))

        def in_tokens(found: Column) -> Column:
            ends = F.concat(F.transform(found, lambda s: s["start"].cast("int")), F.transform(found, lambda s: s["end"].cast("int")))
            places = F.array_sort(F.array_distinct(ends))
            number = lambda p, k, x: F.get(k, F.array_position(p, x.cast("int")).cast("int"))
            one = lambda p, k, s: F.struct(number(p, k, s["start"]).alias("start"), number(p, k, s["end"]).alias("end"), s["label"].alias("label"))
            return let(places, lambda p: let(totals(p), lambda k: F.transform(found, lambda s: one(p, k, s))))

        return let(F.filter(spans, fits), in_tokens)

    blocks = F.transform(F.sequence(F.lit(0), F.length(t), F.lit(BLOCK)), lambda i: F.substr(t, i + 1, F.lit(BLOCK)))
    found = let(F.length(t), lambda n: let(blocks, lambda b: aligned(n, b)))
    # The outer form, so that the array is not computed for a test of its size as well.
    return docs.select("des_id", F.inline_outer(found)).where(F.col("start").isNotNull())
