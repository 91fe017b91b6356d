"""Order-preserving array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_qualification, let, strip


def explode_once(
    df: DataFrame, keep: Sequence[str | Column], items: Column, value: str, pos: str = "_pos"
) -> DataFrame:
    """(keep, pos, value) per item, with ``items`` computed once.

    A plain explode makes the optimizer test ``size(items) > 0`` beforehand,
    which computes a costly array twice and below any repartitioning; the
    outer form does not, and its empty rows are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, value)).where(F.col(pos).isNotNull())


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First item of every key, in the order of first sight (n log n)."""
    tagged = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )
    firsts = let(
        F.sort_array(tagged),
        lambda t: F.filter(
            t, lambda e, i: (i == 0) | (e["k"] != F.get(t, i - 1)["k"])
        ),
    )
    by_place = F.sort_array(
        F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))
    )
    return F.transform(by_place, lambda e: e["x"])


def dedupe_links(links: Column) -> Column:
    return F.array_distinct(links)


def dedupe_qualifications(items: Column) -> Column:
    """Cleaned items, blanks out, one per spelling regardless of case."""
    cleaned = F.filter(F.transform(items, clean_qualification), lambda s: s != "")
    return distinct_by(cleaned, lambda s: F.lower(F.replace(s, F.lit("ß"), F.lit("ss"))))


def split_parts(c: Column, sep: str = "|") -> Column:
    """Trimmed non-empty parts of a separated cell."""
    parts = F.transform(F.split(c, "\\" + sep if sep in "|.*+?" else sep), strip)
    return F.filter(parts, lambda p: p != "")


def join_list(items: Column, sep: str = " | ") -> Column:
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda q: q.isNotNull() & (q != ""))
    return F.array_join(kept, sep)
