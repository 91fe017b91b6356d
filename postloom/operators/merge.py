"""Folding repeated collection runs into one row per link.

No step gathers the rows of a link: the text picks are minima that combine on
the map side, and the search terms are grouped by (link, part) first, so what
finally meets is one row per distinct part, i.e. the cell to be written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once, split_parts
from ..functions.text import clean_string, strip
from ..schema import POST_COLUMNS

ORDER = ("source_file", "row_key")


def union_runs(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def clean_posts(posts: DataFrame) -> DataFrame:
    """Clean strings everywhere, rows without a link removed."""
    cleaned = posts.select(*ORDER, *[clean_string(F.col(c)).alias(c) for c in POST_COLUMNS])
    return cleaned.where(F.col("Link") != "")


def longest(c: Column, order: Sequence[str] = ORDER) -> Column:
    """Aggregate: struct whose last field is the longest value, first on ties."""
    v = F.coalesce(strip(c), F.lit(""))
    return F.min(F.struct((-F.length(v)).alias("rank"), *order, v.alias("value")))


def pick_longest(df: DataFrame, by: str, value: str, order: Sequence[str] = ORDER) -> DataFrame:
    return df.groupBy(by).agg(longest(F.col(value), order).alias("p")).select(by, F.col("p.value").alias(value))


def first_seen_parts(df: DataFrame, by: str, value: str, order: Sequence[str] = ORDER) -> DataFrame:
    """(by, part, seen): where each distinct part of a key occurs first."""
    parts = explode_once(df, [by, *order], split_parts(F.col(value)), "part", "pos")
    return parts.groupBy(by, "part").agg(F.min(F.struct(*order, "pos")).alias("seen"))


def join_seen_parts(seen: DataFrame, by: str, value: str, sep: str = " | ") -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("seen", "part")))
    return seen.groupBy(by).agg(F.array_join(F.transform(ordered, lambda s: s["part"]), sep).alias(value))


def combine_unique_parts(df: DataFrame, by: str, value: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Distinct ``|`` parts of every key, in the order of first sight."""
    joined = join_seen_parts(first_seen_parts(df, by, value, order), by, value)
    return df.select(by).distinct().join(joined, by, "left").fillna("", [value])


def unique_sources(df: DataFrame, by: str = "Link", source: str = "source_file") -> DataFrame:
    """The distinct files of every key, in file order."""
    return df.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(source)), " | ").alias("sources"))


def merge_by_link(posts: DataFrame) -> DataFrame:
    """One row per link: all search terms, the longest of each text."""
    rows = clean_posts(posts)
    texts = ("Title", "Description", "Qualifications")
    picked = rows.groupBy("Link").agg(*[longest(F.col(c)).alias(c) for c in texts])
    picked = picked.select("Link", *[F.col(f"{c}.value").alias(c) for c in texts])
    terms = join_seen_parts(first_seen_parts(rows, "Link", "SearchTerm"), "Link", "SearchTerm")
    return picked.join(terms, "Link", "left").fillna("", ["SearchTerm"]).select(*POST_COLUMNS)


def merge_stats(files: DataFrame, posts: DataFrame) -> DataFrame:
    """(metric, value) counters of a merge; ``files`` has (file, usable)."""
    link = clean_string(F.col("Link"))
    counted = posts.agg(
        F.count("*").alias("rows_loaded"),
        F.count_if(link != "").alias("rows_with_link"),
        F.count_if(link == "").alias("rows_dropped_no_link"),
        F.count_distinct(F.when(link != "", link)).alias("links_unique"),
    )
    seen = files.agg(F.count("*").alias("files_found"), F.count_if("usable").alias("files_used"))
    return seen.unpivot([], seen.columns, "metric", "value").union(
        counted.unpivot([], counted.columns, "metric", "value")
    )


def ordered_output(df: DataFrame, cols: Sequence[str] = ("SearchTerm", "Title")) -> DataFrame:
    """Total order for a sink: a range shuffle, so only as the last step."""
    return df.orderBy(*cols)
