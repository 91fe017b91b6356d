"""Keeping the first of equal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text


def dedupe_posts(
    posts: DataFrame,
    subset: Sequence[str] = ("Title", "Description"),
    key: str = "row_key",
    normalize_first: bool = False,
) -> DataFrame:
    """First row (by ``key``) of every distinct ``subset``; nulls are equal.

    Copies fold on the map side, so a text that fills a third of the table
    still reaches the reducers as one row per map task. The leading hash keeps
    the sort on a number where whole rows must be carried.
    """
    if normalize_first:
        posts = posts.withColumns({c: normalize_text(F.col(c)) for c in subset})
    rest = [c for c in posts.columns if c not in subset and c != key]
    if not rest:
        return posts.groupBy(*subset).agg(F.min(key).alias(key)).select(*posts.columns)
    first = F.min(F.struct(key, *rest)).alias("_first")
    return (
        posts.groupBy(F.xxhash64(*subset).alias("_h"), *subset)
        .agg(first)
        .select(*[F.col(c) if c in subset else F.col(f"_first.{c}").alias(c) for c in posts.columns])
    )
