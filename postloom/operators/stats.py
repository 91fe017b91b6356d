"""Counters, length summaries and classifier quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_lengths
from ..schema import STAT_COLUMNS

PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def with_lengths(df: DataFrame, text: str = "Description", tokenizer=None) -> DataFrame:
    return df.withColumns(text_lengths(F.coalesce(F.col(text), F.lit("")), tokenizer))


def length_summary(
    df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = PERCENTILES, exact: bool = True
) -> DataFrame:
    """One row per measure. Exact percentiles keep one counter per distinct
    length on each side of the shuffle; ``exact=False`` uses sketches."""
    quantile = F.percentile if exact else F.approx_percentile
    names = ["count", "mean", "std", "min", *[f"p{round(p * 100)}" for p in percentiles], "max"]

    def of(c: str) -> list[Column]:
        v = F.col(c).cast("double")
        values = [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), *[quantile(v, F.lit(p)) for p in percentiles], F.max(v)]
        return [x.cast("double").alias(f"{c}__{n}") for n, x in zip(names, values)]

    wide = df.agg(*[x for c in cols for x in of(c)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), *[F.round(F.col(f"{c}__{n}"), 2).alias(n) for n in names])
            for c in cols
        ]
    )
    return wide.select(F.inline(rows)).withColumn("count", F.col("count").cast("bigint"))


def crawl_totals(stats: DataFrame, terms: DataFrame) -> DataFrame:
    """Counters of every requested term (zeros where a term has none) and the
    grand total, as ``(search_term, is_total, counters...)``."""
    full = terms.select("search_term").distinct().join(stats, "search_term", "left").fillna(0, list(STAT_COLUMNS))
    return (
        full.rollup("search_term")
        .agg(F.grouping("search_term").cast("int").alias("is_total"), *[F.sum(c).alias(c) for c in STAT_COLUMNS])
        .withColumn("search_term", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("search_term")))
    )


def _cells(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by, "true", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(true, pred, n) for every pair of known classes, zeros included."""
    cells = _cells(preds, by)
    # One row per model: its classes and its non-zero cells, both tiny.
    packed = cells.groupBy(*by).agg(
        F.array_union(F.collect_set("true"), F.collect_set("pred")).alias("classes"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("true", "pred"), "n"))).alias("cells"),
    )
    grid = packed.select(*by, "classes", "cells", F.explode("classes").alias("true"))
    grid = grid.select(*by, "cells", "true", F.explode("classes").alias("pred"))
    hit = F.try_element_at("cells", F.struct("true", "pred"))
    return grid.select(*by, "true", "pred", F.coalesce(hit, F.lit(0)).cast("bigint").alias("n"))


def class_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    right = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    wrong = F.col("n") - right
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("true").alias("label"), right.alias("tp"), none.alias("fp"), wrong.alias("fn")),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), wrong.alias("fp"), none.alias("fn")),
    )
    summed = (
        _cells(preds, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    return summed.select(
        *by,
        "label",
        _share("tp", F.col("tp") + F.col("fp")).alias("precision"),
        _share("tp", F.col("tp") + F.col("fn")).alias("recall"),
        _share(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
        "tp",
    )


def _share(part: Column | str, whole: Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    per = class_metrics(preds, by)
    scores = ("precision", "recall", "f1")
    packed = per.groupBy(*by).agg(
        F.collect_list(F.struct("label", *scores, "support")).alias("rows"),
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support")).alias("acc"),
        *[F.avg(s).alias(f"m_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(f"w_{s}") for s in scores],
    )

    def summary(name: str, cols: Sequence[str]) -> Column:
        return F.struct(F.lit(name).alias("label"), *[F.col(c).alias(s) for c, s in zip(cols, scores)], F.col("support"))

    extra = F.array(
        summary("accuracy", ["acc"] * 3),
        summary("macro avg", [f"m_{s}" for s in scores]),
        summary("weighted avg", [f"w_{s}" for s in scores]),
    )
    out = packed.select(*by, F.inline(F.concat("rows", extra)))
    return out.withColumns({s: F.round(s, 6) for s in scores})


def macro_f1(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_metrics(preds, by).groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def span_prf(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact-match span scores per label and over all (label ``ALL``).

    Both sides are tagged and grouped on the span, which combines on the map
    side, instead of being joined.
    """
    tagged = gold.select(*keys, "label", F.lit(1).alias("g"), F.lit(0).alias("p")).union(
        pred.select(*keys, "label", F.lit(0), F.lit(1))
    )
    spans = tagged.groupBy(*keys, "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = spans.rollup("label").agg(
        F.grouping("label").alias("_all"),
        F.sum(F.col("g") * F.col("p")).alias("tp"),
        F.sum("g").alias("n_gold"),
        F.sum("p").alias("n_pred"),
    )
    return sums.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("label")).alias("label"),
        F.round(_share("tp", F.col("n_pred")), 6).alias("precision"),
        F.round(_share("tp", F.col("n_gold")), 6).alias("recall"),
        F.round(_share(F.col("tp") * 2, F.col("n_gold") + F.col("n_pred")), 6).alias("f1"),
    )
