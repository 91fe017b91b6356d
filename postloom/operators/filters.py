"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_string, count_words


def has_link(df: DataFrame, link: str = "Link") -> DataFrame:
    return df.where(clean_string(F.col(link)) != "")


def drop_missing(df: DataFrame, cols: Sequence[str] = ("Title", "Description")) -> DataFrame:
    return df.dropna(subset=list(cols))


def min_words(df: DataFrame, n: int = 15, text: str = "Description") -> DataFrame:
    """Strictly more than ``n`` words."""
    return df.where(count_words(F.col(text)) > n)


def job_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("prediction") == "job")


def not_outlier(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.where(F.col(topic) != -1)


def misclassified(preds: DataFrame, target: str = "JOB") -> DataFrame:
    """Target class on exactly one side, either way round."""
    return preds.where((F.col("true") == target) != (F.col("pred") == target))


def over_limit(df: DataFrame, limit: int = 512, measure: str = "n_tokens") -> DataFrame:
    """One row: texts, texts over the limit, and their share in percent."""
    over: Column = F.count_if(F.col(measure) > limit)
    return df.agg(F.count("*").alias("n_texts"), over.alias("n_over")).withColumn(
        "pct_over", F.round(F.col("n_over") / F.greatest(F.col("n_texts"), F.lit(1)) * 100, 2)
    )


def rename_select(df: DataFrame, mapping: dict[str, str], first: Sequence[str] = ()) -> DataFrame:
    """Keep and rename the mapped columns, key columns in front."""
    return df.select(*first, *[F.col(a).alias(b) for a, b in mapping.items() if a not in first])
