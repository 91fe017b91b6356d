"""Repeatable samples and splits by hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement; each task keeps its own ``n`` smallest."""
    ranked = df.withColumn("_h", shuffle_hash(key, seed))
    return ranked.orderBy("_h", key).limit(n).drop("_h")


def sample_split(df: DataFrame, n: int, seed: int, key: str, n_first: int = 150) -> DataFrame:
    """A sample of ``n``: the first ``n_first`` train, the rest test, each
    numbered from 0. The window sees the sample only."""
    place = F.row_number().over(Window.orderBy(shuffle_hash(key, seed), key)) - 1
    return (
        sample_n(df, n, seed, key)
        .withColumn("_p", place)
        .withColumn("split", F.when(F.col("_p") < n_first, "train").otherwise("test"))
        .withColumn("id", F.when(F.col("_p") < n_first, F.col("_p")).otherwise(F.col("_p") - n_first))
        .drop("_p")
    )


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 10) -> DataFrame:
    """Adds ``split``: exactly ``round(test * n)`` test rows of every label.

    A label may be most of the table, so no label is ever sorted as a whole.
    Counts per (label, hash prefix) find the prefix in which the cut falls;
    only the rows of that prefix are ranked, and every row is then compared
    with the cut of its label.
    """
    h = shuffle_hash(key, seed)
    keyed = df.select(F.col(label).alias("_label"), h.alias("_h"), F.col(key).alias("_k"))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, 3))
    counts = keyed.groupBy("_label", "_b").agg(F.count("*").alias("_n"))
    # At most 4096 prefixes per label.
    by_label = Window.partitionBy("_label")
    below = F.sum("_n").over(by_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    bounds = (
        counts.withColumn("_below", F.coalesce(below, F.lit(0)))
        .withColumn("_want", F.round(F.sum("_n").over(by_label) * test).cast("bigint"))
        .where((F.col("_below") < F.col("_want")) & (F.col("_want") <= F.col("_below") + F.col("_n")))
        .select("_label", "_b", (F.col("_want") - F.col("_below")).alias("_rank"))
    )
    inside = keyed.join(bounds, ["_label", "_b"])
    rank = F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_h", "_k"))
    cut = (
        inside.withColumn("_r", rank)
        .where(F.col("_r") == F.col("_rank"))
        .select(F.col("_label").alias(label), F.struct("_h", "_k").alias("_cut"))
    )
    mine = F.struct(h.alias("_h"), F.col(key).alias("_k"))
    marked = df.join(cut, label, "left").withColumn(
        "split", F.when(F.col("_cut").isNotNull() & (mine <= F.col("_cut")), "test").otherwise("train")
    )
    return marked.drop("_cut")
