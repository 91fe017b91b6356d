"""Key joins. Which side travels is left to the measured sizes at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_md5


def keep_surviving_posts(paras: DataFrame, posts: DataFrame) -> DataFrame:
    return paras.join(posts.select("des_id"), "des_id", "left_semi")


def exclude_annotated(paras: DataFrame, annotated: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs whose text hash is not in ``annotated.text_md5``.

    The annotated hashes are made distinct first, so a text that is repeated
    very often meets one row and the join cannot multiply.
    """
    done = annotated.select("text_md5").distinct()
    return paras.withColumn("text_md5", text_md5(F.col(text))).join(done, "text_md5", "left_anti")


def topic_names(means: DataFrame, info: DataFrame) -> DataFrame:
    return means.join(info.select("topic", "name"), "topic", "left")


def attach_scores(paras: DataFrame, scores: DataFrame) -> DataFrame:
    return paras.join(scores, ["des_id", "par_id"])


def posts_with_clean_text(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """Posts that have a cleaned text, carrying it as their Description."""
    return posts.drop("Description").join(texts.select("des_id", "Description"), "des_id")
