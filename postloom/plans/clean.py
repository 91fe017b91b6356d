"""From merged posts to job-relevant, entity-free paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import predict_label
from ..functions.text import count_words, normalize_text
from ..operators.dedupe import dedupe_posts
from ..operators.entities import strip_entities
from ..operators.filters import drop_missing, job_only, min_words
from ..operators.joins import posts_with_clean_text
from ..operators.segment import make_paragraphs
from ..session import written

# (des_id, par_id, text) -> the same rows with prob_job, prob_blurb_legal, prob_offer_detail
Scorer = Callable[[DataFrame], DataFrame]


def normalized_docs(posts: DataFrame, key: str = "row_key") -> DataFrame:
    return posts.select(F.col(key).alias("des_id"), normalize_text(F.col("Description")).alias("Description"))


def label_paragraphs(docs: DataFrame, scorer: Scorer, **segment_options) -> DataFrame:
    """(des_id, par_id, text, prediction)."""
    scored = scorer(make_paragraphs(docs, **segment_options))
    label = predict_label(F.col("prob_job"), F.col("prob_blurb_legal"), F.col("prob_offer_detail"))
    return scored.select("des_id", "par_id", "text", label.alias("prediction"))


def join_paragraphs(paras: DataFrame, text: str = "text", sep: str = "\n\n", out: str = "Description") -> DataFrame:
    """(des_id, text of the post): a group is one post, read from one cell."""
    ordered = F.sort_array(F.collect_list(F.struct("par_id", F.col(text).alias("t"))))
    return paras.groupBy("des_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), sep).alias(out))


def keep_long_posts(paras: DataFrame, min_word_count: int = 15, text: str = "text") -> DataFrame:
    """Paragraphs of posts with more than ``min_word_count`` words in all.

    Words of a join are the words of its parts, so one shuffle by post does
    for the grouping and the way back.
    """
    total = F.sum(count_words(F.col(text))).over(Window.partitionBy("des_id"))
    return paras.withColumn("_words", total).where(F.col("_words") > min_word_count).drop("_words")


def clean_corpus(
    posts: DataFrame,
    scorer: Scorer,
    gazetteer: DataFrame | None = None,
    clean_sentences: bool = True,
    maintain_paragraphs: bool = True,
    min_word_count: int = 15,
    key: str = "row_key",
    normalize_first: bool = False,
    tagger=None,
    **segment_options,
) -> DataFrame:
    """(des_id, par_id, Description), or the posts with their text replaced.

    Duplicates go on the raw texts before the costly steps; the word filter
    runs before entities are removed.
    """
    columns = [key, "Title", "Description"] if maintain_paragraphs else posts.columns
    unique = dedupe_posts(drop_missing(posts.select(*columns)), key=key, normalize_first=normalize_first)
    jobs = job_only(label_paragraphs(normalized_docs(unique, key), scorer, **segment_options)).drop("prediction")
    if maintain_paragraphs:
        kept = keep_long_posts(jobs, min_word_count).withColumnRenamed("text", "Description")
    else:
        kept = min_words(join_paragraphs(jobs), min_word_count)
    if clean_sentences and (gazetteer is not None or tagger is not None):
        if tagger is None:
            # Names are looked up in the texts and then taken out of them: cut and scored once, read twice.
            kept = written(kept, "kept-paragraphs")
        kept = strip_entities(kept, gazetteer, tagger=tagger)
    kept = kept.withColumn("Description", normalize_text(F.col("Description")))
    if maintain_paragraphs:
        return kept.select("des_id", "par_id", "Description")
    return posts_with_clean_text(unique.withColumnRenamed(key, "des_id"), kept)


def label_audit(posts: DataFrame, scorer: Scorer, key: str = "row_key", **segment_options) -> DataFrame:
    """Kept paragraphs with their label: no deduplication, no further cleaning."""
    docs = normalized_docs(drop_missing(posts, ["Description"]), key)
    return job_only(label_paragraphs(docs, scorer, **segment_options))
