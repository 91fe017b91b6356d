"""From cleaned paragraphs to topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import topics as T
from ..operators.embed import Encoder, as_array, embed_text, reduce_dims
from ..operators.density_tree import density_tree
from ..operators.neighbours import knn_graph
from ..operators.spectral import spectral_embedding
from ..session import settle
from ..sources.files import require_columns
from .clean import join_paragraphs


@dataclass
class Topics:
    info: DataFrame
    documents: DataFrame
    means: DataFrame
    weights: DataFrame
    vectors: DataFrame


def without_blanks(rows: DataFrame) -> DataFrame:
    """Paragraphs with text; a post without any keeps its first one, empty."""
    full = strip(F.col("text")) != ""
    first = F.min(F.struct((~full).alias("blank"), "par_id")).over(Window.partitionBy("des_id"))
    kept = rows.withColumn("_first", first).where(full | (F.col("_first.blank") & (F.col("par_id") == F.col("_first.par_id"))))
    return kept.drop("_first")


def embedded_documents(paras: DataFrame, mean: bool, encoder: Encoder | None, features: int) -> DataFrame:
    """(doc_id, des_id, par_id, text, embedding), one row per document."""
    rows = require_columns(paras).select("des_id", "par_id", F.coalesce("Description", F.lit("")).alias("text"))
    if mean:
        rows = without_blanks(rows)
    vectors = embed_text(rows, "text", encoder, features=features)
    if not mean:
        return T.with_uid(vectors).withColumnRenamed("par_uid", "doc_id")
    pooled = T.pool_paragraph_vectors(as_array(vectors, "embedding", "_v").select("des_id", "_v"), "_v")
    texts = join_paragraphs(rows, "text", out="text")
    return pooled.join(texts, "des_id").select(
        F.concat(F.lit("D"), F.col("des_id").cast("string")).alias("doc_id"),
        "des_id",
        F.lit(None).cast("int").alias("par_id"),
        "text",
        array_to_vector("pooled").alias("embedding"),
    )


def discover_topics(
    paras: DataFrame,
    mean: bool = False,
    reduce: bool | str = True,
    encoder: Encoder | None = None,
    dims: int = 10,
    features: int = 256,
    min_cluster_size: int = 50,
    min_samples: int = 15,
    epsilon: float = 0.1,
    stop_words: Sequence[str] | None = None,
) -> Topics:
    """Embed, reduce, cluster and describe paragraphs (or pooled posts).

    ``reduce``: principal components, nothing, or "graph" for the eigenvectors of the
    neighbour graph. A document's probability is how long it stays in its
    cluster beside those that stay longest, 0 for outliers. What several
    results share is written once to the shared folder.
    """
    docs = embedded_documents(paras, mean, encoder, features)
    if reduce == "graph":
        docs = settle(as_array(docs, out="_v"))
        axes = spectral_embedding(knn_graph(docs.select(F.col("doc_id").alias("id"), F.col("_v").alias("v"))), dims).vectors
        # Columns have unit length over all documents; distances are told in units of one.
        scale = docs.count() ** 0.5
        axes = axes.select(F.col("id").alias("doc_id"), array_to_vector(F.transform("v", lambda x: x * scale)).alias("embedding"))
        docs = docs.drop("embedding", "_v").join(axes, "doc_id")
    elif reduce:
        docs = reduce_dims(settle(docs), dims).drop("embedding").withColumnRenamed("reduced", "embedding")
    docs = settle(as_array(docs).drop("embedding"))
    clusters = settle(density_tree(docs.select(F.col("doc_id").alias("id"), "v"), min_cluster_size, min_samples, epsilon).withColumnRenamed("id", "doc_id"))
    assigned = T.assign_topics(clusters, key="doc_id").join(clusters.select("doc_id", F.col("strength").alias("probability")), "doc_id")
    assigned = settle(assigned)
    placed = settle(docs.join(assigned.drop("probability"), "doc_id"))
    weights = T.class_tfidf(T.topic_terms(placed, stop_words=stop_words, totals=True))
    sizes = placed.groupBy("topic").agg(F.count("*").alias("count"))
    info = settle(T.topic_info(weights, sizes))
    representatives = T.representative_docs(T.document_term_parts(placed, stop_words=stop_words), weights)
    documents = T.document_info(placed.select("doc_id", "des_id", "par_id", "text"), assigned, info, representatives)
    return Topics(info, documents, T.topic_mean_probability(assigned, info), weights, placed.select("doc_id", "v", "topic"))


def save_topics(topics: Topics, path: str) -> None:
    """One Parquet table per part below ``path``; parts that are there are replaced."""
    for part in fields(Topics):
        getattr(topics, part.name).write.mode("overwrite").parquet(f"{path}/{part.name}")


def load_topics(spark: SparkSession, path: str) -> Topics:
    """What ``save_topics`` wrote; a missing part is an error."""
    return Topics(**{part.name: spark.read.parquet(f"{path}/{part.name}") for part in fields(Topics)})
