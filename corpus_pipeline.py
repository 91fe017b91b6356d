"""From raw documents to packed sequences: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept, as Parquet in the shared folder,
and all but the last return the columns of ``documents``. Toxicity drops the
documents that the model calls toxic; near-duplicate detection leaves one
document of each group; the secret scan replaces live and shared credential values;
the mix leaves out or repeats documents; packing places every token.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.mixing import mixed_rows
from postloom.llm.near_dedup import near_groups
from postloom.llm.packing import pack
from postloom.llm.queries import VOCABULARY
from postloom.llm.secrets import redact_secrets
from postloom.llm.store import stored, table
from postloom.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on their labels does not reject.

    Rows that repeat an id and a text share their score; null and empty texts are
    scored as empty; long texts are read whole. Other columns pass, whatever their names. No rows
    give no rows.
    """
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, then the smallest hash of a text.

    A group of null ids keeps one row as well. Null and blank texts are in no group; of
    rows alike in id and text one stays. No rows give no rows.
    """
    own = near_groups(docs).where("kept").select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("group_key").alias("_group"))
    first = own.where("_group is not null").groupBy("_group").agg(F.min(F.struct("_doc", "_t")).alias("_one")).select("_one.*")
    kept = first.union(own.where("_group is null").select("_doc", "_t")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_x"))
    met = rows.join(kept, F.col("_x").eqNullSafe(F.col("_t")) & F.col("_id").eqNullSafe(F.col("_doc")))
    return met.dropDuplicates(["_id", "_x"]).select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live and shared credentials masked.

    Every row stays, repeated ones and those with null ids or texts as well; only
    text and n_chars change. No rows give no rows.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Repeated rows are documents of their own; a null source is a source; null and
    empty texts weigh nothing and stay out of the count. No rows give no rows.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset.

    Every row is packed, repeated ones and null ids too; a null or empty text is one
    token, a long one is cut. No rows give no rows.
    """
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Training and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
