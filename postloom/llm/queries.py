"""The named queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import sql
from postloom.llm.collision_search import search
from postloom.llm.cost_packing import pack_by_cost
from postloom.llm.filter_audit import audit
from postloom.llm.hard_negatives import labelled, mine
from postloom.llm.licenses import scan_licenses
from postloom.llm.mixing import mix_by_source
from postloom.llm.near_dedup import near_duplicates
from postloom.llm.packing import pack
from postloom.llm.quality import quality
from postloom.llm.secrets import scan_secrets
from postloom.llm.store import table
from postloom.llm.toxicity import score, train
from postloom.llm.url_lists import evaluate, host_of
from postloom.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
_DAY0 = "2024-01-01"


def _drawn(value: Column) -> Column:
    """A number from 0 to 65,535 made of a text."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 4), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of four lists for a part of the hosts and parent domains in ``pages``."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    parents = hosts.select(F.split("domain", r"\.").alias("x")).where(F.size("x") > 2).select(F.array_join(F.slice("x", 2, 100), ".").alias("domain")).distinct()
    day = lambda n: F.date_add(F.lit(_DAY0).cast("date"), n)

    def entry(df: DataFrame, name: str, verdict: str, prefix: str, action: str, when: Column, n: Column) -> DataFrame:
        return df.where(when).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), "domain", F.lit(prefix).alias("prefix"), F.lit(action).alias("action"), day(n).alias("day"))

    h, p = hosts.withColumn("k", _drawn(F.col("domain"))), parents.withColumn("k", _drawn(F.col("domain")))
    k = F.col("k")
    rows = [
        entry(h, "spam", "block", "/", "add", k % 3 == 0, k % 300),
        entry(h, "spam", "block", "/", "remove", k % 3 == 0, k % 300 + 30 + k % 120),
        entry(h, "spam", "block", "/", "add", k % 6 == 0, k % 300 + 200),
        entry(h, "mirrors", "block", "/fr", "add", k % 5 == 0, k % 100),
        entry(h, "trusted", "allow", "/", "add", k % 7 == 0, k % 250),
        entry(p, "adult", "block", "/", "add", k % 4 == 0, k % 200),
        entry(p, "adult", "block", "/", "remove", k % 4 == 0, k % 200 + 100),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, each fetched on a day of 2024 made of its id, against lists as of that day."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.withColumn("day", F.date_add(F.lit(_DAY0).cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    return evaluate(captures, list_entries(pages))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of all documents for source weights 5, 2, 1."""
    return mix_by_source(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("t")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans of all documents, judged by ownership."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("t", "found")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return quality(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of all embeddings for every twentieth."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"), 20)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding among all."""
    rows = labelled(table(spark, sf_dir, "embeddings"))
    return mine(rows, rows.where("vec_id % 50 = 0"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens and like costs."""
    return pack_by_cost(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents in all orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_mixing, op3_warc, op4_packing, op5_near_dedup, op6_secrets, op7_line_quality, op8_toxicity, op9_collision_search, op10_licenses,
        op11_hard_negatives, op12_cost_packing, op13_filter_audit,
    )
}
#: DuckDB counterparts of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {"op1_url_filters": sql.URL_FILTERS, "op3_warc": sql.WARC, "op5_near_dedup": sql.NEAR_DEDUP, "op7_line_quality": sql.LINE_QUALITY, "op11_hard_negatives": sql.HARD_NEGATIVES, "op13_filter_audit": sql.FILTER_AUDIT}
