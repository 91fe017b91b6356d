"""Structured Streaming jobs over folders that keep receiving files.

Every micro-batch writes what it adds into a part named after its batch
number. Repeating a batch after a failure replaces that part, so a result never
counts anything twice. Parts are folded in levels (``parts``): a row is rewritten
once a level, and a read sees a few parts, not all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import dedupe_posts
from ..operators.filters import drop_missing
from ..operators.merge import clean_posts, first_seen_parts, join_seen_parts, longest
from ..plans.clean import Scorer, clean_corpus
from ..schema import POST_COLUMNS, STAT_COLUMNS
from ..session import settle
from . import parts

_TEXTS = ("Title", "Description", "Qualifications")


# --- merge -----------------------------------------------------------------------


def _fold_picks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Link").agg(*[F.min(c).alias(c) for c in _TEXTS])


def _fold_terms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Link", "part").agg(F.min("seen").alias("seen"))


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _reader(rows: DataFrame) -> parts.Read:
    """Reads parts of rows like these; their columns are known, so no file is opened to learn them."""
    return lambda paths: rows.sparkSession.read.schema(rows.schema).parquet(*paths)


def stream_merge(src: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep one mergeable record per link and part; ``read_merged`` folds them.

    The picks are minima and the terms carry the place of first sight, so the
    fold of the parts equals a merge of all rows at once, whatever the levels.
    """

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        cleaned = clean_posts(rows)
        picks = cleaned.groupBy("Link").agg(*[longest(F.col(c)).alias(c) for c in _TEXTS])
        terms = first_seen_parts(cleaned, "Link", "SearchTerm")
        parts.add(spark, f"{table}/picks", batch, picks, _reader(picks), _fold_picks, _write)
        parts.add(spark, f"{table}/terms", batch, terms, _reader(terms), _fold_terms, _write)

    return (
        src.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_merged(spark: SparkSession, table: str) -> DataFrame:
    """The merged posts as of the batches written so far: a link is read once a part, at most FAN - 1 of a level."""
    picks = _fold_picks(spark.read.parquet(*parts.paths(spark, f"{table}/picks")))
    seen = _fold_terms(spark.read.parquet(*parts.paths(spark, f"{table}/terms")))
    picks = picks.select("Link", *[F.col(f"{c}.value").alias(c) for c in _TEXTS])
    merged = picks.join(join_seen_parts(seen, "Link", "SearchTerm"), "Link", "left")
    return merged.fillna("", ["SearchTerm"]).select(*POST_COLUMNS)


# --- clean -----------------------------------------------------------------------


def seen_digests(spark: SparkSession, table: str, until: int, prefixes: list[str]) -> DataFrame:
    """Digests of batches before ``until``, of the given prefixes; folders of other prefixes are not opened."""
    return _read_digests(spark, parts.paths(spark, table, until)).where(F.col("prefix").isin(prefixes))


def _read_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    shape = "digest string, prefix string"
    if not paths:
        return spark.createDataFrame([], shape)
    root = paths[0].rsplit("/level=", 1)[0]
    return spark.read.schema(shape).option("basePath", root).parquet(*paths).select("digest", "prefix")


def _write_digests(rows: DataFrame, path: str) -> None:
    rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def stream_clean(
    src: DataFrame, out: str, checkpoint: str, scorer: Scorer, gazetteer: DataFrame | None = None, key: str = "row_key", digits: int = 2, **options
) -> StreamingQuery:
    """Clean posts that no earlier batch has seen.

    Seen posts are known by a digest of their title and text. Digests lie in folders
    by their first hexadecimal ``digits``, 16 ** digits at most, and a batch reads the
    folders that its own digests name: choose more digits for small batches over a long
    history. Only digests that the batch holds come back from them, so the long side is
    never the unique one.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        digest = F.sha2(F.concat_ws("\x00", "Title", "Description"), 256)
        unique = dedupe_posts(drop_missing(rows.select(key, "Title", "Description")), key=key)
        fresh = unique.withColumn("digest", digest).withColumn("prefix", F.concat(F.lit("p"), F.substring("digest", 1, digits)))
        fresh = settle(fresh)
        touched = sorted(r.prefix for r in fresh.select("prefix").distinct().collect())  # at most 16 ** digits
        known = seen_digests(spark, f"{out}/seen", batch, touched).join(fresh.select("digest"), "digest", "left_semi")
        fresh = settle(fresh.join(known.select("digest"), "digest", "left_anti"))
        cleaned = clean_corpus(fresh.drop("digest", "prefix"), scorer, gazetteer, key=key, **options)
        cleaned.write.mode("overwrite").parquet(f"{out}/paragraphs/batch={batch}")
        read = lambda paths: _read_digests(spark, paths)
        parts.add(spark, f"{out}/seen", batch, fresh.select("digest", "prefix"), read, lambda d: d, _write_digests)

    return (
        src.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_cleaned(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/paragraphs").select("des_id", "par_id", "Description")


# --- counters --------------------------------------------------------------------


def crawl_counters(events: DataFrame) -> DataFrame:
    """(search_term, is_total, counters...) of an event stream or table.

    The state is one row per term and the total.
    """
    kind = F.col("event_type")
    counted = events.rollup("search_term").agg(
        F.grouping("search_term").cast("int").alias("is_total"),
        F.count_if(kind.isin("view", "error")).alias("pages_attempted"),
        F.count_if(kind == "view").alias("pages_visited"),
        F.count_if(kind == "purchase").alias("jobs_collected"),
        F.count_if(kind.isin("click", "purchase")).alias("links_discovered"),
    )
    name = F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("search_term"))
    failures = F.col("links_discovered") - F.col("jobs_collected")
    return counted.withColumn("job_parse_failures", failures).select(
        name.alias("search_term"), "is_total", *STAT_COLUMNS
    )


def stream_crawl_stats(src: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counters per term; each batch leaves the complete state."""

    def save(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        crawl_counters(src)
        .writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_crawl_stats(spark: SparkSession, out: str) -> DataFrame:
    """The state of the last batch."""
    states = spark.read.parquet(out)
    return states.where(F.col("batch") == states.agg(F.max("batch")).scalar()).drop("batch")
