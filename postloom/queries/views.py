"""Derived inputs: the given tables seen as posts, paragraphs, topics and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.labels import label_to_class, predict_label
from ..session import spread, written

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# A short stop list keeps the SQL counterparts readable.
STOP_WORDS = ("the", "and", "of", "to", "in", "for", "der", "die", "und", "de", "la", "que", "les", "el", "en")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id as row key; every Link but the empty ones comes from the title."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_key"),
        F.concat(F.lit("run_"), "lang", F.lit(".csv")).alias("source_file"),
        F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit(" | "), "lang"))
        .otherwise(F.col("source"))
        .alias("SearchTerm"),
        F.when(F.col("doc_id") % 41 != 0, title).alias("Title"),
        F.col("text").alias("Description"),
        F.expr("slice(split(text, '\n'), 2, greatest(size(split(text, '\n')) - 1, 0))").alias("Qualifications"),
        F.when(F.col("doc_id") % 50 == 0, "")
        .otherwise(F.concat(F.lit("https://jobs.example.org/job/"), F.md5(F.encode(title, "UTF-8"))))
        .alias("Link"),
    )


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their qualifications joined to one cell."""
    return posts(spark, sf_dir).withColumn("Qualifications", F.array_join("Qualifications", " | "))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("des_id"), F.col("text").alias("Description"))


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("des_id"), F.col("text").alias("_text"))
    return explode_once(docs, ["des_id"], F.split("_text", "\n"), "text", "par_id")


def rule_scores(df: DataFrame) -> DataFrame:
    """Stand-in class probabilities from the keys of a paragraph."""

    def part(a: int, b: int, m: int):
        return ((F.col("des_id") * a + F.col("par_id") * b) % m + 1).cast("double")

    a, b, c = part(7, 3, 97), part(5, 11, 89), part(3, 13, 83)
    return df.withColumns(
        {"prob_job": a / (a + b + c), "prob_blurb_legal": b / (a + b + c), "prob_offer_detail": c / (a + b + c)}
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_scores(paras(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = predict_label(F.col("prob_job"), F.col("prob_blurb_legal"), F.col("prob_offer_detail"))
    return scored(spark, sf_dir).withColumn("prediction", label)


def labels3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "CONDITIONS").when(F.col("quality") == 1, "JOB").otherwise("CONTEXT").alias("label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models: the label rule, and two that lean on one column."""
    given = labels3(spark, sf_dir).select(F.col("doc_id").alias("des_id"), F.col("label").alias("true"))
    rule = label_to_class(predict_label(F.col("prob_job"), F.col("prob_blurb_legal"), F.col("prob_offer_detail")))
    models = F.array(
        F.struct(F.lit("rule").alias("model_name"), rule.alias("pred")),
        F.struct(
            F.lit("keen").alias("model_name"), F.when(F.col("prob_job") > 0.3, "JOB").otherwise("CONTEXT").alias("pred")
        ),
        F.struct(
            F.lit("shy").alias("model_name"), F.when(F.col("prob_job") > 0.6, "JOB").otherwise("CONDITIONS").alias("pred")
        ),
    )
    return given.join(scored(spark, sf_dir), "des_id").select(
        "des_id",
        "par_id",
        "text",
        F.col("prob_job").alias("p_JOB"),
        F.col("prob_blurb_legal").alias("p_CONTEXT"),
        F.col("prob_offer_detail").alias("p_CONDITIONS"),
        "true",
        F.inline(models),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("des_id"),
        (F.col("vec_id") % 5).cast("int").alias("par_id"),
        "embedding",
        "label",
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors pulled towards their label's axis, so that groups exist; unit length."""
    from ..functions.vectors import l2_normalize

    odd = F.col("vec_id") % 25 == 0
    v = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * F.when(odd, 1.0).otherwise(0.07)
        + F.when(~odd & (i == F.col("label")), 1.0).otherwise(0.0),
    )
    raw = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))
    return raw.select(F.col("vec_id").alias("id"), "label", l2_normalize(F.col("v")).alias("v"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the label of a vector; vectors are reused in turn."""
    # Written without the vectors, so that Spark sees how small they are and shuffles no texts.
    given = written(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("topic")), "given-topics")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("vec_id", F.col("doc_id") % given.agg(F.count("*")).scalar())
    return docs.join(given, "vec_id").select("doc_id", "topic", "text")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("t")
    return (
        table(spark, sf_dir, "benchmark").select(words).where(F.length("t") >= 9).select(F.lower("t").alias("token")).distinct()
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stats = (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("term "), (F.col("user_id") % 6).cast("string")).alias("search_term"))
        .agg(
            F.count_if(kind.isin("view", "error")).alias("pages_attempted"),
            F.count_if(kind == "view").alias("pages_visited"),
            F.count_if(kind == "purchase").alias("jobs_collected"),
            F.count_if(kind.isin("click", "purchase")).alias("links_discovered"),
        )
    )
    return stats.select(
        "search_term",
        "pages_attempted",
        "pages_visited",
        "jobs_collected",
        (F.col("links_discovered") - F.col("jobs_collected")).alias("job_parse_failures"),
        "links_discovered",
    )
