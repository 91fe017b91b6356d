"""Run files, reports, annotation files and models on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import join_list
from ..functions.text import slugify
from ..schema import CLASS_ANNOTATION, PARAGRAPH_COLUMNS, POST_COLUMNS, RUN_REPORT, STAT_COLUMNS
from ..session import scratch_path

# Cell contents that count as missing.
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")

# --- reading run files -----------------------------------------------------------

# Fixed value: one cell of a header line, quoted or bare, after the line's start or a comma.
_HEADER_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _header_cells(line: Column) -> Column:
    """The cells of a header line, quotes undone and the byte-order mark off."""
    cells = F.regexp_extract_all(F.regexp_replace(line, "^﻿", ""), F.lit(_HEADER_CELL), F.lit(1))
    inner = lambda c: F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), '""', '"')
    return F.transform(cells, lambda c: F.when(c.rlike('(?s)^".*"$'), inner(c)).otherwise(c))


def _noted(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a row a file, with the size that Spark then weighs in joins."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def list_run_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, columns, has_rows): the header cells of every matching file, found by a Spark job.

    file is the path as ``_metadata.file_path`` states it. Lines are numbered within
    the scan; the first number of each file and its lines with text are counted on
    the map side and written, so that Spark knows their size and broadcasts them to the
    lines while they are small; more are joined by number, which no file makes hot. No file
    is opened by the driver. Empty and unreadable files have null columns; has_rows says
    whether anything but blanks follows the header. No match gives no rows.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    if not list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []):
        return spark.createDataFrame([], "file string, columns array<string>, has_rows boolean")
    names = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"))
    lines = (
        spark.read.option("ignoreCorruptFiles", True).text(pattern)
        .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("begin"), "value")
    )
    filled = F.count_if(F.trim("value") != "")
    first = F.min(F.when(F.col("begin") == 0, F.col("at")))
    counted = _noted(lines.groupBy("file").agg(first.alias("at"), filled.alias("filled")), "run-lines")
    headers = lines.select("at", "value").join(counted, "at").select(
        "file", _header_cells(F.col("value")).alias("columns"), (F.col("filled") > (F.trim("value") != "").cast("int")).alias("has_rows")
    )
    return names.join(headers, "file", "left").select("file", "columns", F.coalesce("has_rows", F.lit(False)).alias("has_rows"))


def validate_columns(files: DataFrame, expected: Sequence[str] = POST_COLUMNS) -> DataFrame:
    """(file, missing, usable) for a listing with ``columns``, and maybe ``has_rows``: a file without rows is of no use."""
    want = F.array(*[F.lit(c) for c in expected])
    missing = F.array_except(want, F.coalesce("columns", F.array().cast("array<string>")))
    filled = F.col("has_rows") if "has_rows" in files.columns else F.lit(True)
    return files.withColumn("missing", missing).select("file", "missing", ((F.size("missing") == 0) & filled).alias("usable"))


def require_columns(df: DataFrame, expected: Sequence[str] = PARAGRAPH_COLUMNS) -> DataFrame:
    absent = [c for c in expected if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def read_runs(
    spark: SparkSession,
    pattern: str,
    expected: Sequence[str] = POST_COLUMNS,
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """Posts of all usable run files, with ``source_file`` and ``row_key``.

    Files that miss a column are left out (``validate_columns`` tells which), as
    are files with a header only. All files are read in one scan of bare cells; each
    file's header says at which place a column stands, so layouts may differ and need no
    groups on the driver, which learns the number of cells of the widest header alone.
    row_key is text of fixed length: the digest of the file's full path, 128 bits,
    and the row's place in the file. It is the same on every read, unlike in any
    other file, and grows down the file. First numbers are minima that combine on the
    map side; they are written with the layouts, a row a file, and meet the rows by path,
    without a shuffle of texts while Spark finds that table small enough to broadcast.
    """
    listing = _noted(list_run_files(spark, pattern).where("has_rows"), "run-files")
    usable = listing.join(validate_columns(listing, expected).where("usable").select("file"), "file", "left_semi")
    width = usable.agg(F.max(F.size("columns"))).head()[0]
    out_schema = "source_file string, row_key string, " + ", ".join(f"`{c}` string" for c in expected)
    if width is None:
        return spark.createDataFrame([], out_schema)

    cells = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    rows = spark.read.csv(pattern, schema=schema, header=False, multiLine=True, quote='"', escape='"', encoding="UTF-8").select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.monotonically_increasing_id().alias("_at"), *cells
    )
    # A file with multi-line cells is one split, so its rows are numbered without gaps in their order; the header comes first.
    starts = rows.groupBy(F.col("_path").alias("file")).agg(F.min("_at").alias("_start"))
    layouts = usable.select("file", *[F.array_position("columns", c).cast("int").alias(f"_at_{i}") for i, c in enumerate(expected)])
    known = _noted(starts.join(layouts, "file"), "run-layouts")
    placed = rows.join(known, F.col("_path") == F.col("file")).where(F.col("_at") > F.col("_start"))

    def value(i: int) -> Column:
        cell = F.element_at(F.array(*cells), F.col(f"_at_{i}"))
        return F.when(~cell.isin(list(null_tokens)), cell).alias(expected[i])

    place = F.lpad((F.col("_at") - F.col("_start")).cast("string"), 12, "0")
    key = F.concat_ws("-", F.md5("_path"), place)
    return placed.select(F.col("_name").alias("source_file"), key.alias("row_key"), *[value(i) for i in range(len(expected))])


# --- writing posts ---------------------------------------------------------------


def flat_posts(df: DataFrame) -> DataFrame:
    """The five text columns in file order; lists joined, nulls empty."""
    is_list = isinstance(df.schema["Qualifications"].dataType, T.ArrayType)
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in POST_COLUMNS if c != "Qualifications"}
    cells["Qualifications"] = (
        join_list(F.col("Qualifications")) if is_list else F.coalesce("Qualifications", F.lit(""))
    )
    return df.select(*[cells[c].alias(c) for c in POST_COLUMNS])


def write_flat_posts(df: DataFrame, path: str) -> None:
    """CSV part files with header and doubled quotes (no byte-order mark)."""
    flat_posts(df).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def checkpoint_by_term(df: DataFrame, path: str, term: str = "SearchTerm") -> None:
    """One folder per slugged term. Only the terms present are replaced, and
    each term is spread over several files instead of one task."""
    (
        df.withColumn("term_slug", slugify(F.col(term)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("term_slug")
        .parquet(path)
    )


def union_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- run reports -----------------------------------------------------------------


def run_report(stats: DataFrame, run_timestamp: str, log_file: str = "", csv_file: str = "", stats_file: str = "") -> DataFrame:
    """One nested row out of per-term counters (as many as search terms)."""
    per_term = F.sort_array(F.collect_list(F.struct("search_term", *STAT_COLUMNS)))
    return stats.agg(
        F.lit(run_timestamp).alias("run_timestamp"),
        F.transform(per_term, lambda s: s["search_term"]).alias("search_terms"),
        F.lit(log_file).alias("log_file"),
        F.lit(csv_file).alias("csv_file"),
        F.lit(stats_file).alias("stats_file"),
        F.struct(*[F.sum(c).alias(c) for c in STAT_COLUMNS]).alias("totals"),
        per_term.alias("per_term"),
        F.sum("jobs_collected").alias("total_rows"),
    )


def write_run_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)


def write_term_reports(stats: DataFrame, path: str, generated_at: str) -> None:
    """One JSON record per term: counters, rows saved, run label."""
    stats.select(
        "search_term",
        F.struct("search_term", *STAT_COLUMNS).alias("stats"),
        F.col("jobs_collected").alias("rows_saved"),
        F.lit(generated_at).alias("generated_at"),
    ).write.mode("overwrite").json(path)


def read_run_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(run_timestamp, search_term, counters...), one row per run and term."""
    runs = spark.read.schema(RUN_REPORT).json(path, multiLine=multi_line)
    return flatten_reports(runs)


def flatten_reports(runs: DataFrame) -> DataFrame:
    return runs.select("run_timestamp", F.inline("per_term"))


def parse_reports(df: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of report documents."""
    return flatten_reports(df.select(F.from_json(column, RUN_REPORT).alias("r")).select("r.*"))


# --- annotation files ------------------------------------------------------------


def first_labels(rows: DataFrame) -> DataFrame:
    """(text, label): the first label of every labelled row."""
    first = F.try_element_at("label", F.lit(1))
    return rows.withColumn("label", first).where(F.coalesce("label", F.lit("")) != "")


def read_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return first_labels(spark.read.schema(CLASS_ANNOTATION).json(path))


def annotation_lines(df: DataFrame, labelled: bool = False) -> DataFrame:
    """One JSON document per row: ``{id, text}`` or ``{text, label: []}``."""
    shape = (
        F.struct("text", F.array().cast("array<string>").alias("label")) if labelled else F.struct("id", "text")
    )
    return df.select(F.to_json(shape).alias("value"))


def write_annotation_jsonl(df: DataFrame, path: str, labelled: bool = False) -> None:
    annotation_lines(df, labelled).write.mode("overwrite").text(path)


def read_span_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, spans): mixed-type ``[start, end, label]`` triples as structs."""
    rows = spark.read.schema("text string, label array<array<string>>").json(path)
    spans = F.transform(
        F.coalesce("label", F.array().cast("array<array<string>>")),
        lambda t: F.struct(t[0].cast("int").alias("start"), t[1].cast("int").alias("end"), t[2].alias("label")),
    )
    return rows.select("text", spans.alias("spans"))


def text_dump(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return df.select(
        F.concat(F.lit("id:"), F.col(key).cast("string"), F.lit("  TEXT:\n"), F.col(text), F.lit("\n\n")).alias("value")
    )


def write_text_dump(df: DataFrame, path: str) -> None:
    text_dump(df).write.mode("overwrite").option("lineSep", "\n").text(path)


# --- vectors and models ----------------------------------------------------------


def save_vectors(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Keyed float vectors; the keys replace the row order of a bare matrix."""
    df.select("des_id", "par_id", F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
