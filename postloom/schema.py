"""Row shapes shared by the sources, operators and sinks."""

from pyspark.sql import types as T

# Columns of the run files and counters of the reports.
POST_COLUMNS = ("SearchTerm", "Title", "Description", "Qualifications", "Link")

PARAGRAPH_COLUMNS = ("des_id", "par_id", "Description")

STAT_COLUMNS = (
    "pages_attempted",
    "pages_visited",
    "jobs_collected",
    "job_parse_failures",
    "links_discovered",
)

TERM_STATS = T.StructType(
    [T.StructField("search_term", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in STAT_COLUMNS]
)

RUN_REPORT = T.StructType(
    [
        T.StructField("run_timestamp", T.StringType()),
        T.StructField("search_terms", T.ArrayType(T.StringType())),
        T.StructField("log_file", T.StringType()),
        T.StructField("csv_file", T.StringType()),
        T.StructField("stats_file", T.StringType()),
        T.StructField("totals", T.StructType([T.StructField(c, T.LongType()) for c in STAT_COLUMNS])),
        T.StructField("per_term", T.ArrayType(TERM_STATS)),
        T.StructField("total_rows", T.LongType()),
    ]
)

CLASS_ANNOTATION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.ArrayType(T.StringType())),
    ]
)
