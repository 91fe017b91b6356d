"""Taking named entities out of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import SPACE_CHARS, TOKEN_AND_BLANK, let, strip

# text -> array<struct<token, ent>>; token carries its trailing blank
EntityTagger = Callable[[Column], Column]

REMOVABLE = ("ORG", "PERSON", "GPE")

# Names of technologies that stay although a tagger calls them entities.
TECH_WHITELIST = (
    "aws", "amazon web services", "azure", "microsoft azure", "gcp", "google cloud", "google cloud platform", "oracle",
    "oci", "ibm cloud", "red hat", "vmware", "digitalocean", "heroku", "linode", "cloudflare", "netlify", "vercel",
    "snowflake", "databricks", "bigquery", "redshift", "athena", "glue", "emr", "lake formation", "synapse", "powerbi",
    "tableau", "qlik", "looker", "superset", "airflow", "prefect", "dbt", "docker", "kubernetes", "helm", "terraform",
    "ansible", "jenkins", "gitlab", "github", "bitbucket", "circleci", "travisci", "prometheus", "grafana", "datadog",
    "new relic", "elastic", "elk", "loki", "mysql", "postgresql", "postgres", "sqlserver", "mssql", "mongodb",
    "cassandra", "redis", "couchbase", "dynamodb", "elasticsearch", "neo4j", "firebase", "hbase", "clickhouse",
    "snowplow", "python", "java", "javascript", "typescript", "nodejs", "go", "golang", "rust", "ruby", "php", "scala",
    "r", "matlab", "swift", "kotlin", "perl", "bash", "powershell", "tensorflow", "pytorch", "keras", "scikitlearn",
    "sklearn", "huggingface", "transformers", "bert", "sbert", "gpt", "chatgpt", "llm", "opencv", "xgboost", "lightgbm",
    "catboost", "mlflow", "wandb", "dvc", "ray", "optuna", "langchain", "gradio", "streamlit", "talend", "informatica",
    "alteryx", "sas", "sap hana", "sap", "sas enterprise", "react", "reactjs", "nextjs", "angular", "vue", "svelte",
    "bootstrap", "tailwind", "html", "css", "sass", "less", "django", "flask", "fastapi", "spring", "springboot",
    "express", "dotnet", "aspnet", "laravel", "rails", "symfony", "linux", "windows", "macos", "ubuntu", "centos",
    "rhel", "debian", "android", "ios", "git", "bamboo", "splunk", "siem", "crowdstrike", "sentinelone", "paloalto",
    "checkpoint", "zscaler", "jira", "confluence", "notion", "slack", "monday", "asana", "trello", "salesforce",
    "servicenow", "workday", "netsuite", "autocad", "solidworks", "unity", "unreal", "blender",
)


def tokens(c: Column) -> Column:
    """array<string>: tokens, each with the blanks that follow it."""
    return F.regexp_extract_all(c, F.lit(TOKEN_AND_BLANK), F.lit(0))


def _core(token: Column) -> Column:
    return F.lower(F.rtrim(token, F.lit(SPACE_CHARS)))


def _in_list(c: Column, names: Iterable[str]) -> Column:
    """Membership in a literal list (hashed by the optimizer)."""
    names = sorted(names)
    return c.isin(names) if names else F.lit(False)


def _covered(cores: Column, i: Column, length: int, is_name: Callable[[Column], Column]) -> Column:
    """Token ``i`` lies inside a run of ``length`` tokens that is a name."""
    if length == 1:
        return is_name(cores[i])
    hit = F.lit(False)
    for back in range(length):
        first = i - back
        there = (first >= 0) & (first + length <= F.size(cores))
        hit = hit | (there & is_name(F.array_join(F.slice(cores, F.greatest(first, F.lit(0)) + 1, length), " ")))
    return hit


def _protected(cores: Column, i: Column, whitelist: Sequence[str]) -> Column:
    """Token ``i`` lies inside an occurrence of a whitelisted phrase."""
    by_length: dict[int, list[str]] = {}
    for phrase in whitelist:
        by_length.setdefault(len(phrase.split()), []).append(" ".join(phrase.split()))
    hit = F.lit(False)
    for n, phrases in by_length.items():
        hit = hit | _covered(cores, i, n, lambda run, phrases=phrases: _in_list(run, phrases))
    return hit


def _kept(toks: Column, lengths: Sequence[int], is_name: Callable[[Column], Column], whitelist: Sequence[str], mode: str) -> Column:
    if mode not in ("token", "phrase"):
        raise ValueError(f"mode must be 'token' or 'phrase', not {mode!r}")
    single = [w for w in whitelist if " " not in w]

    def keep(cores: Column) -> Column:
        def stays(t: Column, i: Column) -> Column:
            named = F.lit(False)
            for n in lengths:
                named = named | _covered(cores, i, n, is_name)
            return ~named | (_in_list(_core(t), single) if mode == "token" else _protected(cores, i, whitelist))

        return F.filter(toks, stays)

    return strip(F.array_join(let(F.transform(toks, _core), keep), ""))


def strip_tagged(c: Column, tagger: EntityTagger, whitelist: Sequence[str] = TECH_WHITELIST) -> Column:
    """Remove the tokens a tagger calls ORG, PERSON or GPE."""
    single = [w for w in whitelist if " " not in w]
    kept = F.filter(tagger(c), lambda t: ~t["ent"].isin(list(REMOVABLE)) | _in_list(_core(t["token"]), single))
    return strip(F.array_join(F.transform(kept, lambda t: t["token"]), ""))


def strip_entities(
    df: DataFrame,
    gazetteer: DataFrame | None,
    text: str = "Description",
    whitelist: Sequence[str] = TECH_WHITELIST,
    mode: str = "token",
    tagger: EntityTagger | None = None,
) -> DataFrame:
    """Rewrite ``text`` without the tokens of names, spacing of the rest kept.

    ``gazetteer`` has one column ``token``, a name of one or several tokens; a token
    goes if any name covers it. The distinct runs of tokens of each row meet the
    names; what was found comes back by the text's digest, and only texts with a name
    are cut into tokens again. Rows need no key, repeated ones get equal texts,
    null texts stay null, and columns may have any name.
    """
    if tagger is not None:
        return df.withColumn(text, strip_tagged(F.col(text), tagger, whitelist))
    name = F.array_join(F.transform(tokens(F.col("token")), _core), " ")
    names = gazetteer.where("token is not null").select(name.alias("run")).where("run <> ''").distinct()
    # As many lengths as the longest name has tokens.
    lengths = sorted(r.n for r in names.select((F.size(F.split("run", " "))).alias("n")).distinct().collect())
    if not lengths:
        return df.withColumn(text, strip(F.col(text)))
    digest, hits = (_unused(c, df.columns) for c in ("digest", "hits"))
    of = F.md5(F.col(text).cast("binary")).alias(digest)
    runs = let(F.transform(tokens(F.col(text)), _core), lambda c: F.array_distinct(F.flatten(F.array(*(_runs(c, n) for n in lengths)))))
    seen = explode_once(df, [of], runs, "run").select(digest, "run")
    found = seen.join(names, "run").groupBy(digest).agg(F.collect_set("run").alias(hits))
    met = df.withColumn(digest, of).join(found, digest, "left")
    kept = _kept(tokens(F.col(text)), lengths, lambda run: F.array_contains(hits, run), whitelist, mode)
    return met.withColumn(text, F.when(F.col(hits).isNull(), strip(F.col(text))).otherwise(kept)).select(*[F.col(f"`{c}`") for c in df.columns])


def _runs(cores: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined."""
    if n == 1:
        return cores
    places = F.when(F.size(cores) >= n, F.sequence(F.lit(1), F.size(cores) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(cores, i, n), " "))


def _unused(name: str, columns: Sequence[str]) -> str:
    """A column name that the input does not have, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name
