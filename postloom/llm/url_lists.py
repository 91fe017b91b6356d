"""URL filtering as of the fetch: dated list entries become validity intervals.

An addition is valid from its day until the day of the next removal of the same
entry. Entries name a domain, which covers its subdomains, and may name a path
prefix. Each distinct host gathers the intervals of its own and its parent
domains once; captures then join by host and look only at the intervals that
are open on the day of the fetch, so a host with many captures costs one join
row a capture and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.quality import let

# The parts of a URL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, login and closing dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def domains_of(host: Column) -> Column:
    """A host and its parent domains."""
    def tails(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    return let(F.split(host, r"\."), tails)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, domain, prefix, start, stop): start <= day < stop; stop is null while an entry stands.

    entries: list, domain, prefix string, verdict block or allow, action add or
    remove, day date. A removal on the day of an addition comes before it. Rows
    without list, domain or day, or with other verdicts and actions, are
    left out; a null prefix is /; repeated rows count once.
    """
    keys = ["list", "verdict", "domain", "prefix"]
    rows = entries.select("list", "verdict", F.lower("domain").alias("domain"), F.coalesce("prefix", F.lit("/")).alias("prefix"), "action", F.col("day").cast("date").alias("day"))
    rows = rows.where("list is not null and domain is not null and day is not null and verdict in ('block', 'allow') and action in ('add', 'remove')").distinct()
    # Days bound the rows of an entry.
    later = Window.partitionBy(*keys).orderBy("day", F.desc("action")).rowsBetween(1, Window.unboundedFollowing)
    stop = F.min(F.when(F.col("action") == "remove", F.col("day"))).over(later)
    return rows.withColumn("stop", stop).where("action = 'add'").select(*keys, F.col("day").alias("start"), "stop")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, day, verdict, domain, prefix, lists, n_open), one row per row of ``captures``.

    captures: page_id bigint, url string, day date; other columns are not read.
    The most specific open entry decides: the longest domain, then the longest
    prefix, then block before allow. lists names, sorted and comma-joined, the lists
    that hold the deciding entry; n_open counts all open intervals that match. Without
    one, and for a null day or a URL without a host, the verdict is none and
    domain, prefix and lists are null.
    """
    shots = captures.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("day").cast("date").alias("day"))
    hosts = shots.select("host").where("host <> ''").distinct().select("host", F.explode(domains_of(F.col("host"))).alias("domain"))
    one = F.struct("domain", "prefix", "verdict", "list", "start", "stop")
    held = hosts.join(intervals(entries), "domain").groupBy("host").agg(F.collect_list(one).alias("held"))
    met = shots.join(held, "host", "left")
    open_ = F.filter("held", lambda e: (e["start"] <= F.col("day")) & F.coalesce(F.col("day") < e["stop"], F.lit(True)) & F.startswith(F.col("path"), e["prefix"]))
    met = met.withColumn("open", F.coalesce(open_, F.array().cast(met.schema["held"].dataType)))
    rank = lambda e: F.struct((-F.length(e["domain"])).alias("d"), (-F.length(e["prefix"])).alias("p"), (e["verdict"] == "allow").alias("v"), e["domain"].alias("domain"), e["prefix"].alias("prefix"), e["verdict"].alias("verdict"))
    met = met.withColumn("best", F.array_min(F.transform("open", rank)))
    same = lambda e: (e["domain"] == F.col("best.domain")) & (e["prefix"] == F.col("best.prefix")) & (e["verdict"] == F.col("best.verdict"))
    lists = F.array_sort(F.array_distinct(F.transform(F.filter("open", same), lambda e: e["list"])))
    return met.select(
        "page_id", "host", "day", F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.domain").alias("domain"), F.col("best.prefix").alias("prefix"),
        F.when(F.col("best").isNotNull(), F.array_join(lists, ",")).alias("lists"), F.size("open").cast("bigint").alias("n_open"),
    )
