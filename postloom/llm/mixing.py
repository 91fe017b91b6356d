"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. All documents with the same
membership form a pattern; only patterns and their total sizes come to the
driver, one row each. Tables of up to ``MAX_BROADCAST`` patterns are broadcast,
larger ones are joined as Spark chooses. On the driver, tokens flow from patterns to
the quotas of their sources. A pattern offers its size once for each repetition
and every further repetition costs more (convex costs), so no document is
repeated while fresh ones can still serve the quota. Costs sit on the arcs that
leave the start, so the cheapest flow is found level by level: all a level can
carry, with earlier flow rerouted where that lets more through, and then the next.

A pattern's flow becomes whole passes over its documents and a rest, which goes
to the first documents in a seeded order. Where that order is cut is found with
sums over 256 ranges of the hash, then 256 ranges of the one that holds the
cut, and then exactly among the few documents left. No source is sorted whole,
so a source with a third of all documents is no single group.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.store import stored

MAX_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_LEAST = -(1 << 63)


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A string for every source, null included; no two share one, null is the last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def share_out(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Targets in proportion to weights; none above ``most`` times its size, the excess shared again."""
    target = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), float(total)
    while free and left > 0:
        all_weights = sum(weights[s] for s in sorted(free))
        full = {s for s in free if left * weights[s] / all_weights >= most * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / all_weights for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in sorted(full))
        free -= full
    return target


def route(supply: dict[tuple[str, ...], int], quota: dict[str, int], passes: int) -> dict[tuple[str, ...], dict[str, int]]:
    """Flow of words from patterns to sources: the most possible, with the fewest repetitions."""
    flow: dict[tuple[str, ...], dict[str, int]] = {p: defaultdict(int) for p in supply}
    need = {s: int(quota.get(s, 0)) for p in supply for s in p}
    users = defaultdict(set)
    for _ in range(passes):
        offer = dict(supply)
        for start in sorted(supply):
            while offer[start] > 0:
                # Shortest way from this pattern to a source with need left, back along earlier flow where it helps.
                came: dict = {start: None}
                queue, end = deque([start]), None
                while queue and end is None:
                    at = queue.popleft()
                    if isinstance(at, tuple):
                        steps = [s for s in at if s not in came]
                    else:
                        steps = [p for p in sorted(users[at]) if flow[p][at] > 0 and p not in came]
                    for x in steps:
                        came[x] = at
                        queue.append(x)
                        if not isinstance(x, tuple) and need[x] > 0:
                            end = x
                            break
                if end is None:
                    break
                way, x = [], end
                while x is not None:
                    way.append(x)
                    x = came[x]
                way.reverse()
                amount = min([offer[start], need[end], *(flow[p][s] for s, p in zip(way[1:-1:2], way[2::2], strict=True))])
                for p, s in zip(way[::2], way[1::2], strict=True):
                    flow[p][s] += amount
                    users[s].add(p)
                for s, p in zip(way[1:-1:2], way[2::2], strict=True):
                    flow[p][s] -= amount
                offer[start] -= amount
                need[end] -= amount
    return flow


def _small(patterns: int) -> Callable[[DataFrame], DataFrame]:
    """Hints a broadcast of a table with a row per pattern, if there are few enough."""
    return F.broadcast if patterns <= MAX_BROADCAST else lambda df: df


@dataclass
class Mix:
    """What the driver decided; ``cuts`` has one row per pattern."""

    cuts: DataFrame
    source_sizes: dict[str, int]
    targets: dict[str, float]
    flows: dict[tuple[str, ...], dict[str, int]]
    #: Patterns as they stand in _pattern.
    keys: dict[tuple[str, ...], str]


def _first_over(sums: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Of each pattern's ordered sums, the row in which the running total reaches ``_left``; _left becomes the part inside."""
    run = Window.partitionBy("_pattern").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(run), F.lit(0))
    return (
        sums.withColumn("_before", before)
        .where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_sum") >= F.col("_left")))
        .select("_pattern", (F.col("_left") - F.col("_before")).alias("_left"), *by, *keep)
    )


def prepare(docs: DataFrame, members: Column, doc_id: Column, size: Column, seed: int) -> DataFrame:
    """``docs`` with _pattern (joined source keys), _size, _id and _h."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform(members, source_key))))
    out = docs.withColumns({"_pattern": pattern, "_size": size.cast("bigint"), "_id": F.coalesce(doc_id.cast("bigint"), F.lit(_LEAST))})
    return out.withColumn("_h", F.xxhash64("_id", "_size", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)))


def plan_mix(rows: DataFrame, weights, ratio: float, passes: int = 2) -> Mix:
    """Decide what to take of ``rows`` (from ``prepare``).

    weights: a function from the sorted list of source keys to {key: weight}. The
    sources share ``ratio`` times all words; none gets more than ``passes`` times its size.
    """
    spark = rows.sparkSession
    found = rows.groupBy("_pattern").agg(F.sum("_size").alias("size")).collect()
    small = _small(len(found))
    keys = {tuple(json.loads(r["_pattern"])): r["_pattern"] for r in found}
    supply = {tuple(json.loads(r["_pattern"])): int(r["size"] or 0) for r in found}
    sizes: dict[str, int] = defaultdict(int)
    for pattern, size in supply.items():
        for s in pattern:
            sizes[s] += size
    targets = share_out(sizes, weights(sorted(sizes)), ratio * sum(supply.values()), passes)
    flows = route(supply, {s: int(t + 0.5) for s, t in targets.items()}, passes)
    plan = []
    for pattern, size in sorted(supply.items()):
        taken = sum(flows[pattern].values())
        whole = taken // size if size else 0
        plan.append((keys[pattern], whole, taken - whole * size))
    cut = small(spark.createDataFrame(plan, "_pattern string, _whole bigint, _left bigint"))  # one row per pattern
    open_ = rows.join(cut.where("_left > 0").drop("_whole"), "_pattern")
    first, second = F.shiftright("_h", 55), F.shiftright("_h", 47).bitwiseAND(F.lit(255))
    slim = open_.select("_pattern", "_left", "_size", "_id", "_h", first.alias("_r1"), second.alias("_r2"))
    one = _first_over(slim.groupBy("_pattern", "_left", "_r1").agg(F.sum("_size").alias("_sum")), ["_r1"], [])
    held = slim.drop("_left").join(small(one), ["_pattern", "_r1"])  # one row per pattern
    two = _first_over(held.groupBy("_pattern", "_left", "_r1", "_r2").agg(F.sum("_size").alias("_sum")), ["_r2"], ["_r1"])
    held = slim.drop("_left").join(small(two), ["_pattern", "_r1", "_r2"])
    exact = held.groupBy("_pattern", "_left", "_h", "_id", "_size").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_ties"))
    at = _first_over(exact, ["_h", "_id", "_size"], ["_ties"]).toDF("_pattern", "_part", "_cut_h", "_cut_id", "_cut_size", "_ties")
    return Mix(cut.drop("_left").join(small(at), "_pattern", "left"), dict(sizes), targets, flows, keys)


def take(rows: DataFrame, mix: Mix, whole_documents: bool = False) -> DataFrame:
    """``rows`` with _taken, the words the mix takes of each.

    The document at the cut gives the words still missing, or with
    ``whole_documents`` all or nothing, whichever is nearer. Rows equal in id and
    size at the cut give the same part each.
    """
    here = F.struct("_h", "_id", "_size")
    cut = F.struct("_cut_h", "_cut_id", "_cut_size")
    part = F.floor(F.col("_part") / F.col("_ties"))
    if whole_documents:
        part = F.when(2 * F.col("_part") >= F.col("_ties") * F.col("_size"), F.col("_size")).otherwise(0)
    rest = F.when(F.col("_cut_h").isNull(), 0).when(here < cut, F.col("_size")).when(here == cut, part).otherwise(0)
    return rows.join(_small(len(mix.flows))(mix.cuts), "_pattern").withColumn("_taken", (F.col("_whole") * F.col("_size") + rest).cast("bigint"))


def cycle_weights(sources: list[str], weights: tuple[float, ...] = (5, 2, 1)) -> dict[str, float]:
    return {s: weights[i % len(weights)] for i, s in enumerate(sources)}


def mix_sources(docs: DataFrame, members: Column, ratio: float = 1.5, passes: int = 2, seed: int = 20, weights=cycle_weights) -> DataFrame:
    """(doc_id, members, size, taken, credit), one row per row of ``docs``.

    docs: doc_id bigint, text string and what ``members`` needs; ``members`` is an
    array of the sources a document belongs to, null being a source of its own and
    an empty array taking no part. size counts words, a null text has 0; taken is
    at most ``passes`` times size. credit is the source key whose quota the
    document serves, drawn in proportion to its pattern's flow. A document without
    words takes part with 0. Null and repeated doc_ids are documents like others.
    No rows give no rows; without any words all targets are 0.
    """
    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), members.alias("members"), words_of("text").alias("size"))
    rows = stored(prepare(cols, F.col("members"), F.col("doc_id"), F.col("size"), seed), "mix-sizes")
    mix = plan_mix(rows, weights, ratio, passes)
    shares = []
    for pattern, flow in mix.flows.items():
        total, start = sum(flow.values()), 0.0
        for s in sorted(s for s, n in flow.items() if n):
            shares.append((mix.keys[pattern], start, start + flow[s] / total, s))
            start += flow[s] / total
    found = docs.sparkSession.createDataFrame(shares, "_pattern string, _from double, _to double, credit string")
    found = found.groupBy("_pattern").agg(F.collect_list(F.struct("_from", "_to", "credit")).alias("_shares"))
    draw = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = take(rows, mix).join(_small(len(mix.flows))(found), "_pattern", "left").withColumn("_draw", draw)
    credit = F.element_at(F.filter("_shares", lambda x: (x["_from"] <= F.col("_draw")) & (F.col("_draw") < x["_to"] + 1e-12)), 1)["credit"]
    return taken.select("doc_id", "members", "size", F.col("_taken").alias("taken"), F.when(F.col("_taken") > 0, credit).alias("credit"))


def mix_by_source(docs: DataFrame, ratio: float = 1.5, passes: int = 2, seed: int = 20) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for documents of one source each; see ``mix_sources``."""
    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), words_of("text").alias("size"))
    rows = stored(prepare(cols, F.array("source"), F.col("doc_id"), F.col("size"), seed), "mix-sizes")
    mix = plan_mix(rows, cycle_weights, ratio, passes)
    known = [(mix.keys[(s,)], mix.source_sizes[s], mix.targets[s]) for s in mix.source_sizes]
    sources = docs.sparkSession.createDataFrame(known, "_pattern string, source_size bigint, target double")
    return (
        take(rows, mix)
        .join(_small(len(mix.flows))(sources), "_pattern")  # one row per source
        .select("doc_id", "size", "source_size", "target", F.col("_taken").alias("taken"))
    )


def mixed_rows(docs: DataFrame, ratio: float = 1.5, passes: int = 2, seed: int = 20) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents only, with their own columns."""
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    rows = prepare(own, F.array("source"), F.col("doc_id"), words_of("text"), seed)
    mix = plan_mix(stored(rows.select("_pattern", "_size", "_id", "_h"), "mix-sizes"), cycle_weights, ratio, passes)
    times = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int")
    taken = take(rows, mix, whole_documents=True)
    return taken.withColumn("_time", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
