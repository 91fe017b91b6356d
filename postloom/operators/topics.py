"""Describing topics: terms, weights, names, members and similarity.

Topic -1 holds the outliers. Tables per topic are small next to the documents
but grow with them, so nothing is broadcast by hint: joins are planned from
measured sizes. A topic may own most documents; everything per topic is
therefore summed with partial aggregation or cut to its top rows before the
shuffle, and never collected whole.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import let, paragraph_uid
from ..functions.vectors import l2_normalize
from ..session import scratch_path, settle, shuffles_dropped, written


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


# --- terms -----------------------------------------------------------------------


def topic_tokens(c: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Lower-case ASCII tokens of two or more characters, stop words (English by default) out."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9\\s]+", "")
    found = F.regexp_extract_all(plain, F.lit("[a-z0-9]{2,}"), F.lit(0))
    stops = sorted(set(english_stop_words() if stop_words is None else stop_words))
    return F.filter(found, lambda t: ~t.isin(stops)) if stops else found


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens, each length built on the one before."""

    def longer(shorter: Column, toks: Column, n: int) -> Column:
        count = F.greatest(F.size(toks) - (n - 1), F.lit(0))
        heads, tails = F.slice(shorter, F.lit(1), count), F.slice(toks, F.lit(n), count)
        return F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b))

    def grow(shorter: Column, toks: Column, n: int) -> Column:
        if n > high:
            return F.array().cast("array<string>")
        return let(
            longer(shorter, toks, n) if n > 1 else toks,
            lambda g: F.concat(g, grow(g, toks, n + 1)) if n >= low else grow(g, toks, n + 1),
        )

    return let(tokens, lambda t: grow(t, t, 1))


def gram_ids(tokens: Column, low: int, high: int) -> Column:
    """The same runs as 64-bit numbers: without the texts where only their equality counts."""

    def runs(t: Column, n: int) -> Column:
        if n == 1:
            return F.transform(t, lambda x: F.xxhash64(x))
        places = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(n))))

    return let(tokens, lambda t: F.flatten(F.array(*(runs(t, n) for n in range(low, high + 1)))))


def gram_id(term: Column) -> Column:
    """The number that ``gram_ids`` gives to a run of one to three tokens."""
    t = F.split(term, " ")
    by = [F.xxhash64(*(F.get(t, F.lit(i)) for i in range(n))) for n in (1, 2, 3)]
    return F.when(F.size(t) == 1, by[0]).when(F.size(t) == 2, by[1]).otherwise(by[2])


def counted(items: Column) -> Column:
    """array<struct<term, tf>>: distinct items with their counts, inside the row."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(places, lambda i: (i == 0) | (s[i] != F.get(s, i - 1)))
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda at, k: F.struct(
                    s[at].alias("term"),
                    (F.coalesce(F.get(h, k + 1), F.size(s)) - at).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(items), runs)


#: Words that a task counts together; their numbers are the digits of a run of up to three.
_WORDS = 1 << 19
#: Characters of text whose runs are shuffled in one pass, and the most passes: each reads the texts again.
PASS_CHARS, MOST_PASSES = 32_000_000, 4


def passes(docs: DataFrame) -> int:
    """In how many parts to take the terms of ``docs``: only one part's shuffle is on the disks at a time."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).head()[0] or 0
    return min(MOST_PASSES, max(1, math.ceil(chars / PASS_CHARS)))


def part_of(term: Column, parts: int) -> Column:
    """The part of a term, by its first word: a document's other parts need no runs to be built."""
    return (F.crc32(F.substring_index(term, " ", 1).cast("binary")) % parts).cast("int")


def gram_counts(
    docs: DataFrame, by: Sequence[str], n: tuple[int, int] = (1, 3), stop_words: Sequence[str] | None = None, part: int = 0, parts: int = 1
) -> DataFrame:
    """(by..., term, tf): runs of ``topic_tokens``, counted within a task by ``by``; a group may come in several rows.

    Words become numbers in the order of their texts, so runs are sorted and counted as numbers
    and leave the task in order, which shuffles in little space.
    """
    low, high = n
    stops = frozenset(english_stop_words() if stop_words is None else stop_words)
    words = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")  # what \\s means there
    given = docs.select(*by, words.alias("_words"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in by), "term string", "tf int"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column(len(by))).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + _WORDS, side="right")))
                yield from _counted_runs(b.slice(at, to - at), low, high, stops, part, parts)
                at = to

    return given.mapInArrow(count, schema)


def _counted_runs(rows: pa.RecordBatch, low: int, high: int, stops: frozenset, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    lists, by = rows.column(rows.num_columns - 1), rows.select(range(rows.num_columns - 1))
    found = lists.flatten().dictionary_encode()
    plain = [re.sub("[^a-z0-9]+", "", w) for w in found.dictionary.to_pylist()]
    names = sorted({w for w in plain if len(w) > 1 and w not in stops})
    place = {w: i for i, w in enumerate(names, 1)}
    code = np.array([place.get(w, 0) for w in plain], dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    code, row = code[code > 0], row[code > 0]
    if not len(code):
        return
    group, first = _groups(by)
    base = len(names) + 1
    if len(first) * base**high >= 1 << 63:  # numbers too long for a machine word
        code = code.astype(object)
    starts = np.ones(len(code), dtype=bool)
    if parts > 1:
        starts = np.array([False, *(zlib.crc32(w.encode()) % parts == part for w in names)])[code.astype(np.int64)]
    at, runs = np.flatnonzero(starts), []
    number = group[row[at]].astype(code.dtype)
    for k in range(high):  # a run of k + 1 words; digits of later words are 0
        whole = at + k < len(code)
        whole[whole] = row[at[whole] + k] == row[at[whole]]
        at, number = at[whole], number[whole]
        number = number * base + code[at + k]
        if k + 1 >= low:
            runs.append(number * base ** (high - 1 - k))
    numbers, tf = np.unique(np.concatenate(runs), return_counts=True) if runs else (code[:0], code[:0])
    ahead = pa.array(["", *names])
    behind = pa.array(["", *(" " + w for w in names)])
    for lo in range(0, len(numbers), 100_000):
        x, texts = numbers[lo : lo + 100_000], []
        for k in range(high):
            digit, x = (x % base).astype(np.int64), x // base
            texts.insert(0, (behind if k < high - 1 else ahead).take(pa.array(digit)))
        owners = by.take(pa.array(first[x.astype(np.int64)]))
        term = pc.binary_join_element_wise(*texts, "") if high > 1 else texts[0]
        tfs = pa.array(tf[lo : lo + 100_000].astype(np.int32))
        yield pa.RecordBatch.from_arrays([*owners.columns, term, tfs], [*owners.schema.names, "term", "tf"])


def _groups(by: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the rows, nulls alike, and the first row of each group."""
    group = np.zeros(by.num_rows, dtype=np.int64)
    for c in by.columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    return group, np.unique(group, return_index=True)[1]


def document_terms(
    docs: DataFrame,
    key: Sequence[str] = ("doc_id",),
    n: tuple[int, int] = (1, 3),
    stop_words: Sequence[str] | None = None,
    ids: bool = False,
    part: int = 0,
    parts: int = 1,
) -> DataFrame:
    """(key, topic, term, tf); a document is one row, so counting needs no shuffle. With ``ids`` terms are numbers, of all parts."""
    if not ids:
        own = docs.select(*key, "topic", "text", F.monotonically_increasing_id().alias("_row"))  # rows that share a key stay apart
        return gram_counts(own, [*key, "topic", "_row"], n, stop_words, part, parts).drop("_row")
    grams = gram_ids(topic_tokens(F.col("text"), stop_words), *n)
    return explode_once(docs, [*key, "topic"], counted(grams), "_t").select(*key, "topic", "_t.term", "_t.tf")


def document_term_parts(docs: DataFrame, key: Sequence[str] = ("doc_id",), n: tuple[int, int] = (1, 3), stop_words: Sequence[str] | None = None) -> list[DataFrame]:
    """``document_terms`` in parts that share no term, for ``representative_docs``."""
    parts = passes(docs)
    return [document_terms(docs, key, n, stop_words, part=p, parts=parts) for p in range(parts)]


def topic_terms(
    docs: DataFrame,
    n: tuple[int, int] = (1, 3),
    min_df: float = 0.1,
    max_df: float = 0.8,
    stop_words: Sequence[str] | None = None,
    ids: bool = False,
    totals: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """(topic, term, tf) of the terms that occur in enough, but not too many topics. With ``ids`` terms are numbers.

    Terms are counted inside the tasks and shuffled once, by term: what a term has in
    its topics is summed and compared where it is. Long texts are read in several
    passes, each for the terms of a part, whose rows are written before the next one
    shuffles its own. With ``totals`` they are always written, and have ``f``, the sum of a term, and
    ``df``, its number of topics, as well.
    """
    n_topics = docs.agg(F.count_distinct("topic")).head()[0]
    each = Window.partitionBy("term")

    def kept(per_task: DataFrame) -> DataFrame:
        per_topic = per_task.repartition("term").groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
        # A term has at most one row per topic here, so the window groups are small.
        spread = per_topic.withColumns({"df": F.count("*").over(each), **({"f": F.sum("tf").over(each)} if totals else {})})
        return spread.where((F.col("df") >= min_df * n_topics) & (F.col("df") <= max_df * n_topics))

    if ids:
        grams = gram_ids(topic_tokens(F.col("text"), stop_words), *n)
        per_doc = explode_once(docs, ["topic"], counted(grams), "_t").select("topic", "_t.term", F.col("_t.tf").cast("int").alias("tf"))
        out = kept(per_doc)
        return written(out, "terms") if totals else out.drop("df")
    parts = passes(docs) if parts is None else parts
    one = [kept(gram_counts(docs, ["topic"], n, stop_words, p, parts)) for p in range(parts)]
    if parts == 1 and not totals:
        return one[0].drop("df")
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "terms")
    for out in one:
        with shuffles_dropped(spark):
            out.write.option("compression", "zstd").mode("append").parquet(path)
    stored = spark.read.schema(one[0].schema).parquet(path)
    return stored if totals else stored.drop("df")


def class_tfidf(terms: DataFrame, totals: bool = False) -> DataFrame:
    """(topic, term, tf, weight), weight = tf / |topic| * ln(1 + A / f).

    The terms are made once and written with their totals, unless they are ``topic_terms(totals=True)``, which are;
    the sizes of topics are a table of their own. With ``totals`` the columns ``df`` and ``f`` stay.
    """
    if "f" not in terms.columns:
        each = Window.partitionBy("term")
        terms = written(terms.select("topic", "term", "tf", F.count("*").over(each).alias("df"), F.sum("tf").over(each).alias("f")), "terms")
    sizes = written(terms.groupBy("topic").agg(F.sum("tf").alias("_size")), "topic-sizes")
    average = sizes.agg(F.floor(F.avg("_size"))).scalar()
    weight = F.col("tf") / F.col("_size") * F.log(1 + average / F.col("f"))
    return terms.join(sizes, "topic").select("topic", "term", "tf", weight.alias("weight"), *(["df", "f"] if totals else []))


def _by_weight() -> list[Column]:
    return [F.round("weight", 9).desc(), F.col("term")]


def top_terms(weights: DataFrame, n_words: int = 10) -> DataFrame:
    """(topic, words): the heaviest terms in order."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(*_by_weight()))
    best = weights.withColumn("_r", rank).where(F.col("_r") <= n_words)
    ordered = F.sort_array(F.collect_list(F.struct("_r", "term")))
    return best.groupBy("topic").agg(F.transform(ordered, lambda s: s["term"]).alias("words"))


def topic_info(weights: DataFrame, sizes: DataFrame, n_words: int = 10) -> DataFrame:
    """(topic, count, name, words); name is ``id_w1_w2_w3_w4``."""
    words = F.coalesce("words", F.array().cast("array<string>"))
    return sizes.join(top_terms(weights, n_words), "topic", "left").select(
        "topic",
        F.col("count"),
        F.array_join(F.concat(F.array(F.col("topic").cast("string")), F.slice(words, 1, 4)), "_").alias("name"),
        words.alias("words"),
    )


def top_topics(info: DataFrame, n: int = 25, words: int = 5) -> DataFrame:
    """The largest real topics with their first words (a top-n report)."""
    return (
        info.where(F.col("topic") != -1)
        .orderBy(F.col("count").desc(), "topic")
        .limit(n)
        .select("topic", "count", F.slice("words", 1, words).alias("words"))
    )


# --- documents -------------------------------------------------------------------


def assign_topics(clusters: DataFrame, cluster: str = "component", key: str = "id") -> DataFrame:
    """(key, topic): clusters numbered by size, 0 the largest, null -> -1.

    Equal sizes are ordered by their smallest member. Numbers come from a
    histogram of sizes (few distinct values) plus the place among clusters of
    the same size, so no single task sorts all clusters.
    """
    members = clusters.where(F.col(cluster).isNotNull())
    sizes = members.groupBy(cluster).agg(F.count("*").alias("_n"), F.min(key).alias("_m"))
    larger = F.coalesce(
        F.sum("_c").over(Window.orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.groupBy("_n").agg(F.count("*").alias("_c")).select("_n", larger.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_n").orderBy("_m"))
    numbered = sizes.join(offsets, "_n").select(cluster, (F.col("_before") + place - 1).cast("int").alias("topic"))
    return clusters.join(numbered, cluster, "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))


def topic_centroids(docs: DataFrame, vector: str = "v") -> DataFrame:
    """(topic, centroid) of the real topics."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return docs.where(F.col("topic") != -1).groupBy("topic").agg(vector_to_array(mean).alias("centroid"))


# Doubles of centroid data that one task may hold at a time.
CENTROID_CELLS = 4_000_000


def topic_membership(docs: DataFrame, key: str = "doc_id", vector: str = "v") -> DataFrame:
    """(key, topic, probability): how clearly a document sits in its topic.

    A membership is the topic's share of all closenesses ``1 / (1 + distance)``
    times the closeness to the nearest topic, so memberships sum to at most 1.
    The value reported is the largest one, or one minus the sum for outliers.
    Centroids reach the tasks in chunks of bounded size; sums and maxima of
    the chunks add up to the whole.
    """
    centroids = topic_centroids(docs, vector)
    width = docs.select(F.size(vector)).head()
    per_chunk = max(1, CENTROID_CELLS // max(1, width[0] if width else 1))
    rows = docs.select(
        key, F.col("topic").cast("int").alias("topic"), vector, F.lit(0.0).alias("_sum"), F.lit(0.0).alias("_max")
    )
    chunk: list[list[float]] = []
    for r in centroids.toLocalIterator():
        chunk.append(r.centroid)
        if len(chunk) == per_chunk:
            rows, chunk = _add_closeness(rows, chunk, vector), []
    if chunk:
        rows = _add_closeness(rows, chunk, vector)
    share = F.when(F.col("_sum") > 0, F.col("_max") / F.col("_sum")).otherwise(F.lit(0.0))
    near = F.col("_max")  # in (0, 1], 1 on a centroid
    probability = F.when(F.col("topic") == -1, 1 - near).otherwise(share * near)
    return rows.select(key, "topic", probability.alias("probability"))


def _add_closeness(rows: DataFrame, centroids: list[list[float]], vector: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids))

    def closeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            x = np.stack(b[vector].to_numpy())
            total, best = b["_sum"].to_numpy(copy=True), b["_max"].to_numpy(copy=True)
            for lo in range(0, len(c), 256):
                part = c[lo : lo + 256]
                for at in range(0, len(x), 64):  # differences, not dot products: exact near zero
                    gap = x[at : at + 64, None, :] - part[None, :, :]
                    w = 1.0 / (1.0 + np.sqrt((gap * gap).sum(axis=2)))
                    total[at : at + 64] += w.sum(axis=1)
                    best[at : at + 64] = np.maximum(best[at : at + 64], w.max(axis=1))
            yield b.assign(_sum=total, _max=best)

    return rows.mapInPandas(closeness, rows.schema)


def _norms(weights: DataFrame) -> DataFrame:
    """(topic, _norm), written first: Spark sees how small it is and leaves the other side of a join where it lies."""
    return written(weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")), "topic-norms")


def representative_docs(
    doc_terms: DataFrame | Sequence[DataFrame], weights: DataFrame, n: int = 3, key: str = "doc_id"
) -> DataFrame:
    """(topic, rank, key, score): documents closest to their topic's weights.

    ``doc_terms`` may come in parts (``document_term_parts``): each meets its weights and is summed by itself, so that
    only one part's terms are shuffled at a time.
    """
    norms = _norms(weights)
    parts = [doc_terms] if isinstance(doc_terms, DataFrame) else list(doc_terms)
    sums = []
    for p, part in enumerate(parts):
        mine = weights if len(parts) == 1 else weights.where(part_of(F.col("term"), len(parts)) == p)
        met = part.join(mine.select("topic", "term", "weight"), ["topic", "term"]).groupBy(key, "topic")
        met = met.agg(F.sum(F.col("tf") * F.col("weight")).alias("_dot"), F.sum(F.col("tf").cast("bigint") * F.col("tf")).alias("_len"))
        sums.append(met if len(parts) == 1 else written(met, "document-sums"))
    if len(parts) > 1:
        whole = sums[0]
        for more in sums[1:]:
            whole = whole.union(more)
        sums = [whole.groupBy(key, "topic").agg(F.sum("_dot").alias("_dot"), F.sum("_len").alias("_len"))]
    scored = (
        sums[0]
        .join(norms, "topic")
        .select("topic", key, F.round(F.col("_dot") / (F.sqrt("_len") * F.col("_norm")), 6).alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("score").desc(), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "rank", key, "score")


def document_info(
    docs: DataFrame,
    membership: DataFrame,
    info: DataFrame,
    representatives: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: its topic, the topic's name and words, probability."""
    # The smaller per-topic table is attached after the key join on documents.
    out = docs.drop("topic").join(membership, key).join(info.select("topic", "name", "words"), "topic", "left")
    if representatives is None:
        return out
    marks = representatives.select(key, F.lit(True).alias("representative"))
    return out.join(marks, key, "left").fillna(False, ["representative"])


def topic_mean_probability(doc_topics: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(topic, mean_probability[, name]) of the real topics, best first."""
    means = doc_topics.where(F.col("topic") != -1).groupBy("topic").agg(F.avg("probability").alias("mean_probability"))
    if info is not None:
        means = means.join(info.select("topic", "name"), "topic", "left")
    return means.orderBy(F.col("mean_probability").desc(), "topic")


# --- similarity ------------------------------------------------------------------

_TILE = 512
_TERMS_PER_BLOCK = 4096


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity) of topics that share a term, a < b.

    The weights are read three times: give a table that is cheap to read, as ``class_tfidf`` does.
    Where they have ``df``, terms of a single topic, which meet no other, count for the length only.
    A blocked matrix product: rows go to (tile of topics, tile of topics,
    block of terms), a task multiplies one block densely, and the partial
    products are summed. A term found in every topic costs its block one
    column and never meets itself row by row.
    """
    term = F.xxhash64("term") if weights.schema["term"].dataType.simpleString() == "string" else F.col("term")
    unit = weights.join(_norms(weights), "topic").select("topic", term.alias("term"), (F.col("weight") / F.col("_norm")).alias("w"), *(["df"] if "df" in weights.columns else []))
    if "df" in weights.columns:
        weights = weights.where("df > 1")
        unit = unit.where("df > 1").drop("df")
    bounds = weights.agg(F.max("topic"), F.approx_count_distinct("term")).head()
    n_tiles = ((bounds[0] or 0) + 1) // _TILE + 1
    n_blocks = (bounds[1] or 0) // _TERMS_PER_BLOCK + 1
    size = _TILE
    mine = F.floor((F.col("topic") + 1) / size).cast("int")
    others = F.sequence(F.lit(0), F.lit(n_tiles - 1))
    placed = (
        unit.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int"))
        .withColumn("tile", mine)
        .withColumn("other", F.explode(others))
        .withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
        .select("tile_a", "tile_b", "block", "topic", "term", "w")
    )

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, terms = pd.factorize(rows["term"])
        names, places = np.unique(rows["topic"].to_numpy(), return_inverse=True)
        w = np.zeros((len(names), len(terms)))
        w[places, codes] = rows["w"].to_numpy()
        product = w @ w.T
        i, j = np.nonzero(np.triu(product, 1))
        tiles = (names + 1) // size
        keep = (tiles[i] == key[0]) & (tiles[j] == key[1])
        i, j = i[keep], j[keep]
        return pd.DataFrame({"topic_a": names[i], "topic_b": names[j], "part": product[i, j]})

    parts = placed.groupBy("tile_a", "tile_b", "block").applyInPandas(
        multiply, "topic_a int, topic_b int, part double"
    )
    return parts.groupBy("topic_a", "topic_b").agg(F.sum("part").alias("similarity"))


#: With at most so many pairs left, merging goes on in one place.
LOCAL_PAIRS = 100_000


def _merge_here(rows: list) -> list[tuple]:
    """(topic_a, topic_b, similarity, size) for few pairs, the most similar first."""
    near: dict = {}
    size: dict = {}
    for r in rows:
        near.setdefault(r.a, {})[r.b] = r.u
        size[r.a] = r.na
    heap = [(-u / (size[a] * size[b]), a, b, size[a], size[b]) for a, others in near.items() for b, u in others.items() if a < b]
    heapq.heapify(heap)
    out = []
    while heap:
        less, a, b, na, nb = heapq.heappop(heap)
        if size.get(a) != na or size.get(b) != nb:
            continue  # one of them has grown or gone
        others = near.pop(b)
        size[a] = na + size.pop(b)
        out.append((a, b, -less, size[a]))
        del near[a][b], others[a]
        for c, u in others.items():
            del near[c][b]
            near[a][c] = near[c][a] = near[a].get(c, 0.0) + u
        for c, u in near[a].items():
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-u / (size[a] * size[c]), x, y, size[x], size[y]))
    return out


def topic_hierarchy(similarity: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(topic_a, topic_b, similarity, size): merges of topics by the mean similarity of their members.

    ``similarity`` has (topic_a, topic_b, similarity), pairs without a row have none. A
    merged topic keeps the smaller number and counts ``size`` topics. Pairs that are each other's
    most similar merge in one round, which gives what merging the most similar
    pair again and again does. Topics that share nothing with others do not merge.
    """
    kind = similarity.schema["topic_a"].dataType.simpleString()
    both = similarity.select(F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), F.col("similarity").alias("u")).where("a <> b")
    # Sums over pairs of members add up when topics merge, means do not.
    sums = settle(both.union(both.select("b", "a", "u")).where("u > 0").withColumns({"na": F.lit(1).cast("bigint"), "nb": F.lit(1).cast("bigint")}))
    merges = sums.sparkSession.createDataFrame([], f"topic_a {kind}, topic_b {kind}, similarity double, size bigint")
    while sums.count() > local_pairs:
        mean = F.col("u") / (F.col("na") * F.col("nb"))
        first = F.min(F.struct((-mean).alias("m"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("na") + F.col("nb")).alias("size")))
        chosen = sums.groupBy("a").agg(first.alias("e"))
        pairs = settle(chosen.groupBy("e.x", "e.y").agg(F.count("*").alias("n"), F.first("e.m").alias("m"), F.first("e.size").alias("size")).where("n = 2"))
        merges = settle(merges.union(pairs.select("x", "y", -F.col("m"), "size")))
        to = lambda c: pairs.select(F.col("y").alias(c), F.col("x").alias(f"_{c}"))
        grown = lambda c: pairs.select(F.col("x").alias(c), F.col("size").alias(f"_n{c}"))
        moved = sums.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "u", "na", "nb").where("a <> b")
        moved = moved.groupBy("a", "b").agg(F.sum("u").alias("u"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        moved = moved.join(grown("a"), "a", "left").join(grown("b"), "b", "left")
        sums = settle(moved.select("a", "b", "u", F.coalesce("_na", "na").alias("na"), F.coalesce("_nb", "nb").alias("nb")))
    rest = _merge_here(sums.collect())  # at most ``local_pairs`` rows
    return merges.union(merges.sparkSession.createDataFrame(rest, merges.schema))


# --- paragraph vectors -----------------------------------------------------------


def pool_paragraph_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(des_id, pooled): mean ‖ max over the paragraphs of a post, unit length."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    pooled = vectors.groupBy("des_id").agg(Summarizer.metrics("mean", "max").summary(v).alias("s"))
    both = F.concat(vector_to_array(F.col("s.mean")), vector_to_array(F.col("s.max")))
    return pooled.select("des_id", l2_normalize(both).alias("pooled"))


def with_uid(paras: DataFrame) -> DataFrame:
    return paras.withColumn("par_uid", paragraph_uid(F.col("des_id"), F.col("par_id")))


# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
