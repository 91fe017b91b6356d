"""Hard negatives by a secondary sort of pair scores.

Every anchor has its nearest rows of its own label as positives; a negative of a
positive is a row of another label whose score lies in a window below the score
of that positive. Scores are inner products of whole numbers, hence exact.

Two passes over blocks of rows, past which all anchors stream, leave few pairs:

1.  a block emits the best positives it holds for an anchor; the best of all
    blocks are the anchor's positives;
2.  with their scores known, a block emits the first negatives it holds for each
    window.

What is left is shuffled by anchor and sorted within partitions by (anchor,
descending score, id). An iterator reads that order once: a positive opens its
window, a negative goes to every open window that takes it. It holds
the open windows of one anchor and nothing else.

A block is a bounded number of rows, so an anchor, a label or a vector that a
third of all rows share is spread over blocks like any other.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.store import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of its positive.
LOW, HIGH = 50, 95
BLOCK_ROWS = 4096
#: Anchors scored together.
_STEP = 128
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def quantised(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of every component; beyond 64 bits the nearest 64-bit number."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(steps)) * x.cast("double")))


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest score of the negatives of a positive."""
    return -(-low * score // 100), high * score // 100


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond 64 bits the nearest 64-bit number but one."""
    out = (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    limit = math.isqrt((1 << 53) // max(1, a.shape[1]))
    wide = lambda m: np.flatnonzero((m > limit).any(axis=1) | (m < -limit).any(axis=1))
    exact = lambda p, q: np.clip(p.astype(object) @ q.astype(object).T, _NONE + 1, _MOST).astype(np.int64)
    if len(rows := wide(a)):
        out[rows] = exact(a[rows], x)
    if len(rows := wide(x)):
        out[:, rows] = exact(a, x[rows])
    return out


def _best(s: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each row's ``k`` largest, leftmost first; cells of _NONE or below ``least`` are none. Spoils ``s``."""
    found, every = [], np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(axis=1)
        top = s[every, at]
        ok = top > _NONE if least is None else (top > _NONE) & (top >= least)
        if not ok.any():
            break
        found.append((every[ok], at[ok]))
        s[every, at] = _NONE
    return found


class Block:
    """Rows of one length, by vec_id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.of = {int(v): np.flatnonzero(self.labels == v) for v in np.unique(labels)}

    def positives(self, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, k: int) -> Iterator[tuple]:
        """(anchor, row, score) of the block's best rows of the anchors' labels."""
        for label in np.unique(labels).tolist():
            own, at = np.flatnonzero(labels == label), self.of.get(label)
            if at is None:
                continue
            s = scores(a[own], self.x[at])
            s[ids[own][:, None] == self.ids[at][None, :]] = _NONE
            kept = s.copy()
            for i, j in _best(s, k):
                yield own[i], at[j], kept[i, j]

    def negatives(self, labels: np.ndarray, a: np.ndarray, windows: list[list[tuple[int, int]]], k: int) -> Iterator[tuple]:
        """(anchor, row, score) of the block's first rows of other labels in each window."""
        s = scores(a, self.x)
        s[labels[:, None] == self.labels[None, :]] = _NONE
        cells = [np.empty(0, dtype=np.int64)]
        for n in range(max(map(len, windows), default=0)):
            own = np.array([i for i, w in enumerate(windows) if len(w) > n and w[n][0] <= w[n][1]], dtype=np.int64)
            low, high = (np.array([windows[i][n][side] for i in own], dtype=np.int64) for side in (0, 1))
            part = s[own]
            cells += [own[i] * s.shape[1] + j for i, j in _best(np.where(part <= high[:, None], part, _NONE), k, low)]
        # A row may serve several windows of an anchor; it goes out once.
        i, j = np.divmod(np.unique(np.concatenate(cells)), s.shape[1])
        yield i, j, s[i, j]


def _past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, extra: str, emit: Callable) -> DataFrame:
    """``emit(block, anchor ids, labels, matrix, extra values)`` for every block, as pair rows."""
    own = rows.select("dims", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "tag", "label", "v", F.lit(None).cast("array<bigint>").alias("extra"))
    sent = anchors.select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "tag", "label", "v", F.expr(extra).alias("extra"))
    met = own.union(sent).repartition(4 * blocks, "dims", "block").sortWithinPartitions("dims", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            dims, number, side, vec, tag, label = (batch.column(i).to_numpy() for i in range(6))
            edges = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (number[1:] != number[:-1]) | (side[1:] != side[:-1])])
            out: list[tuple] = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(dims)], strict=True):
                if (here := (int(dims[a]), int(number[a]))) != key:
                    key, held, block = here, [], None
                matrix = batch.column(6).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if side[a] == 0:
                    held.append((vec[a:b].copy(), label[a:b].copy(), matrix.copy()))
                    continue
                if not held:
                    continue  # no rows of this length here
                if block is None:
                    block = Block(*(np.concatenate(c) for c in zip(*held, strict=True)))
                for at in range(a, b, _STEP):
                    end = min(b, at + _STEP)
                    more = batch.column(7).slice(at, end - at).to_pylist()
                    for i, j, s in emit(block, vec[at:end], label[at:end], matrix[at - a : end - a], more):
                        out.append((vec[at + i], tag[at + i], block.ids[j], s))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "tag", "vec_id", "score"])

    return met.mapInArrow(run, "anchor_id bigint, tag bigint, vec_id bigint, score bigint")


def stream(rows: Iterator[tuple], negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, their scores) from keys in order of (anchor, tag, -score, kind, vec_id)."""
    anchor, open_ = None, []
    for (own, tag, less, kind, vec), _ in rows:
        if (own, tag) != anchor:
            anchor, open_ = (own, tag), []
        score = -less
        if kind == 0:
            open_.append([vec, score, *window(score, low, high), 0])
            continue
        for each in open_:
            if each[4] < negatives and each[2] <= score <= each[3]:
                each[4] += 1
                yield own, each[0], each[4], vec, each[1], score


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both: vec_id bigint, label bigint, v array<bigint>; other columns are not
    read. An anchor's positives are the ``positives`` rows of its label and another
    vec_id with the largest inner products; the negatives of a positive are the first
    ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score. Equal scores order by vec_id.

    Rows with a null vec_id, label, vector or component take no part; an
    empty vector meets no other row, and vectors of different lengths never meet. Rows alike in id, label and
    vector count once; different rows under one vec_id are rows of their own,
    and as anchors each has its own windows under that id. Scores beyond 64 bits
    count as the nearest 64-bit number. An anchor without positives, or a positive with
    an empty window, has no rows; no rows give no rows.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)) & (F.size("v") > 0)
    clean = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v")).where(whole).distinct().withColumn("tag", F.xxhash64("label", "v")).withColumn("dims", F.size("v"))
    data, asked = stored(clean(rows), "negatives-rows"), stored(clean(anchors), "negatives-anchors")
    blocks = max(1, -(-data.count() // block_rows))

    def ahead(block: Block, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, _: list) -> Iterator[tuple]:
        return block.positives(ids, labels, a, positives)

    def below(block: Block, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, known: list) -> Iterator[tuple]:
        return block.negatives(labels, a, [[window(p, low, high) for p in sorted(set(k))] for k in known], negatives)

    held = _past_blocks(data, asked, blocks, "cast(null as array<bigint>)", ahead)
    place = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    few = held.withColumn("place", place).where(F.col("place") <= positives)  # tasks drop the others before the shuffle
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
    known = stored(few.groupBy("anchor_id", "tag").agg(best.alias("best")), "negatives-positives")
    windows = asked.join(known.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "tag"])
    found = _past_blocks(data, windows, blocks, "transform(best, x -> -x.less)", below)
    near = known.select("anchor_id", "tag", F.explode("best").alias("b")).select("anchor_id", "tag", F.lit(0).alias("kind"), "b.vec_id", (-F.col("b.less")).alias("score"))
    pairs = near.union(found.select("anchor_id", "tag", F.lit(1).alias("kind"), "vec_id", "score"))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda r: ((r.anchor_id, r.tag, -r.score, r.kind, r.vec_id), None))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: hash(key[:2]))
    mined = ordered.mapPartitions(lambda part: stream(part, negatives, low, high))
    return spark.createDataFrame(mined, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def labelled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows with a label and a finite vector, in 256 steps a unit; labels of ids divisible by 7 move on by one, modulo 10.

    vectors: vec_id bigint, embedding array of numbers, label int.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", moved.alias("label"), quantised(F.col("embedding")).alias("v"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
