"""Nearest neighbours by inner product with collision-counting hashing.

One random projection is one sorted array of values. A query looks at a window
centred on its own projection in every array; a vector collides once for each
window that holds it. Virtual rehashing widens all windows by one factor until
enough vectors of the block collide in a threshold share of the arrays; these are verified
with exact inner products. A window is a range of places in the sorted array, and a
collision is a place inside it; the windows of many queries are counted together.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M
the largest norm of the block. Vectors of like norms are dealt into blocks by hash,
so a few long vectors do not flatten the projections of the others; each task sorts one
block's arrays and streams all queries past it, so its memory is one block. Equal
vectors of a block are one point that carries its smallest ids.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 96
#: Share of the arrays in which a candidate collides.
THRESHOLD = 0.7
#: Share of a block's points that must collide before windows stop growing.
SHARE = 0.3
#: Factor of virtual rehashing.
WIDEN = 1.12
BLOCK_ROWS = 4096
SEED = 7
#: Own points of a block that tell how wide windows begin.
SAMPLE = 8
#: Queries whose windows are counted together.
STEP = 64
#: Norms within a factor of 2 ** (1 / 4) share blocks; those below 2 ** -16 of the largest share the last band.
BANDS_AN_OCTAVE, BANDS = 4, 65


def _unit(x: np.ndarray) -> float:
    """A power of two that brings the largest component of ``x`` near 1."""
    largest = float(np.abs(x).max(initial=0.0))
    return 2.0 ** -float(np.clip(np.frexp(largest)[1], -1000, 1000)) if largest else 1.0


class Block:
    """Sorted projections of one block's distinct vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        by = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[by], x[by]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
        self.x, self.k = x[new], k
        starts = np.flatnonzero(new)
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(starts, np.r_[starts[1:], len(ids)], strict=True)]
        near_one = self.x * _unit(self.x)
        squares = (near_one**2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        extra = np.sqrt(np.maximum(self.norm**2 - squares, 0.0))
        self.axes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, PROJECTIONS))
        values = near_one @ self.axes[:-1] + extra[:, None] * self.axes[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        # Place of every point in every array.
        self.place = np.empty(self.order.shape, dtype=np.min_scalar_type(len(self.x)))
        np.put_along_axis(self.place, self.order, np.arange(len(self.x), dtype=self.place.dtype)[None, :], axis=1)
        self.base = np.arange(PROJECTIONS) * len(self.x)
        # All arrays in one, each shifted beyond the one before: one search serves all windows.
        low, high = self.sorted[:, 0].min(), self.sorted[:, -1].max()
        self.shift = np.arange(PROJECTIONS) * (2.0 * (high - low) + 1.0)
        self.line = (self.sorted + self.shift[:, None]).ravel()
        self.low, self.high = low - 0.25 * (high - low) - 0.1, high + 0.25 * (high - low) + 0.1
        self.first = 0.55 * float(np.median(self.sorted[:, (3 * len(self.x)) // 4] - self.sorted[:, len(self.x) // 4])) or 1e-9
        # Windows of any query begin at the width that the first of some own points needs.
        self.start = 0
        self.start = int(self._enough(self.x[:: max(1, len(self.x) // SAMPLE)])[0].min())

    def _collisions(self, centres: np.ndarray, times: int) -> np.ndarray:
        """(queries, points): in how many windows each point lies after so many widenings."""
        half = self.first * WIDEN**times
        low, high = (self.line.searchsorted(np.clip(centres + side, self.low, self.high) + self.shift) - self.base for side in (-half, half))
        kind = self.place.dtype
        low, width = low.astype(kind), (high - low).astype(kind)
        shape = (len(centres), len(self.x))
        beyond, inside, count = np.empty(shape, kind), np.empty(shape, bool), np.zeros(shape, np.uint8)
        for p in range(PROJECTIONS):
            # Places before a window wrap around to numbers beyond its width.
            np.subtract(self.place[p], low[:, p, None], out=beyond)
            np.less(beyond, width[:, p, None], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        return count

    def _enough(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the windows of each query have to widen, and the points that then collide often enough."""
        near_one = queries * np.array([_unit(q) for q in queries])[:, None]
        centres = (near_one * (self.norm / np.sqrt((near_one**2).sum(axis=1)))[:, None]) @ self.axes[:-1]
        need = min(len(self.x), int(np.ceil(SHARE * len(self.x))) + self.k + 1)
        times, found = np.full(len(queries), self.start), np.zeros((len(queries), len(self.x)), dtype=bool)
        short = np.arange(len(queries))
        now = self.start
        while len(short):
            times[short] = now
            found[short] = self._collisions(centres[short], now) >= THRESHOLD * PROJECTIONS
            short = short[np.count_nonzero(found[short], axis=1) < need]
            now += 1
        return times, found

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each query the points that collide with it often enough, in the first windows that hold enough of them."""
        return [np.flatnonzero(f) for f in self._enough(queries)[1]]

    def search(self, own: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[int, float]]]]:
        """(query's id, query, its nearest) for queries that are no points of their own."""
        for at in range(0, len(queries), STEP):
            part = queries[at : at + STEP]
            for i, q, found in zip(own[at : at + STEP].tolist(), part, self.candidates(part), strict=True):
                yield i, q, self._nearest(i, q, found)

    def _nearest(self, own: int, q: np.ndarray, at: np.ndarray) -> list[tuple[int, float]]:
        with np.errstate(over="ignore", invalid="ignore"):
            score = self.x.take(at, axis=0) @ q
            if len(at) > self.k and np.isfinite(score).all():
                # The last bits of a matrix product depend on its shape; those near the top are summed again one by one.
                at = at[score >= np.partition(score, -self.k - 1)[-self.k - 1] - 1e-9 * np.sqrt((q**2).sum()) * self.norm / _unit(self.x)]
            score = np.nan_to_num((self.x[at] * q).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        top = np.argsort(-score, kind="stable")
        out: list[tuple[int, float]] = []
        worst = None
        for i in top.tolist():
            if worst is not None and score[i] < worst:
                break
            out += [(int(v), float(score[i])) for v in self.ids[at[i]] if v != own]
            if worst is None and len(out) >= self.k:
                worst = score[i]  # points as near as the last still count: smaller ids come first
        return sorted(out, key=lambda r: (-r[1], r[0]))[: self.k]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Both: vec_id bigint, embedding array of numbers; other columns are not read.
    Nearness is the inner product in double precision, equal scores order by
    vec_id. A query does not find its own vec_id. Rows without a vec_id and
    vectors that are null, zero or hold null or non-finite components take no
    part; vectors of another length than the query's are not its candidates. Rows
    alike in id and vector count once; different vectors under one id are all
    candidates, and each is a query with ranks of its own. Products beyond the range of
    doubles count as infinite, those without a value as the smallest. No rows give none.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    data, asked = clean(vectors), clean(queries)
    # In units of the largest component squares stay in range.
    unit = float(data.agg(F.max(F.array_max(F.transform("v", F.abs)))).head()[0] or 1.0)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(unit)) * (x / F.lit(unit)))
    largest = float(data.agg(F.sqrt(F.max(square))).head()[0] or 0.0)
    steps = F.ceil(F.log2(F.sqrt(square) / F.lit(largest or 1.0)) * BANDS_AN_OCTAVE)
    band = F.least(F.greatest(F.coalesce(-steps, F.lit(BANDS - 1)), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    held_by = {r["band"]: r["count"] for r in data.groupBy(band.alias("band")).count().collect()}  # at most BANDS rows
    shares = [-(-held_by.get(b, 0) // block_rows) for b in range(BANDS)]
    blocks = max(1, sum(shares))
    first = F.get(F.array(*(F.lit(sum(shares[:b])) for b in range(BANDS))), band)
    share = F.get(F.array(*(F.lit(max(1, n)) for n in shares)), band)
    own = data.select(F.size("v").alias("dims"), (first + F.pmod(F.xxhash64("vec_id", "v"), share)).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "v")
    sent = asked.select(F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "v")
    met = own.union(sent).repartition(4 * blocks, "dims", "block").sortWithinPartitions("dims", "block", "side")

    def matrix(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
        return batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, index = None, [], [], None
        for batch in batches:
            dims, block, side, vec = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])])
            out: list[tuple] = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(dims)], strict=True):
                here = (int(dims[a]), int(block[a]))
                if here != key:
                    key, ids, held, index = here, [], [], None
                if side[a] == 0:
                    ids.append(vec[a:b])
                    held.append(matrix(batch, a, b).copy())
                    continue
                if not ids:
                    continue  # no vectors of this length here
                if index is None:
                    index = Block(np.concatenate(ids), np.concatenate(held), k)
                for own_id, q, near in index.search(vec[a:b], matrix(batch, a, b)):
                    tag = hash(q.tobytes()) & 0x7FFFFFFF
                    out += [(own_id, tag, v, s) for v, s in near]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "tag", "vec_id", "score"])

    near = met.mapInArrow(run, "query_id bigint, tag bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
