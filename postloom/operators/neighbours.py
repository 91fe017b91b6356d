"""Exact nearest neighbours and density clusters of dense vectors.

Space is cut into boxes (leaves) of roughly equal numbers of points by medians
of a bounded sample. A point is compared with its own leaf first; only points
whose answer could still change travel to other leaves, and only to those
whose box lies within the radius that matters to them. No pair of points ever
becomes a row.

Equal vectors are folded into one weighted representative beforehand, so a
group of copies is a single point here, however large it is.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, scratch_path, settle, shuffles_dropped, written

LEAF_ROWS = 8_192
#: Beyond so many leaves, leaves grow up to LEAF_ROWS before their number does: a point is copied for each leaf in reach.
FEW_LEAVES = 16
SAMPLE_CELLS = 8_000_000
_STEP = 128
#: Cells of a block of rough squares, a megabyte.
_CELLS = 131_072
#: Copies of queries that travel in one round: so many for each point, or at least so many.
ROUND_SHARE, ROUND_ROWS = 4, 200_000
#: Rows that a task hands on at a time, pairs that it holds side by side.
_SLICE = 8_192


# --- the cut of space ------------------------------------------------------------


@dataclass
class Leaves:
    """Binary cuts: ``dim[i] < 0`` marks a leaf, whose number is ``left[i]``."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray  # (leaves, d) corners of the boxes
    high: np.ndarray

    @property
    def n(self) -> int:
        return len(self.low)


def cut_space(sample: np.ndarray, wanted: int) -> Leaves:
    """Split the fullest box at the median of its widest side until enough."""
    d = sample.shape[1]
    dim, cut, left, right = [-1], [0.0], [0], [0]
    open_boxes = {0: (np.arange(len(sample)), np.full(d, -np.inf), np.full(d, np.inf))}
    closed: dict[int, tuple] = {}
    while open_boxes and len(open_boxes) + len(closed) < wanted:
        node = max(open_boxes, key=lambda b: len(open_boxes[b][0]))
        rows, low, high = open_boxes.pop(node)
        box = sample[rows]
        widths = np.ptp(box, axis=0) if len(rows) else np.zeros(d)
        side = int(widths.argmax())
        if len(rows) < 2 or widths[side] == 0:
            closed[node] = (rows, low, high)
            continue
        at = float(np.median(box[:, side]))
        if at == box[:, side].max():  # keep the upper half non-empty
            at = float(box[:, side][box[:, side] < at].max())
        below = box[:, side] <= at
        high_l, low_r = high.copy(), low.copy()
        high_l[side] = low_r[side] = at
        dim[node], cut[node], left[node], right[node] = side, at, len(dim), len(dim) + 1
        for child, part, lo, hi in ((0, rows[below], low, high_l), (1, rows[~below], low_r, high)):
            open_boxes[len(dim)] = (part, lo, hi)
            dim.append(-1), cut.append(0.0), left.append(0), right.append(0)
    boxes = {**open_boxes, **closed}
    for number, node in enumerate(sorted(boxes)):
        left[node] = number
    ordered = [boxes[node] for node in sorted(boxes)]
    return Leaves(
        np.array(dim), np.array(cut), np.array(left), np.array(right),
        np.stack([b[1] for b in ordered]), np.stack([b[2] for b in ordered]),
    )


def home_of(t: Leaves, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if t.dim[node] < 0:
            out[rows] = t.left[node]
            continue
        below = x[rows, t.dim[node]] <= t.cut[node]
        todo += [(t.left[node], rows[below]), (t.right[node], rows[~below])]
    return out


def boxes_within(t: Leaves, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every box that comes within ``r`` of a point."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if t.dim[node] < 0:
            leaf = t.left[node]
            gap = np.maximum(np.maximum(t.low[leaf] - x[rows], x[rows] - t.high[leaf]), 0.0)
            # A hair of slack: rounding must not lose a box.
            rows = rows[np.sqrt((gap * gap).sum(axis=1)) <= r[rows] * (1 + 1e-9)]
            found.append((rows, np.full(len(rows), leaf, dtype=np.int32)))
            continue
        side, at = x[rows, t.dim[node]], t.cut[node]
        todo.append((t.left[node], rows[side - r[rows] <= at]))
        todo.append((t.right[node], rows[side + r[rows] >= at]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def distance_blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Euclidean distances, some rows of ``a`` against all of ``b`` at a time.

    Sums of squared differences, column by column: exact near zero and no
    larger than one block in memory.
    """
    for at in range(0, len(a), _STEP):
        part = a[at : at + _STEP]
        acc = np.zeros((len(part), len(b)))
        for j in range(a.shape[1]):
            gap = part[:, j, None] - b[None, :, j]
            gap *= gap
            acc += gap
        yield at, np.sqrt(acc, out=acc)


def gaps_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of ``a[i]`` and ``b[i]``, to the last bit those of ``distance_blocks``."""
    acc = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        gap *= gap
        acc += gap
    return np.sqrt(acc, out=acc)


def pair_gaps(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), _SLICE):
        out[at : at + _SLICE] = gaps_of(a[i[at : at + _SLICE]], b[j[at : at + _SLICE]])
    return out


def rough_squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, squared distances by one product, how far those of a row may be off); what is close to call is summed again."""
    with np.errstate(over="ignore"):
        bb = (b * b).sum(axis=1)
        wide = np.concatenate([b.T * -2, bb[None]])
    # Few rows at a time: a block that stays in the cache is read over several times at little cost.
    step = min(_STEP, max(8, _CELLS // max(1, len(b))))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            aa = (part * part).sum(axis=1)
            off = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max(initial=0.0))
            square = np.concatenate([part, np.ones((len(part), 1))], axis=1) @ wide
            square += aa[:, None]
        # Numbers too large for a product are all close to call.
        off[~np.isfinite(off)] = np.inf
        square[~np.isfinite(square)] = 0.0
        yield at, square, off


def within_blocks(a: np.ndarray, b: np.ndarray, epsilon: float) -> Iterator[tuple[int, np.ndarray]]:
    """Which distances are at most ``epsilon``, as ``distance_blocks`` would say."""
    limit = float(epsilon) * float(epsilon)
    for at, square, off in rough_squares(a, b):
        off = (off + 1e-14 * limit)[:, None]
        if not np.isfinite(limit):
            limit, off = 0.0, np.full_like(off, np.inf)
        near = square <= limit
        i, j = np.nonzero((square <= limit + off) & (square >= limit - off))
        near[i, j] = pair_gaps(a, b, at + i, j) <= epsilon
        yield at, near


# --- Spark side ------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _fold_copies(points: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): distinct vectors with their ``k + 1`` smallest ids.

    The rank is cut before the shuffle, so a huge group of copies arrives as a
    few rows per task; more than k + 1 members cannot matter to any answer.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = points.select("id", "v").withColumn("_r", place).where(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "ids", "v"
    )


def sampled(reps: DataFrame, take: int, n: int, width: int) -> np.ndarray:
    """About ``take`` of the ``n`` vectors, by their hash."""
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(take / n * (1 << 20)) + 1
    cells = reps.where(share).select("v").toArrow().column(0).combine_chunks()
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _plan(reps: DataFrame, leaf_rows: int) -> tuple[Leaves, int]:
    """Cut space by a sample of the representatives, of at most SAMPLE_CELLS numbers or 16 rows a leaf; also rows to a batch of queries."""
    first = reps.select(F.size("v")).head()
    width = first[0] if first else 1
    n = reps.count()
    wanted = max(1, math.ceil(n / leaf_rows))
    if wanted > FEW_LEAVES:
        wanted = max(FEW_LEAVES, math.ceil(n / max(leaf_rows, LEAF_ROWS)))
    if wanted == 1:
        return cut_space(np.zeros((0, width)), 1), leaf_rows
    take = min(n, 256 * wanted, max(16 * wanted, SAMPLE_CELLS // width))
    # Batches above a leaf's size: the points of a leaf are repeated for each.
    return cut_space(sampled(reps, take, n, width), wanted), max(leaf_rows, 4 * n // wanted)


def _locate(reps: DataFrame, t: Leaves) -> DataFrame:
    """Adds ``leaf``."""
    tree = reps.sparkSession.sparkContext.broadcast(cloudpickle.dumps(t))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = pickle.loads(tree.value)
        for b in batches:
            if len(b):
                yield b.assign(leaf=home_of(leaves, _matrix(b["v"])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema)
    return settle(reps.mapInPandas(place, f"{schema}, leaf int"))


#: (queries as pandas, as matrix) -> (row, leaf) of every leaf that a query asks.
Route = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _reach_route(queries: DataFrame, t: Leaves, keep: np.ndarray | None = None) -> Route:
    """Queries (leaf, v, r, ...) ask every other leaf in reach. ``keep[home, other]`` may rule out pairs of leaves."""
    tree = queries.sparkSession.sparkContext.broadcast(cloudpickle.dumps((t, keep)))

    def route(b: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaves, allowed = pickle.loads(tree.value)
        rows, target = boxes_within(leaves, x, b["r"].to_numpy())
        home = b["leaf"].to_numpy()[rows]
        ok = target != home
        if allowed is not None:
            ok &= allowed[home, target]
        return rows[ok], target[ok]

    return route


def _asked(queries: DataFrame, route: Route) -> dict[int, int]:
    """How many queries ask each leaf (one small row per leaf); no copy travels for that."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf, n = np.unique(route(b, _matrix(b["v"]))[1], return_counts=True)
                yield pd.DataFrame({"leaf": leaf.astype(np.int32), "n": n})

    counts = queries.mapInPandas(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
    return {r.leaf: r.n for r in counts.collect()}


def _rounds(asked: dict[int, int], points: int) -> list[dict[int, int]]:
    """The leaves in rounds of a bounded number of copies: a share of the points, so that disk grows with these alone."""
    most, out, n = max(ROUND_SHARE * points, ROUND_ROWS), [], 0
    for leaf in sorted(asked):
        if not out or n + asked[leaf] > most:
            out.append({})
            n = 0
        out[-1][leaf] = asked[leaf]
        n += asked[leaf]
    return out


def _dealt_by(x: np.ndarray) -> np.ndarray:
    """A number of every row, by its bits."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    odd = np.arange(1, 2 * bits.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((bits * odd).sum(axis=1) >> np.uint64(33)).astype(np.int64)


def _met(queries: DataFrame, route: Route, homes: DataFrame, fn, schema: str, batch_rows: int, asked: dict[int, int]) -> DataFrame:
    """``fn(queries, points)`` per leaf of ``asked``; many queries are dealt to many tasks, the points of a leaf repeated for each."""
    chunks = np.zeros(max(asked) + 1, dtype=np.int64)
    for leaf, n in asked.items():
        chunks[leaf] = -(-n // batch_rows)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"])
            rows, target = route(b, x)
            ok = target < len(chunks)
            ok[ok] = chunks[target[ok]] > 0
            rows, target = rows[ok], target[ok]
            chunk = (_dealt_by(x)[rows] % chunks[target]).astype(np.int32)
            for at in range(0, len(rows), _SLICE):  # a point may go to every leaf
                cut = slice(at, at + _SLICE)
                yield b.iloc[rows[cut]].assign(leaf=target[cut], chunk=chunk[cut])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    dealt = queries.mapInPandas(send, f"{fields}, chunk int")
    times = F.coalesce(F.get(F.array(*(F.lit(int(n)) for n in chunks)), F.col("leaf")), F.lit(0))
    repeated = homes.where(times > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), times - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(left, right)

    return dealt.groupBy("leaf", "chunk").cogroup(repeated.groupBy("leaf", "chunk")).applyInPandas(run, schema)


def _meet(queries: DataFrame, route: Route, homes: DataFrame, fn, schema: str, batch_rows: int) -> DataFrame:
    """``fn(queries, points)`` per leaf that is asked, in rounds whose answers are written."""
    rounds = _rounds(_asked(queries, route), homes.count())
    parts = [_met(queries, route, homes, fn, schema, batch_rows, asked) for asked in rounds]
    if not parts:
        return queries.sparkSession.createDataFrame([], schema)
    if len(parts) > 1:
        parts = [written(part, "answers") for part in parts]
    return reduce(DataFrame.union, parts)


# --- nearest neighbours ----------------------------------------------------------


def _nearest(query: np.ndarray, reach: np.ndarray, v: np.ndarray, ids: list, k: int) -> list[tuple[list, list]]:
    """Per query: up to ``k + 1`` (distance, id) in order, within its reach."""
    size = np.array([len(i) for i in ids])
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = np.array([x for i in ids for x in i])
    out = []
    for at, square, off in rough_squares(query, v):
        far = reach[at : at + len(square)]
        with np.errstate(over="ignore"):
            limit = far * far * (1 + 1e-12)
        if len(v) > k + 1:
            # The reach is often enough; only where it holds many are the first picked out.
            many = np.flatnonzero((square <= (limit + off)[:, None]).sum(axis=1) > 4 * (k + 1))
            limit[many] = np.minimum(limit[many], np.partition(square[many], k, axis=1)[:, k] + off[many])
        i, j = np.nonzero(square <= (limit + off)[:, None])
        gap = pair_gaps(query, v, at + i, j)
        ok = gap <= far[i]
        i, j, gap = i[ok], j[ok], gap[ok]
        # Every vector stands for its ids.
        n = size[j]
        row, dist = np.repeat(i, n), np.repeat(gap, n)
        member = flat[np.repeat(first[j] - np.cumsum(n) + n, n) + np.arange(len(row))] if len(row) else flat[:0]
        order = np.lexsort((member, dist, row))
        row, dist, member = row[order], dist[order], member[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) <= k
        cut = np.cumsum(np.bincount(row[few], minlength=len(square)))[:-1]
        out += [(m.tolist(), g.tolist()) for m, g in zip(np.split(member[few], cut), np.split(dist[few], cut), strict=True)]
    return out


def nearest_lists(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Leaves]:
    """((rep, p), (rep, ids, v, leaf), leaves): the ``k + 1`` entries (distance, neighbour) nearest to every distinct vector.

    ``points`` has (id, v). A vector finds itself and its copies first. The
    in-leaf answer bounds the distance of the k-th neighbour; that bound, or a
    smaller ``bound`` (id, r) that is known to hold, decides which other leaves have to be asked.
    """
    id_type = points.schema["id"].dataType.simpleString()
    reps = _fold_copies(points.select("id", F.col("v").cast("array<double>").alias("v")), k)
    t, batch = _plan(reps, leaf_rows)
    located = _locate(reps, t)
    lists = f"rep {id_type}, leaf int, v array<double>, r double, found array<{id_type}>, gaps array<double>"

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(g["v"])
        found = _nearest(v, np.full(len(v), np.inf), v, [list(i) for i in g["ids"]], k)
        reach = [gaps[k] if len(gaps) > k else np.inf for _, gaps in found]
        return pd.DataFrame(
            {"rep": g["rep"], "leaf": g["leaf"], "v": g["v"], "r": reach,
             "found": [f for f, _ in found], "gaps": [gaps for _, gaps in found]}
        )

    own = located.groupBy("leaf").applyInPandas(inside, lists)
    answers = own.select("rep", "found", "gaps")
    if t.n > 1:
        own = settle(own)
        answers = own.select("rep", "found", "gaps")
        if bound is not None:
            known = bound.select(F.col("id").alias("rep"), F.col("r").alias("_r"))
            own = own.join(known, "rep", "left").withColumn("r", F.least("r", F.coalesce("_r", "r"))).drop("_r")

        def elsewhere(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(g):
                return pd.DataFrame({"rep": [], "found": [], "gaps": []})
            found = _nearest(_matrix(q["v"]), q["r"].to_numpy(), _matrix(g["v"]), [list(i) for i in g["ids"]], k)
            some = np.array([len(f) > 0 for f, _ in found])
            return pd.DataFrame({"rep": q["rep"], "found": [f for f, _ in found], "gaps": [x for _, x in found]})[some]

        answer = f"rep {id_type}, found array<{id_type}>, gaps array<double>"
        queries = own.select("rep", "leaf", "v", "r")
        homes = located.select("leaf", "v", "ids")
        route = _reach_route(queries, t)
        rounds = _rounds(_asked(queries, route), homes.count())
        if len(rounds) > 1:
            return _by_rounds(answers, queries, route, homes, elsewhere, answer, batch, rounds, k), located, t
        for asked in rounds:
            answers = answers.union(_met(queries, route, homes, elsewhere, answer, batch, asked))
    return _best(answers, k), located, t


def _best(answers: DataFrame, k: int) -> DataFrame:
    """(rep, p): the first ``k + 1`` entries (distance, neighbour) of all answers, at most one list of so many per leaf asked."""
    pairs = F.arrays_zip(F.col("gaps").alias("distance"), F.col("found").alias("neighbour"))
    return answers.select("rep", pairs.alias("p")).groupBy("rep").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k + 1).alias("p")
    )


def _by_rounds(answers: DataFrame, queries: DataFrame, route: Route, homes: DataFrame, fn, schema: str, batch: int, rounds: list[dict[int, int]], k: int) -> DataFrame:
    """``_best`` of all leaves: a round's answers are folded before the next, which asks within what is known by then."""
    spark, kept, path = queries.sparkSession, None, ""
    for asked in rounds:
        now = queries
        if kept is not None:
            answers = kept.select("rep", F.col("p.neighbour").alias("found"), F.col("p.distance").alias("gaps"))
            near = kept.select("rep", F.get(F.col("p"), F.lit(k))["distance"].alias("_near"))
            now = queries.join(near, "rep", "left").withColumn("r", F.least("r", F.coalesce("_near", "r"))).select(queries.columns)
        best = _best(answers.union(_met(now, route, homes, fn, schema, batch, asked)), k)
        old, path = path, scratch_path(spark, "nearest")
        with shuffles_dropped(spark):
            best.write.parquet(path)
        kept = spark.read.schema(best.schema).parquet(path)
        if old:
            discard(spark, old)
    return kept


def knn_graph(points: DataFrame, k: int = 15, leaf_rows: int = LEAF_ROWS, bound: DataFrame | None = None) -> DataFrame:
    """(id, rank, neighbour, distance): the exact ``k`` nearest others.

    ``points`` has (id, v). Equal distances are ordered by id. ``bound`` (id, r) may
    say within which distance the ``k`` nearest lie, e.g. from approximate lists.
    """
    best, located, _ = nearest_lists(points, k, leaf_rows, bound)
    members = _members(points, located)
    others = F.slice(F.filter("p", lambda e: e["neighbour"] != F.col("id")), 1, k)
    return members.join(best, "rep").select("id", F.posexplode(others).alias("rank", "e")).select(
        "id", (F.col("rank") + 1).alias("rank"), "e.neighbour", "e.distance"
    )


def _members(points: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep). One side is unique, so a hot vector is split at run time."""
    h = F.xxhash64("v").alias("h")
    a = points.select("id", F.col("v").cast("array<double>").alias("v")).select("id", "v", h)
    return a.join(reps.select("rep", "v", h), ["h", "v"]).select("id", "rep")


# --- density clusters ------------------------------------------------------------


def _local_components(v: np.ndarray, epsilon: float) -> np.ndarray:
    """Component numbers under links of at most ``epsilon``."""
    n = len(v)
    label = np.full(n, -1)
    low, high = v.min(axis=0), v.max(axis=0)
    if np.sqrt(((high - low) ** 2).sum()) <= epsilon:
        return np.zeros(n, dtype=int)
    current = 0
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = current
        frontier = np.array([seed])
        while len(frontier):
            rest = np.flatnonzero(label < 0)
            if not len(rest):
                break
            hit = np.zeros(len(rest), dtype=bool)
            for _, near in within_blocks(v[frontier], v[rest], epsilon):
                hit |= near.any(axis=0)
            frontier = rest[hit]
            label[frontier] = current
        current += 1
    return label


def density_cluster(
    points: DataFrame,
    min_cluster_size: int = 50,
    min_samples: int = 15,
    epsilon: float = 0.1,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(id, component): smallest member id of the cluster, null for outliers.

    The cut of the density hierarchy at ``epsilon``: a point is core when
    ``min_samples`` others lie within epsilon, core points within epsilon of
    each other are linked, and linked groups that are too small dissolve.
    """
    points = points.select("id", F.col("v").cast("array<double>").alias("v"))
    id_type = points.schema["id"].dataType.simpleString()
    reps = points.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v")
    t, batch = _plan(reps, leaf_rows)
    located = _locate(reps, t)
    cores = settle(_core_points(located, t, id_type, min_samples, epsilon, batch))

    def link(g: pd.DataFrame) -> pd.DataFrame:
        label = _local_components(_matrix(g["v"]), epsilon)
        first = g.groupby(label)["rep"].min()
        return g.assign(comp=first.loc[label].to_numpy())[["rep", "leaf", "v", "comp"]]

    linked = cores.groupBy("leaf").applyInPandas(link, f"rep {id_type}, leaf int, v array<double>, comp {id_type}")
    if t.n > 1:
        linked = settle(linked)
        edges = _links_between(linked, t, id_type, epsilon, batch)
        roots = connected(edges).withColumnsRenamed({"node": "comp", "root": "_root"})
        linked = linked.join(roots, "comp", "left").withColumn("comp", F.coalesce("_root", "comp"))
    grouped = settle(_members(points, reps).join(linked.select("rep", "comp"), "rep", "left").select("id", "comp"))
    # The smallest id of a cluster belongs to one of its representatives.
    sizes = grouped.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.count("*").alias("_n"))
    big = sizes.where(F.col("_n") >= min_cluster_size).select("comp", F.col("comp").alias("component"))
    return grouped.join(big, "comp", "left").select("id", "component")


def _core_points(
    located: DataFrame, t: Leaves, id_type: str, min_samples: int, epsilon: float, batch_rows: int
) -> DataFrame:
    """(rep, leaf, v) of points with enough neighbours."""

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        v, n = _matrix(g["v"]), g["n"].to_numpy()
        near = np.empty(len(v), dtype=np.int64)
        if np.sqrt((np.ptp(v, axis=0) ** 2).sum()) <= epsilon:
            near[:] = n.sum() - 1
        else:
            for at, block in within_blocks(v, v, epsilon):
                near[at : at + len(block)] = block.astype(np.float64) @ n - 1  # whole numbers
        return pd.DataFrame({"rep": g["rep"], "leaf": g["leaf"], "v": g["v"], "near": near})

    counted = located.groupBy("leaf").applyInPandas(inside, f"rep {id_type}, leaf int, v array<double>, near bigint")
    if t.n == 1:
        return counted.where(F.col("near") >= min_samples).drop("near")
    counted = settle(counted)
    # Only points that are still short of neighbours ask other leaves.
    short = counted.where(F.col("near") < min_samples).select("rep", "leaf", "v", F.lit(float(epsilon)).alias("r"))

    def elsewhere(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        more = np.zeros(len(q), dtype=np.int64)
        if len(q) and len(g):
            n = g["n"].to_numpy()
            for at, block in within_blocks(_matrix(q["v"]), _matrix(g["v"]), epsilon):
                more[at : at + len(block)] = block.astype(np.float64) @ n
        return pd.DataFrame({"rep": q["rep"], "more": more})

    more = _meet(short, _reach_route(short, t), located.select("leaf", "v", "n"), elsewhere, f"rep {id_type}, more bigint", batch_rows)
    extra = more.groupBy("rep").agg(F.sum("more").alias("more"))
    total = F.col("near") + F.coalesce("more", F.lit(0))
    return counted.join(extra, "rep", "left").where(total >= min_samples).select("rep", "leaf", "v")


def _links_between(linked: DataFrame, t: Leaves, id_type: str, epsilon: float, batch_rows: int) -> DataFrame:
    """(a, b): components of different leaves that touch.

    Leaves that hold one component each and lie wholly within epsilon of each
    other are linked by their boxes; no point has to travel between them, which
    keeps very dense regions cheap.
    """
    v = array_to_vector("v")
    stats = (
        linked.groupBy("leaf")
        .agg(Summarizer.metrics("min", "max").summary(v).alias("s"), F.min("comp").alias("first"), F.max("comp").alias("last"))
        .select("leaf", "first", "last", vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high"))
        .collect()  # one row per leaf
    )
    keep = np.zeros((t.n, t.n), dtype=bool)
    free = []
    if stats:
        leaf = np.array([s.leaf for s in stats])
        single = np.array([s.first == s.last for s in stats])
        low, high = np.array([s.low for s in stats]), np.array([s.high for s in stats])
        for i, s in enumerate(stats):
            apart = np.maximum(np.maximum(low - high[i], low[i] - high), 0.0)
            across = np.maximum(high - low[i], high[i] - low)
            may = np.sqrt((apart**2).sum(axis=1)) <= epsilon * (1 + 1e-9)
            sure = (np.sqrt((across**2).sum(axis=1)) <= epsilon) & single & single[i]
            # A pair is examined from one side only.
            keep[s.leaf, leaf[may & ~sure & (leaf > s.leaf)]] = True
            free += [(s.first, stats[j].first) for j in np.flatnonzero(sure & (leaf > s.leaf))]
    queries = linked.select("comp", "leaf", "v", F.lit(float(epsilon)).alias("r"))

    def touch(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        pairs: set[tuple] = set()
        if len(q) and len(g):
            (mine, a), (theirs, b) = pd.factorize(q["comp"]), pd.factorize(g["comp"])
            for at, near in within_blocks(_matrix(q["v"]), _matrix(g["v"]), epsilon):
                i, j = np.nonzero(near)
                seen = np.unique(mine[at + i] * len(b) + theirs[j])
                pairs.update(zip(a[seen // len(b)].tolist(), b[seen % len(b)].tolist(), strict=True))
        return pd.DataFrame(list(pairs), columns=["a", "b"])

    schema = f"a {id_type}, b {id_type}"
    found = _meet(queries, _reach_route(queries, t, keep), linked.select("leaf", "v", "comp"), touch, schema, batch_rows)
    if free:
        found = found.union(found.sparkSession.createDataFrame(free, schema))
    return found.distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge list with its component's smallest.

    Alternating star contractions: rounds grow with the logarithm of the size,
    also on long chains. Each round is written out, which cuts its lineage.
    """
    e = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    before = None
    while True:
        # Larger neighbours move to the smallest neighbour ...
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # ... then smaller neighbours and the node itself do.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


# Tasks carry these functions with them, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
