"""Near-duplicate groups: MinHash bands propose pairs, odd sketches weigh them, full sets decide.

Each document becomes its set of distinct five-word shingles. Equal sets fold
into one class first, so exact copies never meet again. A class has 256 MinHash
values; 128 of them make 32 band keys of four values, all 256 are folded into
an odd sketch: every (index, value) flips one of 1,024 bits. The number of
differing bits of two sketches tells how many values differ, most precisely at
high similarity, so a bit count rejects nearly all chance meetings before any
text moves.

A bucket is never expanded into pairs of rows:

1.  every member meets the smallest class of its bucket (a star); of all its
    centres the one with the closest sketch is checked on the full sets, and
    what is linked is contracted. Buckets whose members all belong to one
    component are finished;
2.  in the other buckets, members outside the largest component meet all members in
    blocks of at most ``BLOCK`` rows a side, compared by sketch inside the task. Those
    with a close sketch in another component are still open; a task returns only
    which of them hang together, a row per member;
3.  what hangs together meets once more in such blocks, now with the texts,
    and every pair of different components is decided on the full sets. Again
    a task returns only what hangs together.

Every pair that shares a bucket and may reach the threshold ends up linked,
inside one component, or refused on its full sets. A pair of similarity 0.75
shares no bucket with probability (1 - 0.75**4)**32 = 5e-6; a sketch limit of
4.5 standard deviations loses another 3e-6.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.shingles import WordHashes, mix, shingle_set
from postloom.llm.store import stored
from postloom.operators.neighbours import connected

HASHES = 256
BANDS = 32
ROWS = 4
SKETCH_BITS = 1024
WORDS64 = SKETCH_BITS // 64
#: Members of one side of a block comparison.
BLOCK = 512
#: Members that one copy of a centre's text meets.
FAN = 64
#: Elements hashed at once.
_CHUNK = 1 << 15
#: Documents of which a task holds sets and sketches at a time.
_ROWS = 1024


def sketch_limit(threshold: float, deviations: float = 4.5) -> int:
    """Largest number of differing sketch bits that a pair at the threshold may reasonably show."""
    differing = HASHES * (1 - threshold)
    spread = math.sqrt(HASHES * threshold * (1 - threshold))
    flips = 2 * (differing + deviations * spread)
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    noise = math.sqrt(SKETCH_BITS / 4 * (1 - (1 - 4 / SKETCH_BITS) ** flips))
    return math.ceil(expected + noise)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) minima; all sets non-empty."""
    a = _multipliers()
    out = np.empty((len(sets), HASHES), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        buffer = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, a[i], out=buffer)
            out[at:end, i] = np.minimum.reduceat(buffer, starts)
        at = end
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """(n, WORDS64) uint64: parity bits of the (index, value) pairs of each row."""
    n = len(values)
    index = np.arange(HASHES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    bit = (mix(values ^ index) >> np.uint64(64 - 10)).astype(np.int64)
    counts = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    packed = np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little")
    return packed.view(np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 bucket keys."""
    v = values[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key ^ v[:, :, i])
    return key.view(np.int64)


_SIGNATURE = "doc_id bigint, t bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>, bands array<bigint>"


def _signatures(docs: DataFrame) -> DataFrame:
    """One row per document; f1, f2, sketch and bands are null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            sets = [shingle_set(x, known) for x in batch.column(2).to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(n)
            f1, f2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            sketch, bands = np.zeros((len(sets), WORDS64), np.int64), np.zeros((len(sets), BANDS), np.int64)
            if len(full):
                values = minhash([sets[i] for i in full])
                sketch[full], bands[full] = odd_sketch(values).view(np.int64), band_keys(values)
                with np.errstate(over="ignore"):
                    f1[full] = np.array([mix(sets[i]).sum(dtype=np.uint64) for i in full], np.uint64).view(np.int64)
                    f2[full] = np.array([mix(sets[i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n[i])).sum(dtype=np.uint64) for i in full], np.uint64).view(np.int64)
            none = n == 0
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * w, w, dtype=np.int32)), pa.array(m.ravel()), mask=pa.array(none))
                for w, m in ((WORDS64, sketch), (BANDS, bands))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(f1, mask=none), pa.array(f2, mask=none), *lists],
                ["doc_id", "t", "n", "f1", "f2", "sketch", "bands"],
            )

    read = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(rows, _SIGNATURE).withColumn("rid", F.monotonically_increasing_id())


def _differing(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    total = F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))
    for i in range(1, WORDS64):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _sizes_allow(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A task holds one centre b's set at a time and meets it with the texts of its
    members; a centre with many members gets a copy for each ``FAN`` of them.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(1 << 30)).alias("spin"))
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("bigint").alias("fans"))
    members = pairs.join(fans, "b").select(F.col("a").alias("node"), F.col("b").alias("centre"), (F.col("spin") % F.col("fans")).alias("fan"))
    centres = fans.select(F.col("b").alias("node"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fans") - 1)).alias("fan"))
    rows = (
        members.union(centres)
        .join(texts, "node")
        .select("centre", "fan", (F.col("node") != F.col("centre")).alias("member"), "node", "text")
        .repartition("centre", "fan")
        .sortWithinPartitions("centre", "fan", "member", "node")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, own, last = WordHashes(), None, None, None
        for batch in batches:
            out_a, out_b = [], []
            for centre, member, node, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not member:
                    if held != centre:
                        held, own, last = centre, shingle_set(text, known), None
                elif held == centre and last != node:
                    last, other = node, shingle_set(text, known)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        out_a.append(node)
                        out_b.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(check, "a bigint, b bigint")


def _shared(reps: DataFrame) -> DataFrame:
    """(key, node, centre): the buckets of two members or more, each with its smallest class."""
    buckets = reps.select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1")
    return buckets.join(centres.drop("members"), "key")


def _texts(shared: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the classes that share a bucket; a row that stands in ``docs`` twice may bring its text twice."""
    keys = reps.join(shared.select(F.col("node").alias("rid")).distinct(), "rid").select(F.col("rid").alias("node"), F.col("doc_id").alias("_doc"), F.col("t").alias("_t"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    return own.join(keys, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "text")


def _star(shared: DataFrame, reps: DataFrame, percent: int, limit: int) -> DataFrame:
    """(a, b): each class with the closest of its buckets' smallest classes."""
    pairs = shared.where("node <> centre").select("node", "centre").distinct()
    mine = reps.select(F.col("rid").alias("node"), F.col("n").alias("n"), F.col("sketch").alias("s"))
    theirs = reps.select(F.col("rid").alias("centre"), F.col("n").alias("m"), F.col("sketch").alias("o"))
    close = (
        pairs.join(mine, "node")
        .join(theirs, "centre")
        .where(_sizes_allow("n", "m", percent))
        .select("node", "centre", _differing("s", "o").alias("z"))
        .where(F.col("z") <= limit)
    )
    return close.groupBy("node").agg(F.min(F.struct("z", "centre")).alias("best")).select(F.col("node").alias("a"), F.col("best.centre").alias("b"))


def _dealt(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """(key, i, j, side, node, comp, and the columns of ``payload``), sorted by key, i, j, side.

    rows: key, node, comp. Of each key with several components, the members
    outside the largest (side 0) meet all members (side 1): each group (key, i, j)
    holds about ``BLOCK`` of either, and every such pair of members meets in one group.
    """
    mixed = (
        rows.groupBy("key", "comp")
        .agg(F.count("*").alias("size"))
        .groupBy("key")
        .agg(F.sum("size").alias("members"), F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("key", "members", (F.col("members") - F.col("most.size")).alias("minors"), F.col("most.comp").alias("main"))
    )
    parts = rows.join(mixed, "key").select(
        "key", "node", "comp", (F.col("comp") != F.col("main")).alias("minor"),
        F.ceil(F.col("minors") / BLOCK).cast("bigint").alias("left_parts"),
        F.ceil(F.col("members") / BLOCK).cast("bigint").alias("right_parts"),
        F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("spin"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = parts.where("minor").select("key", (F.col("spin") % F.col("left_parts")).alias("i"), every("right_parts").alias("j"), F.lit(0).alias("side"), "node", "comp")
    right = parts.select("key", every("left_parts").alias("i"), (F.col("spin") % F.col("right_parts")).alias("j"), F.lit(1).alias("side"), "node", "comp")
    met = left.union(right).join(payload, "node")
    rest = [c for c in payload.columns if c != "node"]
    return met.select("key", "i", "j", "side", "node", "comp", *rest).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups (key, i, j), with the bounds of the groups."""

    def bounds(t: pa.Table) -> np.ndarray:
        key, i, j = (t.column(c).to_numpy() for c in range(3))
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if t.num_rows:
            at = bounds(t)
            if len(at) > 2:
                yield t.slice(0, int(at[-2])).combine_chunks(), at[:-1]
            rest = t.slice(int(at[-2]))  # may go on in the next batch
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _hanging(node: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it hangs together with) of all nodes in ``pairs`` of positions."""
    if not pairs:
        return (np.empty(0, np.int64),) * 2
    x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
    least = node.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        # The same node may stand on both sides of a group.
        names, where = np.unique(node, return_inverse=True)
        shared = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(shared, where, least)
        least = shared[where]
        if (least == before).all():
            break
    used = np.unique(np.r_[x, y])
    found = np.unique(np.stack([node[used], least[used]], axis=1), axis=0)
    found = found[found[:, 0] != found[:, 1]]
    return found[:, 0], found[:, 1]


def _pair_rows(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda c: np.concatenate(c) if c else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(a), pa.int64()), pa.array(join(b), pa.int64())], ["a", "b"])


def _open(rows: DataFrame, reps: DataFrame, percent: int, limit: int) -> DataFrame:
    """(a, b): members of unlike components with close sketches, hung onto the smallest they hang together with."""

    def close(node, comp, n, sketch, cut) -> tuple[np.ndarray, np.ndarray]:
        right = np.arange(cut, len(node))
        found = []
        for at in range(0, cut, 64):
            left = np.arange(at, min(cut, at + 64))
            low, high = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
            i, j = np.nonzero((comp[left][:, None] != comp[right]) & (100 * low >= percent * high))
            if len(i):
                ok = np.bitwise_count(sketch[left[i]] ^ sketch[right[j]]).sum(axis=1, dtype=np.int64) <= limit
                found.append((left[i[ok]], right[j[ok]]))
        return _hanging(node, [p for p in found if len(p[0])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches):
            side, node, comp, n = (t.column(c).to_numpy() for c in (3, 4, 5, 6))
            sketch = t.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64)
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out.append(close(*(c[s:e] for c in (node, comp, n, sketch)), int(np.searchsorted(side[s:e], 1))))
            yield _pair_rows(*map(list, zip(*out, strict=True)))

    payload = reps.select(F.col("rid").alias("node"), "n", "sketch")
    return _dealt(rows, payload).mapInArrow(meet, "a bigint, b bigint").distinct()


def _settled(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of unlike components that reach the threshold, hung onto the smallest they hang together with."""

    def linked(node, comp, sets, cut) -> tuple[np.ndarray, np.ndarray]:
        if cut in (0, len(node)):
            return _hanging(node, [])
        size = np.array([len(s) for s in sets])
        names, place = np.unique(np.concatenate(sets[cut:]), return_inverse=True)
        starts = np.r_[0, np.cumsum(size[cut:])[:-1]]
        flags = np.zeros(len(names) + 1, dtype=np.int32)
        found = []
        for x in range(cut):
            at = np.searchsorted(names, sets[x])
            at = at[names[np.minimum(at, len(names) - 1)] == sets[x]]
            flags[at] = 1
            both = np.add.reduceat(flags[place], starts)
            flags[at] = 0
            ok = (comp[x] != comp[cut:]) & (100 * both >= percent * (size[x] + size[cut:] - both))
            y = cut + np.flatnonzero(ok)
            found.append((np.full(len(y), x), y))
        return _hanging(node, [p for p in found if len(p[0])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for t, bounds in _groups(batches):
            side, node, comp = (t.column(c).to_numpy() for c in (3, 4, 5))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [shingle_set(x, known) for x in t.column(6).slice(s, e - s).to_pylist()]
                a, b = linked(node[s:e], comp[s:e], sets, int(np.searchsorted(side[s:e], 1)))
                yield _pair_rows([a], [b])

    return _dealt(rows, texts).mapInArrow(meet, "a bigint, b bigint")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) of ``nodes``."""
    return nodes.join(connected(links), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept), one row per row of ``docs``: ``near_groups`` without its key."""
    return near_groups(docs, threshold).drop("group_key")


def near_groups(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, group_key, kept), one row per row of ``docs``.

    docs: doc_id bigint, text string; other columns are not read. Documents are
    linked if their shingle sets have a Jaccard similarity of ``threshold`` (whole
    percents) or more; component_id is the smallest doc_id reachable. t is
    xxhash64(text), so (doc_id, t) finds the row again; group_key tells components
    apart whatever their ids, and is null for rows without shingles.

    Null and blank texts have no shingles, form their own component and are kept.
    Null doc_ids are never the smallest if a component has another; a component
    of null doc_ids only has a null component_id and keeps its rows. Rows that
    repeat a doc_id are separate documents, equal rows get equal answers. No rows
    give no rows.
    """
    percent = round(100 * threshold)
    limit = sketch_limit(threshold)
    sigs = stored(_signatures(docs), "near-signatures")
    full = sigs.where("n > 0")
    classes = stored(full.groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "near-classes")
    reps = stored(full.join(classes.select(F.col("node").alias("rid")), "rid"), "near-reps")
    shared = stored(_shared(reps), "near-buckets")
    texts = stored(_texts(shared, reps, docs), "near-texts")
    links = stored(_verified(_star(shared, reps, percent, limit), texts, percent), "near-links")
    comps = stored(_components(shared.select("node").distinct(), links), "near-components")
    rows = shared.select("key", "node").join(comps, "node")
    near = stored(_open(rows, reps, percent, limit), "near-open")
    if not near.isEmpty():
        groups = connected(near).select("node", F.col("root").alias("key")).join(comps, "node")
        links = stored(links.union(_settled(groups, texts, percent)), "near-links")
    roots = connected(links)
    placed = classes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = placed.join(least, "comp").select("f1", "f2", "component_id", F.col("comp").alias("group_key"))
    return (
        sigs.select("doc_id", "t", "n", "f1", "f2")
        .join(final, ["f1", "f2"], "left")
        .select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("group_key")).alias("group_key"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
