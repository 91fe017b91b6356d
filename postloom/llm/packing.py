"""Best-fit packing of tokenised documents into sequences of one size.

The work has three parts, and only the middle one sees all lengths at once:

1.  tasks tokenise whole documents, cut those above the capacity and emit a row
    per piece (no ids); the rows are written once;
2.  the histogram of lengths, at most ``capacity`` counts, comes to the driver,
    which plans patterns: how many sequences hold which lengths;
3.  every piece gets its rank among the pieces of its length and looks up the
    sequence and offset of that rank.

A plan takes lengths from long to short. The gap a length leaves is looked up
among the sums of one, two and three available lengths, and a combination that
fills it exactly is used as often as the counts allow. What finds no complement
is placed best-fit: into the open pattern with the smallest gap that takes it.

A rank is the sum of a block's offset and the rank within the block. Blocks are
made by hash, so a length that a third of all pieces share is no single group.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.store import stored
from postloom.llm.tokens import worker_tokenizer

CAPACITY = 2048
#: Mean pieces of a rank block.
BLOCK_ROWS = 4096
#: Characters tokenised together.
_CHUNK = 1 << 21

Pattern = tuple[tuple[int, ...], int]


def _complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; counts in ``free``."""
    if gap < 1:
        return None
    if free[gap] > 0:
        return (gap,)
    if pair := _pair(free, gap, gap):
        return pair
    for a in np.flatnonzero(free[: gap - 1])[::-1].tolist():
        free[a] -= 1
        pair = _pair(free, gap - a, a)
        free[a] += 1
        if pair:
            return (a, *pair)
    return None


def _pair(free: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """The best supplied lengths (a, b) with a + b = total, b <= a <= most."""
    half = total // 2
    low = max(1, total - most)
    if half < low:
        return None
    b = free[low : half + 1]
    a = free[total - half : total - low + 1][::-1]
    supply = np.minimum(a, b)
    if total % 2 == 0:
        supply[-1] = free[half] // 2
    at = int(supply.argmax())
    return (total - low - at, low + at) if supply[at] > 0 else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """[(lengths, times)]: patterns that hold every length as often as it occurs."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    patterns: list[Pattern] = []
    if free[capacity]:
        patterns.append(((capacity,), int(free[capacity])))
        free[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while free[length] > 0:
            free[length] -= 1
            rest = _complement(free, capacity - length)
            free[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            need = Counter(lengths)
            times = min(int(free[x]) // k for x, k in need.items())
            for x, k in need.items():
                free[x] -= k * times
            patterns.append((lengths, times))
    return patterns + _best_fit(free, capacity)


def _best_fit(free: np.ndarray, capacity: int) -> list[Pattern]:
    open_: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int, gap: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append([lengths, times])

    for length in np.flatnonzero(free)[::-1].tolist():
        n = int(free[length])
        while n and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            group = open_[gap][-1]
            used = min(n, group[1])
            group[1] -= used
            n -= used
            if not group[1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            put((*group[0], length), used, gap - length)
        each = capacity // length
        for copies, times in ((each, n // each), (n % each, 1)):
            if copies and times:
                put((length,) * copies, times, capacity - copies * length)
    return [(lengths, times) for groups in open_.values() for lengths, times in groups]


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks: (length << 40 | first rank), times, first sequence, offset; sorted."""
    given: Counter = Counter()
    rows, first = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append(((length << 40) + given[length], times, first, offset))
            given[length] += times
            offset += length
        first += times
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4


def _pieces(docs: DataFrame, vocab: str, capacity: int, with_ids: bool) -> DataFrame:
    end = np.array([0], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokenizer(vocab)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < _CHUNK):
                    size += len(texts[stop])
                    stop += 1
                out: list[tuple] = []
                for i, raw in enumerate(tokens.encode(texts[at:stop]), at):
                    raw += end
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[start : start + 4 * capacity]
                        out.append((i, k, start // 4, len(piece) // 4, zlib.crc32(piece), piece))
                row, k, start, length, crc, pieces = zip(*out, strict=True)
                columns = [ids.take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at = stop

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, schema)


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    docs: doc_id bigint, text string; other columns are not read. A document is
    the ids of its whole text and then id 0; a null or empty text is id 0 alone.
    Only documents of more than ``capacity`` ids are cut. sequence_id counts from
    0, offsets in a sequence are gapless from 0. With ``with_ids`` the ids come
    along as little-endian unsigned 32-bit bytes.

    Every row of ``docs`` is packed, also rows that repeat a doc_id or have none;
    pieces that are alike in all columns are interchangeable, so reruns agree. No
    rows give no rows.
    """
    pieces = stored(_pieces(docs, vocab, capacity, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    keys, times, first, offsets = _slots(plan(counts, capacity))
    blocks = max(1, -(-sum(counts.values()) // BLOCK_ROWS))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = placed.withColumn("within", F.row_number().over(inside) - 1).join(starts, ["length", "block"])
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(wanted)).to_numpy()
            key = (batch.column(3).to_numpy() << 40) + rank
            slot = np.searchsorted(keys, key, side="right") - 1
            columns = [batch.column(i) for i in range(5)] + [pa.array(first[slot] + key - keys[slot]), pa.array(offsets[slot])]
            names = [*wanted[:5], "sequence_id", "offset"]
            if with_ids:
                columns.append(batch.column(5))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return ranked.select(*wanted, (F.col("before") + F.col("within")).alias("rank")).mapInArrow(place, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
