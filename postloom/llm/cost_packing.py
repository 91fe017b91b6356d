"""Cost-balanced packing: descending documents go to the cheapest sequence with room.

A document of n tokens costs a linear share and a quadratic one for its attention,
``LINEAR * n + n * n``, and a sequence the sum of what it holds. Only the histogram
of lengths, at most ``capacity`` counts, meets in one place:

1.  tasks tokenise whole documents, cut those above the capacity, and write a row
    per document part with its ids and its number among the task's parts of that length;
2.  the driver plans with counts. Sequences in the same state are one group; the
    longest length goes to the group of least cost that takes it whole. If none
    does, the largest room is filled and the rest of the document returns as a
    shorter length. Every step ends a group's state or a length's count, so
    the plan's size depends on the capacity, not on the corpus;
3.  parts look up by length and rank where they lie, and follow their rests.

The rooms add up to the tokens: as many sequences of the capacity as can be full, and
powers of two for what is left, which need no padding.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.byte_tokens import worker_tokenizer
from postloom.llm.store import stored

CAPACITY = 1024
#: What a token costs besides attention, in token pairs.
LINEAR = 1024
#: Ids that a worker gathers before it hands rows on.
_CHUNK_IDS = 1 << 20
#: Parts that a task places at a time: their ids take four bytes here, and lie in lists, cut and in a column.
_PLACED = 1 << 10

#: Documents from a rank on: (length, first rank, times, sequence, offset, tokens taken, first rank of the rests).
Step = tuple[int, int, int, int, int, int, int]


def rooms(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(tokens, sequences): full ones, then a power of two for each binary digit of the remainder."""
    full, rest = divmod(total, capacity)
    return [(capacity, full)] * (full > 0) + [(1 << i, 1) for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def cost(length: int, linear: int = LINEAR) -> int:
    return linear * length + length * length


def plan(counts: dict[int, int], capacity: int = CAPACITY, linear: int = LINEAR) -> list[Step]:
    """Where every document of every length goes; the longest first, each to the cheapest sequence that takes it."""
    known = np.zeros(capacity + 1, dtype=np.int64)  # documents of a length, rests included
    for length, n in counts.items():
        known[length] = n
    waiting: list[list[tuple]] = [[] for _ in range(capacity + 1)]  # by room, heaps of (cost, first sequence, filled, sequences)
    first = 0
    for room, n in rooms(sum(k * n for k, n in counts.items()), capacity):
        waiting[room].append((0, first, 0, n))
        first += n
    able: list[tuple] = []  # groups that take the present length whole: the same, and their room
    steps: list[Step] = []
    for length in range(capacity, 0, -1):
        for group in waiting[length]:
            heapq.heappush(able, (*group, length))
        done = 0
        while done < known[length]:
            if able:
                spent, seq, filled, n, room = heapq.heappop(able)
                taken = length
            else:
                taken = room = next(r for r in range(length - 1, 0, -1) if waiting[r])
                spent, seq, filled, n = heapq.heappop(waiting[room])
            times, rest = min(n, int(known[length]) - done), length - taken
            steps.append((length, done, times, seq, filled, taken, int(known[rest]) if rest else 0))
            done += times
            known[rest] += times
            for group, left in (((spent, seq + times, filled, n - times), room), ((spent + cost(taken, linear), seq, filled + taken, times), room - taken)):
                if group[3] and left >= length:
                    heapq.heappush(able, (*group, left))
                elif group[3] and left:
                    heapq.heappush(waiting[left], group)
    return steps


def _table(steps: list[Step]) -> tuple[np.ndarray, ...]:
    """Keys (length << 40 | first rank), sequences, offsets, tokens taken, first ranks of the rests; by key."""
    rows = sorted(((length << 40) + rank, seq, at, taken, rest) for length, rank, _, seq, at, taken, rest in steps)
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 5


def _parts(docs: DataFrame, vocab: str, capacity: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, block, within, ids): within counts a task's parts of a length; ids take two bytes each where the vocabulary allows it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = worker_tokenizer(vocab), TaskContext.get().partitionId()
        width = "<u2" if tokens.library.get_vocab_size() <= 1 << 16 else "<u4"
        seen: Counter = Counter()
        names = ["doc_id", "start", "length", "doc_tokens", "block", "within", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.encode(text.as_py() or ""), np.uint32(0)).astype(width)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc, start, len(part), len(ids), block, seen[len(part)], part.tobytes()))
                    seen[len(part)] += 1
                    held += len(part)
                    if held >= _CHUNK_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id bigint, start bigint, length int, doc_tokens bigint, block bigint, within bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, schema)


def pack_by_cost(docs: DataFrame, vocab: str, capacity: int = CAPACITY, linear: int = LINEAR, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost[, ids]), one row per piece.

    docs: doc_id bigint, text string; other columns are not read. A document is the
    ids of its whole text and then id 0; a null or empty text is id 0 alone. Every
    id lies in one piece. sequence_id counts from 0; sequences have no gaps, all but a
    last few hold ``capacity`` tokens, and those hold powers of two. With
    ``with_ids`` the ids come along as little-endian unsigned 32-bit bytes.

    Every row of ``docs`` is packed, also rows that repeat a doc_id or have none. No
    rows give no rows. Which of several documents of one length lies where depends on
    how the input is split into tasks, the lengths in a sequence do not.
    """
    parts = stored(_parts(docs, vocab, capacity), "cost-parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    keys, seqs, offsets, takes, rests = _table(plan(counts, capacity, linear))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _PLACED) for b in batches for at in range(0, b.num_rows, _PLACED)):
            size = batch.num_rows
            row, start = np.arange(size), np.zeros(size, dtype=np.int64)
            length, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(batch.column(5).to_pylist(), length.tolist(), strict=True)]
            while len(row):  # a round for each rest
                key = (length << 40) + rank
                at = np.searchsorted(keys, key, side="right") - 1
                nth, taken = key - keys[at], takes[at]
                pieces = [ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(row.tolist(), start.tolist(), taken.tolist(), strict=True)]
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array(batch.column(1).to_numpy()[row] + start), pa.array(taken), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    batch.column(3).take(pa.array(row)), pa.array(seqs[at] + nth), pa.array(offsets[at]), pa.array(linear * taken + taken * taken),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(pieces, pa.binary())] * with_ids], [*names, *["ids"] * with_ids])
                more = taken < length
                row, start, length, rank = row[more], (start + taken)[more], (length - taken)[more], (rests[at] + nth)[more]

    ranked = parts.join(starts, ["length", "block"]).select("doc_id", "start", "length", "doc_tokens", (F.col("before") + F.col("within")).alias("rank"), "ids")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cost bigint" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
