"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of three to five bytes of the lower-cased text, with
runs of blanks as one, hashed into slots. The ratio of a slot is the log of its
smoothed share among toxic texts to that among others; a logistic regression
on the ratios of a text's slots gives the score. It is trained on at most
``PER_CLASS`` texts of each class, those with the smallest hash of their doc_id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.store import stored

#: Training texts of each class, at most.
PER_CLASS = 4000
SLOT_BITS = 20
#: Slots the regression sees: those whose shares differ most clearly.
KEPT_SLOTS = 1 << 14
SIZES = (3, 4, 5)


def slots(text: str | None) -> np.ndarray:
    """Slots of all n-grams, with repetitions."""
    raw = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    h, out = b, []
    for n in range(2, SIZES[-1] + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in SIZES:
            out.append((h + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def held_out() -> Column:
    """crc32 of the doc_id's digits is divisible by 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Weight of every slot, and the intercept."""

    weights: np.ndarray
    intercept: float


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(y, text): labelled texts that are not held out, at most ``per_class`` of each class."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows of two numbers
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) whose document is not held out.

    Nulls in labels take no part; a document labelled twice is toxic if one label
    says so. With no training text of one class the score is a constant: 0
    without any toxic text, 1 without any other.
    """
    sample = stored(_sample(docs, labels, per_class).repartition(12), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(1 << SLOT_BITS, dtype=np.float32)
    if not sizes.get(1):
        return Model(empty, -np.inf)
    if not sizes.get(0):
        return Model(empty, np.inf)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << SLOT_BITS), dtype=np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y, np.unique(slots(text))] += 1
        used = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[0, used]), pa.array(held[1, used])], ["slot", "n0", "n1"])

    held = sample.mapInArrow(present, "slot bigint, n0 bigint, n1 bigint").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = [(F.col(f"n{y}") + 1) / F.lit(sizes[y] + 2.0) for y in (0, 1)]
    both = (F.col("n0") + F.col("n1") + 1) / F.lit(sizes[0] + sizes[1] + 2.0)
    clear = F.abs(share[1] - share[0]) / F.sqrt(both * (1 - both))
    best = held.select("slot", F.log(share[1] / share[0]).alias("ratio"), clear.alias("clear")).orderBy(F.desc("clear"), "slot").limit(KEPT_SLOTS).collect()
    slot = np.array(sorted(r["slot"] for r in best))
    ratio = dict((r["slot"], r["ratio"]) for r in best)
    ratio = np.array([ratio[s] for s in slot])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        place[slot] = np.arange(len(slot))
        for batch in batches:
            at = [np.unique(p[p >= 0]) for p in (place[slots(t)] for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy().astype(float)), pa.array(at, pa.list_(pa.int32()))], ["label", "at"])

    sparse = F.udf(lambda at: Vectors.sparse(len(slot), at, ratio[at]), VectorUDT())
    # Written in between, so that no task runs two Python workers at a time.
    rows = stored(sample.mapInArrow(vectors, "label double, at array<int>"), "toxic-slots").select("label", sparse("at").alias("features"))
    fitted = LogisticRegression(regParam=0.0005, maxIter=40, standardization=False).fit(stored(rows, "toxic-vectors"))
    weights = empty.copy()
    weights[slot] = fitted.coefficients.toArray() * ratio
    return Model(weights, float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id bigint, text string).

    The score of a null or empty text is that of no n-grams. doc_id serves only
    held_out; other columns are not read.
    """
    weights, intercept = model.weights, model.intercept

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    def scores(texts: list[str | None]) -> np.ndarray:
        total = np.array([intercept + _sum(weights, slots(t)) for t in texts])
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-total))

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("doc_id", held_out().alias("held_out"), "text")
    return read.mapInArrow(rows, "doc_id bigint, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model trained on their labelled part does not call toxic, with their own columns."""
    model = train(docs, labels)
    weights, intercept = model.weights, model.intercept

    def toxic(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(intercept + _sum(weights, slots(t)) >= 0))

    return docs.where(~F.pandas_udf(toxic, "boolean")(F.coalesce("text", F.lit(""))))


def _sum(weights: np.ndarray, at: np.ndarray) -> float:
    return float(weights[np.unique(at[weights[at] != 0])].sum())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
