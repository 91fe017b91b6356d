"""Class probabilities and the label rule on top of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

CLASS_TO_COLUMN = {"JOB": "prob_job", "CONTEXT": "prob_blurb_legal", "CONDITIONS": "prob_offer_detail"}
LABEL_TO_CLASS = {"job": "JOB", "blurb_legal": "CONTEXT", "offer_detail": "CONDITIONS"}


def predict_label(
    job: Column,
    blurb: Column,
    offer: Column,
    job_threshold: float = 0.4,
    blurb_threshold: float = 0.4,
    diff_threshold: float = 0.15,
    low_conf_threshold: float = 0.3,
) -> Column:
    """Lean towards job: only a clear other winner is called something else."""
    top = F.greatest(job, blurb, offer)
    winner = F.when(job == top, "job").when(blurb == top, "blurb_legal").otherwise("offer_detail")
    job_enough = job > job_threshold
    return (
        F.when((blurb > blurb_threshold) & ~job_enough, "blurb_legal")
        .when(job_enough | (top - job < diff_threshold) | (top < low_conf_threshold), "job")
        .otherwise(winner)
    )


def class_columns(
    probability: Column, labels: Sequence[str], mapping: Mapping[str, str] = CLASS_TO_COLUMN
) -> dict[str, Column]:
    """Named probability columns of a class vector; an absent class gets 0."""
    place = {name.upper(): i for i, name in enumerate(labels)}
    values = vector_to_array(probability)
    return {
        column: values[place[name]] if name in place else F.lit(0.0)
        for name, column in mapping.items()
    }


def label_to_class(label: Column, mapping: Mapping[str, str] = LABEL_TO_CLASS) -> Column:
    out = F.lit(None).cast("string")
    for name, cls in mapping.items():
        out = F.when(label == name, cls).otherwise(out)
    return out
