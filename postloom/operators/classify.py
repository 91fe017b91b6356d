"""Training, applying and judging the paragraph classifier."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import class_columns
from .embed import embed_text
from .stats import macro_f1

# Weight of a class in the loss.
CLASS_WEIGHTS = {"JOB": 2.0, "CONTEXT": 1.0, "CONDITIONS": 1.0}


def train_classifier(
    df: DataFrame,
    weights: Mapping[str, float] = CLASS_WEIGHTS,
    max_iter: int = 2000,
    label: str = "label",
    vector: str = "embedding",
) -> PipelineModel:
    """Class-weighted multinomial logistic regression.

    The penalty is one over the summed weights: here it acts on the mean loss,
    and a unit penalty on the summed loss is what is meant.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(label)), F.lit(1.0))
    rows = df.select(label, vector, weight.alias("_weight"))
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    total = rows.agg(F.sum("_weight")).head()[0] or 1.0
    fit = LogisticRegression(
        featuresCol=vector,
        labelCol="_label",
        weightCol="_weight",
        maxIter=max_iter,
        regParam=1.0 / total,
        standardization=False,
        family="multinomial",
        predictionCol="_class",
        rawPredictionCol="_raw",
    ).fit(index.transform(rows))
    name = IndexToString(inputCol="_class", outputCol="pred", labels=index.labels)
    return PipelineModel(stages=[index, fit, name])


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score_paragraphs(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds prob_job, prob_blurb_legal, prob_offer_detail and ``pred``."""
    # The label index is for training rows only.
    out = PipelineModel(stages=model.stages[1:]).transform(df)
    return out.withColumns(class_columns(F.col("probability"), class_labels(model))).drop("_raw", "_class", "probability")


def model_scorer(embedder: PipelineModel, classifier: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A scorer for the cleaning job out of the two fitted models."""

    def score(paras: DataFrame) -> DataFrame:
        return score_paragraphs(embed_text(paras, "text", model=embedder), classifier).drop("embedding", "pred")

    return score


def evaluate_classifier(preds: DataFrame) -> DataFrame:
    """All predictions of all models with ``job_mistake`` and the model's macro F1.

    One job for every ``model_name``; the per-model scores are a handful of rows.
    """
    mistake = (F.col("true") == "JOB") != (F.col("pred") == "JOB")
    return preds.withColumn("job_mistake", mistake).join(macro_f1(preds, ["model_name"]), "model_name", "left")
