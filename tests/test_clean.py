"""The cleaning job: its costly steps run once."""

import pytest
from pyspark.sql import functions as F

from postloom.operators.segment import make_paragraphs
from postloom.plans.clean import clean_corpus, normalized_docs


@pytest.mark.parametrize("whole", [True, False])
def test_paragraphs_are_scored_once(spark, whole):
    text = "\n".join(f"Line {i} tells about Berlin and more words. It has a second sentence." for i in range(6))
    posts = spark.createDataFrame([(i, f"t{i}", f"{text} {i}", f"l{i}") for i in range(20)], "row_key bigint, Title string, Description string, Link string")
    names = spark.createDataFrame([("berlin",)], "token string")
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def sure(_):
        scored.add(1)
        return 0.9

    def scorer(df):
        return df.withColumns({"prob_job": sure("text"), "prob_blurb_legal": F.lit(0.05), "prob_offer_detail": F.lit(0.05)})

    rows = clean_corpus(posts, scorer, names, maintain_paragraphs=whole).collect()
    n = make_paragraphs(normalized_docs(posts)).count()
    assert n and scored.value == n
    assert len(rows) == (n if whole else 20)
    assert all("words" in r.Description and "Berlin" not in r.Description for r in rows)
