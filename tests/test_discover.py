"""Topics written and read back."""

import pytest
from pyspark.errors import AnalysisException

from postloom.plans.discover import Topics, load_topics, save_topics


def test_topics_come_back(spark, tmp_path):
    made = Topics(
        spark.createDataFrame([(0, 2, "0_a_b", ["a", "b"]), (-1, 1, None, [])], "topic int, count long, name string, words array<string>"),
        spark.createDataFrame([("D1", 0, ""), (None, None, None)], "doc_id string, topic int, text string"),
        spark.createDataFrame([], "topic int, mean double"),
        spark.createDataFrame([(0, "a", 0.5)], "topic int, term string, weight double"),
        spark.createDataFrame([("D1", [0.25, -1.0], 0)], "doc_id string, v array<double>, topic int"),
    )
    path = str(tmp_path / "topics")
    for _ in range(2):
        save_topics(made, path)
        back = load_topics(spark, path)
        for name, frame in vars(made).items():
            again = getattr(back, name)
            assert again.dtypes == frame.dtypes
            assert sorted(map(str, again.collect())) == sorted(map(str, frame.collect()))


def test_missing_part_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_topics(spark, str(tmp_path / "nothing"))
