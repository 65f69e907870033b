import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, ties, repeats, empty texts, a long text, and columns that clash with results' names."""
    rows = [(5, "a b c d e"), (2, "a b c d e"), (9, None), (4, ""), (None, "x y z"), (7, "x y z"), (7, "x y z"),
            (3, "word " * 30000), (8, "word " * 29999 + "end"), (None, None), (11, "Ünïcödé 你好 😀")]
    return spark.createDataFrame([Row(doc_id=i, text=t, kept="k", digest="d", score="s", row="r", id="i", _id="x", sha="h",
                                      component_id="c", block="b", rest="q", n_chars=1) for i, t in rows],
                                 "doc_id long, text string, kept string, digest string, score string, row string, id string, "
                                 "_id string, sha string, component_id string, block string, rest string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
