import pytest
from pyspark.sql import functions as F

#: Rows that every operator must bear: null and empty texts, ties, repeats, a null id, an odd source, extra columns.
ODD = [
    (1, "the cat sat on the mat and then it slept", "en", "a", 5, "x"),
    (2, None, "en", "a", 5, "x"),
    (3, "", None, None, None, None),
    (4, "the cat sat on the mat and then it slept", "en", "b", 5, "y"),
    (4, "the cat sat on the mat and then it slept", "en", "b", 5, "y"),
    (5, " \t\n", "fr", "", 5, "x"),
    (6, "wörter über Äpfel " * 4000, "de", "a", 5, "x"),
    (7, "one", "en", "b", 5, "x"),
    (None, "released under the mit license now", "en", "c", 5, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, size string")
    return rows.withColumns({"label": F.lit("clash"), "fp": F.lit(1), "score": F.lit(2.0), "taken": F.lit(3), "quality": F.lit(0), "toxic_score": F.lit(9.0), "evidence": F.lit(1), "host_rate": F.lit(1), "bins": F.lit(1), "times": F.lit(9), "row": F.lit(1), "raw": F.lit(1)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (4, 1, 0), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
