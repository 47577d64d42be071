import random

import pytest
from pyspark.sql import functions as F


def table(spark, texts, start=0):
    """Documents with a column for each name that an operator may use itself."""
    rows = [(i + start, t, "x", "src", 1, "k", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node string").withColumn("row", F.lit(1)).withColumn("hash", F.lit("h"))


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, short, long, repeated."""
    rnd = random.Random(11)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(30_000))
    return [None, "", "   \n\t ", "a", "Same text here for all to see", "Same text here for all to see", long, "é 🙂 ẞ", "x" * 20_000]
