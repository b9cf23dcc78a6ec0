import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents frame from (doc_id, text) pairs, with columns whose names clash with added ones."""

    def make(rows, **more):
        frame = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS)
        from pyspark.sql import functions as F

        for name, value in more.items():
            frame = frame.withColumn(name, F.lit(value))
        return frame

    return make
