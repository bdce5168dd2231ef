import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """docs((doc_id, text), ...) with a source each, and columns whose names clash with those of results."""

    def docs(*rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "fp", "score", "root", "list", "target", "shard", "node", "bucket", "key", "base", "a", "b"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return docs
