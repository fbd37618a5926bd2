import pytest


@pytest.fixture
def docs(spark):
    """A table with everything that operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
        if not extra:
            return df
        from pyspark.sql import functions as F

        # Names that the operators use inside.
        return df.select("*", *(F.lit(7).alias(c) for c in ("fp", "root", "n", "cell", "_q", "label", "cid", "rep")))

    return make
