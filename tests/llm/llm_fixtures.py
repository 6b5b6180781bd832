import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names operators use inside."""

    def build(*rows, extra=False):
        full = [(i, t, *more, *[None] * (2 - len(more)), None if t is None else len(t)) for i, t, *more in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("key", "node", "score", "ids", "spans", "blob", "size", "part", "component_id", "toxic"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
