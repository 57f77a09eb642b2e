import pytest
from pyspark.sql import types as T

#: Columns of documents, in another order, and columns whose names the operators use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang)."""

    def build(rows):
        full = [(r[2] if len(r) > 2 else "en", r[1], r[0], "x", None, "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
