"""The corpus pipeline: documents through five stages, each stored before the next reads it.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.llm import bpe, decontaminate, exact, near, quality
from ectolog.llm.registry import MULTI, table
from ectolog.llm.rows import stored
from ectolog.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on labelled good ones."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.kept_rows(docs, trusted)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact.kept_rows(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts with four fifths of their five-word shingles in common."""
    return near.kept_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.kept_rows(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of the text they decode to.

    Stored in between: the tasks of encode and decode never stand side by side, and get few rows at a time.
    """
    ids = stored(bpe.encode(docs, MULTI, public_tokenizers.PATTERN))
    found = bpe.decode(ids, MULTI).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return stored(found)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier, the stream's links or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        to = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
