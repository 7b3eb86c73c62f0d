"""New documents as a stream: parsing and checks within a document need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.blocks import records


def arriving(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Parquet files of (doc_id, path, text) as they come."""
    return spark.readStream.schema("doc_id bigint, path string, text string").option("maxFilesPerTrigger", files_each).parquet(folder)


def record_stream(docs: DataFrame) -> DataFrame:
    return records(docs)


def kind_counts(docs: DataFrame) -> DataFrame:
    return records(docs, inlines=False).where("depth = 0").groupBy("kind").agg(F.count("*").alias("n"))
