"""The text signals and the rule score over a stream of documents: the same column expressions, no state.

An extension: batch analytics is all that is asked for elsewhere in this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scoring


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored(docs: DataFrame, text_col: str = "text", phrases: list[str] | None = None) -> DataFrame:
    df = scoring.with_interactions(scoring.text_features(docs, text_col, phrases))
    return df.withColumn("score", scoring.rule_score(df))
