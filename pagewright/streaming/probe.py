"""An addition of our own: the stateless whitespace probe over a stream of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.spans import whitespace_findings


def stream_findings(spark: SparkSession, folder: str, schema: str = "page long, text string") -> DataFrame:
    """Findings of page rows that arrive as Parquet files in ``folder``. No state, so no watermark."""
    return whitespace_findings(spark.readStream.schema(schema).parquet(folder)).drop("text")
