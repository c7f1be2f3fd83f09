"""Predictions for images as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.classifiers import LinearModel
from ..sources.images import decoded


def predicted_stream(spark: SparkSession, path: str, model: LinearModel, size: tuple[int, int] | None = None, how: str = "zscore") -> DataFrame:
    """path and predicted of each new PGM file under a directory, as a streaming DataFrame; files that fail are skipped."""
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path).select("path", "content")
    return model.transform(decoded(files, size, how, permissive=True)).select("path", "predicted")
