"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(predicted: DataFrame, names: DataFrame, path: str = "path", truth: str = "label", guess: str = "predicted") -> DataFrame:
    """Image_Path, True_Label and Predicted_Label, with the names of the labels."""
    true = names.select(F.col("label").alias(truth), F.col("name").alias("True_Label"))
    said = names.select(F.col("label").alias(guess), F.col("name").alias("Predicted_Label"))
    rows = predicted.select(F.col(path).alias("Image_Path"), truth, guess)
    return rows.join(true, truth, "left").join(said, guess, "left").select("Image_Path", "True_Label", "Predicted_Label")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, as many as the result has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
