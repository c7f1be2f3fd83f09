"""Counts and scores of labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def dense_class_counts(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """Counts of the classes from 0, zeros kept."""
    dim = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    return dim.join(class_counts(df, label), label, "left").fillna(0, ["n"])


def class_count_range(df: DataFrame, label: str = "label") -> DataFrame:
    return class_counts(df, label).agg(F.min("n").alias("min_count"), F.max("n").alias("max_count"), F.count("*").alias("n_classes"))


def dataset_summary(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """One row: n_samples, n_classes, n_features and the range of class sizes, from one aggregation by class."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), F.max(F.size(features)).alias("p"))
    return per.agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"), F.max("p").cast("long").alias("n_features"), F.min("n").alias("min_class_count"), F.max("n").alias("max_class_count"))


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: n and accuracy, not a number without rows."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("double")), F.lit(float("nan"))).alias("accuracy"))


def confusion(df: DataFrame, classes: int, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """A row for each pair of classes from 0, zeros kept: the columns truth and predicted, and n."""
    dim = df.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias(truth), (F.col("id") % classes).cast("int").alias(predicted))
    counted = df.groupBy(F.col(truth).cast("int").alias(truth), F.col(predicted).cast("int").alias(predicted)).agg(F.count("*").alias("n"))
    return dim.join(counted, [truth, predicted], "left").fillna(0, ["n"])


def purity(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """One row: the part of rows whose class is their cluster's commonest."""
    most = df.groupBy(cluster, label).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return most.agg((F.sum("most") / F.sum("all")).alias("purity"), F.count("*").alias("n_clusters"))


def weighted_scores(df: DataFrame, loss: str = "loss", right: str = "right", n: str = "n") -> DataFrame:
    """Mean loss and accuracy of batches by their sizes."""
    size = F.greatest(F.sum(n), F.lit(1))
    return df.agg((F.sum(F.col(loss) * F.col(n)) / size).alias("loss"), (F.sum(right) / size).alias("accuracy"))


def error_rates(train: Column, validation: Column) -> tuple[Column, Column, Column]:
    """Error on training and validation rows, and the gap between them, at least 0."""
    return (1 - train).alias("train_error"), (1 - validation).alias("validation_error"), F.greatest(F.lit(0.0), (1 - validation) - (1 - train)).alias("gap")


def fold_summary(scores: DataFrame, by: str = "model", score: str = "score", inner: str = "inner_score") -> DataFrame:
    """Of each model: folds, mean and sample deviation of outer scores (0 for one fold), and mean inner score."""
    return scores.groupBy(by).agg(F.count("*").alias("n_folds"), F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_score"), F.avg(inner).alias("mean_inner_score"))


def best_settings(scores: DataFrame, by: str = "model", setting: str = "setting", place: str = "place", score: str = "score") -> DataFrame:
    """Of each model the setting with the highest mean score; of equals the first in the grid."""
    means = scores.groupBy(by, setting, place).agg(F.avg(score).alias("mean_score"))
    return means.groupBy(by).agg(F.max_by(setting, F.struct("mean_score", -F.col(place))).alias("best_setting"), F.max("mean_score").alias("best_score"))


def best_model(summary: DataFrame, place: str = "place") -> DataFrame:
    """The family with the highest mean score, then the smallest deviation, then the first."""
    return summary.orderBy(F.desc("mean_score"), "std_score", place).limit(1)


def setting_counts(chosen: DataFrame, by: str = "model", setting: str = "setting") -> DataFrame:
    """How often each model's settings were chosen."""
    return chosen.groupBy(by, setting).agg(F.count("*").alias("n"))


def best_epoch(history: DataFrame, patience: int | None = None) -> DataFrame:
    """Of rows (epoch, accuracy, loss): highest accuracy, then lowest loss, then first.

    patience: training stops after so many epochs in a row without a better one; later epochs don't count.
    """
    if patience is not None:
        before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each epoch
        upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
        score = F.struct("accuracy", -F.col("loss"))
        better = F.coalesce(score > F.max(score).over(before), F.lit(True))
        waited = history.withColumn("_better", better).withColumn("_n", F.row_number().over(Window.orderBy("epoch")))
        waited = waited.withColumn("_waited", F.col("_n") - F.max(F.when(F.col("_better"), F.col("_n"))).over(upto))
        stopped = F.max((F.col("_waited") >= patience).cast("int")).over(before)
        history = waited.withColumn("_stopped", F.coalesce(stopped, F.lit(0))).where("_stopped = 0").drop("_better", "_n", "_waited", "_stopped")
    return history.orderBy(F.desc("accuracy"), "loss", "epoch").limit(1)
