"""Linear classifiers: nearest class mean and least squares; and a perceptron.

Fits read the rows once, as sums; models are small tables of numbers by class and component.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import Components, Sums, block, class_sums, grouped_sums


@dataclass(frozen=True)
class LinearModel:
    """scores = x @ weights.T + bias; the first of the largest scores is the predicted class."""

    weights: np.ndarray
    bias: np.ndarray
    basis: Components | None = None
    setting: dict = field(default_factory=dict)

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        """All that has to be stored."""
        basis = {} if self.basis is None else {"mean": self.basis.mean, "components": self.basis.components, "explained_variance": self.basis.explained_variance}
        return {"weights": self.weights, "bias": self.bias, **basis}

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x if self.basis is None else self.basis.project(x)[:, : self.weights.shape[1]]
        return z @ self.weights.T + self.bias

    def transform(self, df: DataFrame, features: str = "features", keep_scores: bool = False) -> DataFrame:
        """Adds predicted (and scores)."""

        @F.pandas_udf("predicted int, scores array<double>")
        def run(x: pd.Series) -> pd.DataFrame:
            s = self.scores(block(x)) if len(x) else np.zeros((0, len(self.bias)))
            return pd.DataFrame({"predicted": s.argmax(1).astype(np.int32) if len(s) else [], "scores": list(s)})

        out = df.withColumn("_out", run(features)).withColumn("predicted", F.col("_out.predicted"))
        return (out.withColumn("scores", F.col("_out.scores")) if keep_scores else out).drop("_out")


def centroids(df: DataFrame, classes: int, features: str = "features", label: str = "label") -> DataFrame:
    """label, pos, n and mean of each class from 0; zeros for an empty class."""
    sums = class_sums(df, features, label)
    every = sums.select("pos").distinct().select("pos", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("label"))
    own = sums.select(F.col(label).cast("int").alias("label"), "pos", "n", (F.col("total") / F.col("n")).alias("mean"))
    return every.join(own, ["label", "pos"], "left").select("label", "pos", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def nearest_mean_of(sums: Sums, basis: Components | None = None, **setting) -> LinearModel:
    """Nearest class mean as a linear model: -|x - m|^2 differs from 2 x.m - |m|^2 by the same for each class.

    An empty class has a mean of zeros, and takes part.
    """
    means = sums.per_class / np.maximum(sums.counts, 1)[:, None]
    return LinearModel(2 * means, -(means**2).sum(1), basis, setting)


def least_squares_of(sums: Sums, basis: Components | None = None, **setting) -> LinearModel:
    """Least squares on one-hot targets with a bias, of the smallest norm, from the normal equations."""
    g = np.block([[sums.products, sums.total[:, None]], [sums.total[None], np.array([[float(sums.n)]])]])
    cross = np.vstack([sums.per_class.T, sums.counts[None].astype(float)])
    w = np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ cross
    return LinearModel(w[:-1].T, w[-1], basis, setting)


def fit_nearest_mean(df: DataFrame, classes: int, features: str = "features", label: str = "label") -> LinearModel:
    return nearest_mean_of(grouped_sums(df, 1, classes, features=features, label=label)[0])


def fit_least_squares(df: DataFrame, classes: int, features: str = "features", label: str = "label") -> LinearModel:
    return least_squares_of(grouped_sums(df, 1, classes, features=features, label=label)[0])


@dataclass(frozen=True)
class Perceptron:
    """A network of fully connected layers."""

    model: MultilayerPerceptronClassificationModel

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds predicted and confidence, the largest of the class probabilities."""
        out = self.model.transform(df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))))
        return out.withColumn("predicted", F.col("_label").cast("int")).withColumn("confidence", F.array_max(vector_to_array("_probability"))).drop("_x", "_raw", "_probability", "_label")


def fit_perceptron(df: DataFrame, classes: int, hidden: tuple[int, ...] = (32,), epochs: int = 50, seed: int = 42, features: str = "features", label: str = "label") -> Perceptron:
    """Stands in for a convolutional network, without claiming its accuracy: Spark has no such network."""
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("_x"))
    size = len(df.select(features).first()[0])
    network = MultilayerPerceptronClassifier(layers=[size, *hidden, classes], maxIter=epochs, seed=seed, featuresCol="_x", labelCol="label", predictionCol="_label").setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return Perceptron(network.fit(rows))
