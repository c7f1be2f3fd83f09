"""The three analyses of a labelled image set, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convolution, families, linalg, metrics, sampling, selection
from ..sources.images import varied
from ..sources.sinks import submission


def summary(rows: DataFrame) -> DataFrame:
    """Part A: samples, classes, features, the range of class sizes, and the shapes of the images as they were read and as they
    are, as text (the largest of each side)."""
    shape = lambda h, w: F.format_string("%d x %d", F.max(h), F.max(w))
    shapes = rows.agg(shape("raw_height", "raw_width").alias("original_shape"), shape("height", "width").alias("processed_shape"))
    return metrics.dataset_summary(rows).crossJoin(F.broadcast(shapes))  # one row each


def comparison(rows: DataFrame, classes: int, models=None, ratio: float = 0.2, seed: int = 42, **grids) -> DataFrame:
    """Part B: every setting of the families on one stratified holdout; features of all rows have one length."""
    size = len(rows.select("features").first()[0])
    return selection.tuned_on_holdout(rows, selection.grid(models, size, **grids), classes, ratio, seed)


def best_of(tuned: DataFrame) -> DataFrame:
    """Of each family, the first setting with the highest validation accuracy."""
    return tuned.groupBy("model").agg(F.max_by(F.struct("setting", "place", "train_accuracy", "validation_accuracy"), F.struct("validation_accuracy", -F.col("place"))).alias("b")).select("model", "b.*")


@dataclass(frozen=True)
class Chosen:
    """The outcome of nested selection: scores of outer folds, their summary, the winning family, and its setting on all rows."""

    folds: DataFrame
    summary: DataFrame
    family: str
    setting: dict
    model: object


def nested_selection(rows: DataFrame, classes: int, models=None, outer: int = 5, inner: int = 3, seed: int = 42, **grids) -> Chosen:
    """Part D: nested folds choose a family; its setting is chosen anew by inner folds on all rows (seed + 1000), and it is fitted on all rows."""
    size = len(rows.select("features").first()[0])
    settings = selection.grid(models, size, **grids)
    folds = selection.nested_cv(rows, settings, classes, outer, inner, seed)
    place = F.create_map(*[F.lit(v) for i, m in enumerate(settings) for v in (m, i)])
    ranked = selection.nested_summary(folds)
    family = metrics.best_model(ranked.withColumn("place", place[F.col("model")])).first().model
    best = metrics.best_settings(selection.kfold_scores(rows, {family: settings[family]}, classes, inner, seed + 1000)).first()
    setting = next(s for s in settings[family] if selection.shown(s) == best.best_setting)
    return Chosen(folds, ranked, family, setting, fitted(rows, family, setting, classes))


def fitted(rows: DataFrame, family: str, setting: dict, classes: int):
    """A family's model on all rows."""
    return families.FAMILIES[family].fit(rows, setting, classes)


def displayed(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """path, name and lines (rows of pixels) of n images to show: the first by path, or seeded-random ones."""
    some = rows.orderBy("path").limit(n) if seed is None else sampling.global_cap(rows, n, seed=seed)
    line = lambda i: F.slice("features", i * F.col("width") + 1, F.col("width"))
    return some.select("path", "name", F.transform(F.sequence(F.lit(0), F.col("height") - 1), line).alias("lines"))


def submitted(rows: DataFrame, classes: int, family: str = "knn", setting: dict | None = None) -> DataFrame:
    """Predictions for the rows that the model was fitted on, with names: with one neighbour each row finds itself."""
    setting = setting or {"k": 1}
    out = fitted(rows, family, setting, classes).transform(rows)
    return submission(out, rows.select("label", "name").distinct())


def variance_report(rows: DataFrame, components: int = 400, target: float = 0.95) -> DataFrame:
    """Explained variance, its part of the whole, the running total, and how many components reach the target.

    Ratios are of the sample variances of all components, so that those of all components sum to 1.
    """
    basis = linalg.fit_components(rows, components)
    total = float(linalg.moments(rows).agg(F.sum(F.col("variance") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)))).first()[0])
    out, run, reached = [], 0.0, None
    for i, v in enumerate(basis.explained_variance.tolist()):
        run += v / total
        reached = i + 1 if reached is None and run >= target else reached
        out.append((i + 1, v, v / total, run))
    return rows.sparkSession.createDataFrame(out, "component int, explained_variance double, ratio double, cumulative double").withColumn("n_target", F.lit(reached or 1))


#: Parts of validation and test rows of the network's split.
VALIDATION, TEST = 0.1, 0.2


def split_report(split: DataFrame) -> DataFrame:
    """Images and classes of each part of a split."""
    return split.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("label").alias("classes"))


@dataclass(frozen=True)
class Trained:
    """A network, its split, and its loss and accuracy on the test rows."""

    network: convolution.ConvNet
    split: DataFrame
    test_loss: float
    test_accuracy: float

    def report(self) -> DataFrame:
        """The history of training, with the epoch that was chosen and what it does on the test rows."""
        return self.network.history.withColumns({"chosen": F.col("epoch") == self.network.epoch, "test_loss": F.lit(self.test_loss), "test_accuracy": F.lit(self.test_accuracy)})


def network(rows: DataFrame, classes: int, validation: float = VALIDATION, test: float = TEST, augment: bool = True, seed: int = 42, **how) -> Trained:
    """A convolutional network on a stratified three-way split of images of one shape in [0, 1]; augment: varied copies in training."""
    split = sampling.three_way_split(rows, validation, test, seed=seed).persist()
    shapes = rows.select("height", "width").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("the images of a network have one shape; give a size")
    own = {name: split.where(F.col("split") == name) for name in ("train", "val", "test")}
    net = convolution.fit_convnet(own["train"], own["val"], classes, tuple(shapes[0]), vary=varied if augment else None, seed=seed, **how)
    loss, accuracy = convolution.evaluated(own["test"], replace(net, history=None), "features", "label")
    return Trained(net, split, loss, accuracy)
