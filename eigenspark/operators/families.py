"""Families of classifiers: what a family needs in order to take part in grids, holdouts, folds and pipelines.

A family names its settings, is judged on many folds at once, and is fitted on all rows as a model with `transform`.
`Linear` families give a LinearModel for every fold and setting, and all of these are scored in one pass; `Neighbors`
searches all folds at once; `Estimated` takes any estimator of Spark's machine-learning library.  `FamilyEstimator` is the
other way round: a family as an estimator of that library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linalg, neighbors
from .classifiers import LinearModel, least_squares_of, nearest_mean_of
from .linalg import Components, Sums, basis_sums, block, components_of, grouped_sums, lanczos, projected_sums
from .svm import fit_svms

#: Default grids.
COMPONENTS = (50, 100, 200, 363)
SVM_REG, SVM_EPOCHS, SVM_RATES = (1e-4, 1e-3, 1e-2), (20, 50), (0.1, 0.2)
NEIGHBORS = (1, 3, 5)


@dataclass
class Folds:
    """Rows with the arrays `asks` and `trains`: the groups (from 0) in which a row is judged, and in which it is a training row.

    train_sums: makes the sums over the training rows of each group from those over its judged rows, so that few passes
    and products are needed; without it the sums aren't taken that way.
    """

    rows: DataFrame
    groups: int
    classes: int
    asks: str = "_asks"
    trains: str = "_trains"
    row_id: str = "row_id"
    label: str = "label"
    features: str = "features"
    train_sums: Callable[[dict[int, Sums]], dict[int, Sums]] | None = None
    _spaces: dict[int, tuple[Components, Sums]] = field(default_factory=dict)
    _most: int = 0

    def exploded(self) -> DataFrame:
        """A row for each group in which a row is judged, _g."""
        return self.rows.withColumn("_g", F.explode(self.asks))

    def spaces(self, most: int) -> dict[int, tuple[Components, Sums]]:
        """Components of the training rows of each group, and the sums of these rows in their space; made once.

        With few features from sums of products of all pairs of features, else by `lanczos`; either is exact.
        """
        if most > self._most:
            sets = list(range(self.groups))
            p = len((self.rows.select(self.features).first() or [[]])[0])
            if p <= linalg.WIDE and self.train_sums is not None:
                judged = grouped_sums(self.exploded(), self.groups, self.classes, "_g", self.features, self.label)
                sums = self.train_sums(dict(enumerate(judged)))
                bases = {g: components_of(s, most) for g, s in sums.items()}
                self._spaces = {g: (bases[g], projected_sums(s, bases[g])) for g, s in sums.items()}
            else:
                bases = lanczos(self.rows, most, self.features, self.trains, sets)
                z = basis_sums(self.rows, bases, self.classes, self.features, self.label, self.trains)
                self._spaces = {g: (bases[g], z[g]) for g in sets}
            self._most = most
        return self._spaces


def holdout_sums(judged: dict[int, Sums]) -> dict[int, Sums]:
    """The rows of group 0 train both groups."""
    return {0: judged[0], 1: judged[0]}


def kfold_sums(judged: dict[int, Sums]) -> dict[int, Sums]:
    """A fold is trained by all others."""
    whole = sum(list(judged.values())[1:], judged[0])
    return {g: whole - s for g, s in judged.items()}


class Family:
    """A kind of classifier.  on_components: whether settings have n_components."""

    name, title, on_components = "", "", False

    def settings(self, sizes: list[int], **grids) -> list[dict]:
        """The grid, from feasible numbers of components and the options that a family knows."""
        raise NotImplementedError

    def judge(self, folds: Folds, settings: list[dict]) -> DataFrame:
        """g, place, n, right: how many rows of each group are classified rightly with the setting at each place of the grid."""
        raise NotImplementedError

    def fit(self, rows: DataFrame, setting: dict, classes: int, row_id: str = "row_id", label: str = "label", features: str = "features"):
        """A model of all rows: `transform` adds predicted, `arrays` is what has to be stored of it, and `rows` its training rows if
        these have to be stored too."""
        raise NotImplementedError

    def restored(self, setting: dict, arrays: dict[str, np.ndarray], rows: DataFrame | None):
        """The model from what was stored."""
        raise NotImplementedError


def in_space(basis: Components, z: Sums, size: int) -> Sums:
    """Sums over the first components only."""
    c = min(size, len(basis.components))
    return Sums(z.n, z.total[:c], z.products[:c, :c], z.per_class[:, :c], z.counts)


class Linear(Family):
    """Families whose models are linear in the components."""

    on_components = True

    def models(self, folds: Folds, settings: list[dict]) -> dict[int, list[LinearModel]]:
        """A model for each group and setting."""
        raise NotImplementedError

    def settings(self, sizes, **grids):
        return [{"n_components": c} for c in sizes]

    def judge(self, folds, settings):
        found = self.models(folds, settings)
        return scored(folds, {g: [(self.name, i, m) for i, m in enumerate(own)] for g, own in found.items()}).drop("model")

    def fit(self, rows, setting, classes, row_id="row_id", label="label", features="features"):
        whole = rows.withColumn("_asks", F.array(F.lit(0))).withColumn("_trains", F.array(F.lit(0)))
        return self.models(Folds(whole, 1, classes, row_id=row_id, label=label, features=features, train_sums=dict), [setting])[0][0]

    def restored(self, setting, arrays, rows):
        basis = Components(arrays["mean"], arrays["components"], arrays["explained_variance"]) if "mean" in arrays else None
        return LinearModel(arrays["weights"], arrays["bias"], basis, setting)


class FromSums(Linear):
    """Families whose models are made from sums: of (sums, basis, **setting)."""

    def __init__(self, name: str, title: str, make):
        self.name, self.title, self.make = name, title, make

    def models(self, folds, settings):
        spaces = folds.spaces(max(s["n_components"] for s in settings))
        return {g: [self.make(in_space(basis, z, s["n_components"]), basis, **s) for s in settings] for g, (basis, z) in spaces.items()}


class SupportVectors(Linear):
    """Support vector machines by mini-batch descent."""

    name, title = "svm", "Support vector machine"

    def settings(self, sizes, regs=SVM_REG, epochs=SVM_EPOCHS, rates=SVM_RATES, **grids):
        return [{"n_components": c, "reg_strength": r, "epochs": e, "learning_rate": a} for c in sizes for r in regs for e in epochs for a in rates]

    def models(self, folds, settings):
        bases = {g: basis for g, (basis, _) in folds.spaces(max(s["n_components"] for s in settings)).items()}
        found = fit_svms(folds.rows, settings, folds.classes, bases, folds.trains, folds.features, folds.label, row_id=folds.row_id)
        return {g: [found[g, i] for i in range(len(settings))] for g in bases}


def scored(folds: Folds, models: dict[int, list[tuple[str, int, LinearModel]]]) -> DataFrame:
    """g, model, place, n, right: how many rows of each group its models classify rightly, in one pass.

    Rows are projected once for all models of a group that share a basis.
    """

    def run(batches):
        sums: dict[tuple, list[int]] = {}
        for pdf in batches:
            x, y, which = block(pdf["_x"]), pdf["_y"].to_numpy(int), pdf["_g"].to_numpy(int)
            for g in np.unique(which):
                own, truth = x[which == g], y[which == g]
                projected: dict[int, np.ndarray] = {}
                for name, place, model in models.get(int(g), []):
                    if model.basis is None:
                        s = model.scores(own)
                    else:
                        if id(model.basis) not in projected:
                            projected[id(model.basis)] = model.basis.project(own)
                        s = projected[id(model.basis)][:, : model.weights.shape[1]] @ model.weights.T + model.bias
                    old = sums.setdefault((int(g), name, place), [0, 0])
                    old[0] += len(truth)
                    old[1] += int((s.argmax(1) == truth).sum())
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["g", "model", "place", "n", "right"])

    rows = folds.exploded().select(F.col(folds.features).alias("_x"), F.col(folds.label).alias("_y"), "_g")
    parts = rows.mapInPandas(run, "g int, model string, place int, n long, right long")
    return parts.groupBy("g", "model", "place").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


def group_mask(groups: Column, wave: int) -> Column:
    """Bits of the numbers in an array of groups, of those of one search."""
    own = F.filter(groups, lambda g: F.floor(g / neighbors.GROUPS) == wave)
    return F.aggregate(own, F.lit(0).cast("long"), lambda m, g: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (g % neighbors.GROUPS).cast("int"))))


@dataclass(frozen=True)
class NeighborModel:
    """The training rows themselves."""

    rows: DataFrame
    k: int
    columns: tuple[str, str, str] = ("row_id", "label", "features")

    def transform(self, df: DataFrame, features: str | None = None) -> DataFrame:
        """Adds predicted; rows are told by their id, a number of their own where they have none."""
        row_id, label, x = self.columns
        found = neighbors.vote(neighbors.neighbors(df.select(row_id, F.lit(None).cast("int").alias(label), F.col(features or x).alias(x)), self.rows, self.k, *self.columns))
        return df.join(found.withColumnRenamed("query_id", row_id), row_id)

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        return {}


class Neighbors(Family):
    """k nearest neighbours, on the features themselves; all groups and k come from one search."""

    name, title = "knn", "k nearest neighbours"

    def settings(self, sizes, ks=NEIGHBORS, **grids):
        return [{"k": k} for k in sorted({max(1, int(k)) for k in ks})]

    def judge(self, folds, settings):
        rows, row_id = folds.rows, folds.row_id
        ks = {s["k"]: i for i, s in enumerate(settings)}
        place = F.create_map(*[F.lit(v) for k, i in ks.items() for v in (k, i)])
        truth = rows.select(F.col(row_id).alias("query_id"), F.col(folds.label).alias("truth"))
        out = None
        for wave in range(-(-folds.groups // neighbors.GROUPS)):
            masked = rows.select(row_id, folds.label, folds.features, group_mask(F.col(folds.asks), wave).alias("_a"), group_mask(F.col(folds.trains), wave).alias("_t"))
            near = neighbors.masked_neighbors(masked, max(ks), "_a", "_t", row_id, folds.label, folds.features)
            votes = neighbors.sweep(near, list(ks), "g").join(truth, "query_id")
            own = votes.groupBy("g", "k").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("truth")).cast("long")).alias("right"))
            own = own.select((F.col("g") + wave * neighbors.GROUPS).cast("int").alias("g"), place[F.col("k")].alias("place"), "n", "right")
            out = own if out is None else out.unionByName(own)
        return out

    def fit(self, rows, setting, classes, row_id="row_id", label="label", features="features"):
        return NeighborModel(rows.select(row_id, label, features), setting["k"], (row_id, label, features))

    def restored(self, setting, arrays, rows):
        return NeighborModel(rows, setting["k"], tuple(rows.columns))


@dataclass(frozen=True)
class SparkModel:
    """A fitted model of Spark's library."""

    model: Model
    features: str = "features"

    def transform(self, df: DataFrame, features: str | None = None) -> DataFrame:
        out = self.model.transform(df.withColumn("_v", array_to_vector(F.col(features or self.features).cast("array<double>"))))
        made = [c for c in out.columns if c not in df.columns and c != "_p"]
        return out.withColumn("predicted", F.col("_p").cast("int")).drop("_p", *made)


class Estimated(Family):
    """A family of any of Spark's estimators of classifiers: make(**setting) gives one.

    Each group and setting is a fit of its own, on the rows of the group; the estimator's own jobs do the work.
    """

    def __init__(self, name: str, title: str, make, grid: list[dict]):
        self.name, self.title, self.make, self.grid = name, title, make, grid

    def settings(self, sizes, **grids):
        return [dict(s) for s in self.grid]

    def fit(self, rows, setting, classes, row_id="row_id", label="label", features="features"):
        estimator = self.make(**setting)
        estimator = estimator.copy({estimator.getParam("featuresCol"): "_v", estimator.getParam("labelCol"): "_y", estimator.getParam("predictionCol"): "_p"})
        data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"), F.col(label).cast("double").alias("_y"))
        return SparkModel(estimator.fit(data), features)

    def judge(self, folds, settings):
        out = None
        for g in range(folds.groups):
            train = folds.rows.where(F.array_contains(folds.trains, g))
            test = folds.rows.where(F.array_contains(folds.asks, g))
            for place, setting in enumerate(settings):
                model = self.fit(train, setting, folds.classes, folds.row_id, folds.label, folds.features)
                right = F.sum((F.col("predicted") == F.col(folds.label)).cast("long"))
                own = model.transform(test).agg(F.count("*").alias("n"), right.alias("right")).select(F.lit(g).alias("g"), F.lit(place).alias("place"), "n", "right")
                out = own if out is None else out.unionByName(own)
        return out


FAMILIES: dict[str, Family] = {}


def register(family: Family) -> None:
    """Adds a family; it takes part in grids, folds and pipelines by its name."""
    FAMILIES[family.name] = family


for _family in (FromSums("linear_least_squares", "Linear least squares", least_squares_of), FromSums("nearest_class_mean", "Nearest class mean", nearest_mean_of), SupportVectors(), Neighbors()):
    register(_family)


def judged(folds: Folds, settings: dict[str, list[dict]]) -> list[tuple[int, str, int, int, int]]:
    """(g, model, place, n, right) of every family, setting and group; linear models of all families are scored in one pass."""
    out, models = [], {}
    most = max((s["n_components"] for m, own in settings.items() if isinstance(FAMILIES[m], Linear) for s in own), default=0)
    if most:
        folds.spaces(most)
    for name, own in settings.items():
        family = FAMILIES[name]
        if isinstance(family, Linear):
            for g, fits in family.models(folds, own).items():
                models.setdefault(g, []).extend((name, i, m) for i, m in enumerate(fits))
        else:
            out += [(r.g, name, r.place, r.n, r.right) for r in family.judge(folds, own).collect()]
    if models:
        out += [(r.g, r.model, r.place, r.n, r.right) for r in scored(folds, models).collect()]
    return out


def family_names(wanted: Iterable[str] | None = None) -> list[str]:
    """The families asked for, each once, in the order asked for; all if none or 'all' is asked for."""
    names = [w.strip() for w in wanted or []]
    if not names or "all" in names:
        return list(FAMILIES)
    if unknown := sorted(set(names) - set(FAMILIES)):
        raise ValueError("unknown models: " + ", ".join(unknown))
    return list(dict.fromkeys(names))


class FamilyEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """A family with one setting as an estimator of Spark's library; rows need the column rowCol."""

    family = Param(Params._dummy(), "family", "name of a registered family", TypeConverters.toString)
    setting = Param(Params._dummy(), "setting", "its setting")
    classes = Param(Params._dummy(), "classes", "number of classes, from 0", TypeConverters.toInt)
    rowCol = Param(Params._dummy(), "rowCol", "column of row ids", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, family="nearest_class_mean", setting=None, classes=2, featuresCol="features", labelCol="label", predictionCol="prediction", rowCol="row_id"):
        super().__init__()
        self._setDefault(setting={}, rowCol="row_id")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FamilyModel:
        at = self.getOrDefault
        fitted = FAMILIES[at("family")].fit(dataset, at("setting"), at("classes"), at("rowCol"), at("labelCol"), at("featuresCol"))
        return self._copyValues(FamilyModel(fitted))


class FamilyModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """A fitted FamilyEstimator; `fitted` is the family's own model."""

    def __init__(self, fitted):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.fitted.transform(dataset, self.getOrDefault("featuresCol"))
        return out.withColumnRenamed("predicted", self.getOrDefault("predictionCol"))

