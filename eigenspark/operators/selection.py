"""Grids of settings, and their choice by a holdout or by nested folds.

All folds are judged together (`families.judged`): one pass adds up sums of every fold, from which the components and models
of all folds follow, a second one scores all settings of all folds, and neighbours of all folds come from one search.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, sampling
from .families import COMPONENTS, FAMILIES, NEIGHBORS, SVM_EPOCHS, SVM_RATES, SVM_REG, Folds, family_names, holdout_sums, judged, kfold_sums
from .linalg import Sums

#: Grids of the curves of bias and variance.
CURVE_COMPONENTS, CURVE_NEIGHBORS = (2, 5, 10, 20, 50, 100, 200), (1, 3, 5, 10, 20, 50)


def grid(names: Iterable[str] | None, most_components: int, components=COMPONENTS, ks=NEIGHBORS, regs=SVM_REG, epochs=SVM_EPOCHS, rates=SVM_RATES) -> dict[str, list[dict]]:
    """Settings of each family: feasible numbers of components by rising order, else the largest feasible one.

    Neighbours work on the features themselves, so their settings have k only.
    """
    sizes = sorted({int(c) for c in components if 1 <= int(c) <= most_components}) or [max(1, int(most_components))]
    return {name: FAMILIES[name].settings(sizes, ks=ks, regs=regs, epochs=epochs, rates=rates) for name in family_names(names)}


def restricted(settings: list[dict], most_components: int) -> list[dict]:
    """Settings with a feasible number of components; if there are none, each with the largest feasible one."""
    most = max(1, int(most_components))
    return [s for s in settings if s.get("n_components", 1) <= most] or [dict(t) for t in {tuple(sorted({**s, "n_components": most}.items())): None for s in settings}]


def feasible(settings: dict[str, list[dict]], most: int) -> dict[str, list[dict]]:
    return {m: restricted(s, most) if FAMILIES[m].on_components else s for m, s in settings.items()}


def shown(setting: dict) -> str:
    """A setting as text, by name."""
    return ", ".join(f"{k}={v}" for k, v in sorted(setting.items()))


def grid_frame(spark, settings: dict[str, list[dict]]) -> DataFrame:
    """model, place (from 0) and setting as text."""
    rows = [(m, i, shown(s)) for m, own in settings.items() for i, s in enumerate(own)]
    return spark.createDataFrame(rows, "model string, place int, setting string")


def nested_roles(base: DataFrame, nested: DataFrame, outer: int, inner: int, row_id: str = "row_id") -> DataFrame:
    """base (with _outer) once for each row, with the arrays _asks and _trains of the groups in which it is judged and trains.

    Groups: outer_fold * inner + inner_fold for the inner folds, and outer * inner + outer_fold for the outer ones.
    """
    cells = outer * inner
    folds = nested.groupBy(row_id).agg(F.collect_list(F.struct("outer_fold", "inner_fold")).alias("_f"))  # at most outer - 1 of each
    others = F.flatten(F.transform("_f", lambda f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(inner - 1)), lambda j: j != f.inner_fold), lambda j: f.outer_fold * inner + j)))
    asks = F.concat(F.transform("_f", lambda f: f.outer_fold * inner + f.inner_fold), F.array(F.col("_outer") + cells))
    trains = F.concat(others, F.transform("_f", lambda f: f.outer_fold + cells))
    return base.join(folds, row_id).withColumn("_asks", asks.cast("array<int>")).withColumn("_trains", trains.cast("array<int>")).drop("_f")


def nested_sums(outer: int, inner: int):
    """The training sums of the groups of `nested_roles`: an outer fold is trained by all others, an inner one by the others inside."""

    def run(judged_: dict[int, Sums]) -> dict[int, Sums]:
        cells = outer * inner
        around = kfold_sums({o: judged_[cells + o] for o in range(outer)})
        return {c: around[c // inner] - judged_[c] for c in range(cells)} | {cells + o: s for o, s in around.items()}

    return run


def tuned_on_holdout(df: DataFrame, settings: dict[str, list[dict]], classes: int, ratio: float = 0.2, seed: int = 42, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """model, setting, place, train_accuracy and validation_accuracy of every setting on one stratified holdout."""
    spark = df.sparkSession
    group = F.col("is_holdout").cast("int")
    trains = F.when(group == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = sampling.stratified_holdout(df, ratio, label, row_id, seed).withColumn("_asks", F.array(group)).withColumn("_trains", trains).persist()
    try:
        n, p = rows.where("not is_holdout").agg(F.count("*"), F.max(F.size(features))).first()
        settings = feasible(settings, min(n, p or 1))
        found = judged(Folds(rows, 2, classes, row_id=row_id, label=label, features=features, train_sums=holdout_sums), settings)
    finally:
        rows.unpersist()
    part = {(m, i, g): right / n for g, m, i, n, right in found}
    got = [(m, i, shown(s), part.get((m, i, 0)), part.get((m, i, 1))) for m, own in settings.items() for i, s in enumerate(own)]
    return spark.createDataFrame(got, "model string, place int, setting string, train_accuracy double, validation_accuracy double")


def nested_scores(df: DataFrame, settings: dict[str, list[dict]], classes: int, outer: int = 5, inner: int = 3, seed: int = 42, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """model, place, setting, outer_fold, inner_fold, n and correct of every setting in every inner fold, and in every outer one
    (inner_fold -1).

    All folds are fitted and judged together: a group for each outer and inner fold, and one for each outer fold.  What
    comes to the driver: sums of the folds, weights of the support vector machines, and a score of each setting and fold.
    """
    sampling.check_nested(df, outer, inner, label)
    spark, cells = df.sparkSession, outer * inner
    base = sampling.stratified_folds(df, outer, label, row_id, seed).withColumnRenamed("fold", "_outer").persist()
    nested = sampling.nested_folds(df.select(row_id, label), outer, inner, label, row_id, seed)
    roles = nested_roles(base, nested, outer, inner, row_id).persist()
    try:
        counts = {r.g: r.n for r in roles.select(F.explode("_trains").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}
        p = len((df.select(features).first() or [[]])[0])
        settings = feasible(settings, min(min(counts.values()), p))
        found = judged(Folds(roles, cells + outer, classes, row_id=row_id, label=label, features=features, train_sums=nested_sums(outer, inner)), settings)
    finally:
        roles.unpersist()
        base.unpersist()
    rows = [(m, i, shown(settings[m][i]), g // inner if g < cells else g - cells, g % inner if g < cells else -1, n, right) for g, m, i, n, right in found]
    return spark.createDataFrame(sorted(rows), "model string, place int, setting string, outer_fold int, inner_fold int, n long, correct long")


def chosen_by_inner(scores: DataFrame) -> DataFrame:
    """model, outer_fold, setting, inner_score and score from `nested_scores`: the setting with the best mean over the inner folds, the
    first of equals, and how it does outside."""
    inside = scores.where("inner_fold >= 0").groupBy("model", "outer_fold", "place", "setting").agg(F.avg(F.col("correct") / F.col("n")).alias("inner_score"))
    best = inside.groupBy("model", "outer_fold").agg(F.max_by(F.struct("place", "setting", "inner_score"), F.struct(F.round("inner_score", 12), -F.col("place"))).alias("b")).select("model", "outer_fold", "b.*")
    outside = scores.where("inner_fold = -1").select("model", "outer_fold", "place", (F.col("correct") / F.col("n")).alias("score"))
    return best.join(outside, ["model", "outer_fold", "place"]).select("model", "outer_fold", "setting", "inner_score", "score")


def nested_cv(df: DataFrame, settings: dict[str, list[dict]], classes: int, outer: int = 5, inner: int = 3, seed: int = 42, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """model, outer_fold, setting, inner_score and score: the setting chosen by inner folds, and how it does outside."""
    return chosen_by_inner(nested_scores(df, settings, classes, outer, inner, seed, row_id, label, features))


def kfold_scores(df: DataFrame, settings: dict[str, list[dict]], classes: int, folds: int, seed: int = 42, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """model, place, setting, fold and score of every setting on stratified folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    rows = sampling.stratified_folds(df, folds, label, row_id, seed).withColumn("_asks", F.array("fold")).withColumn("_trains", others).persist()
    try:
        found = judged(Folds(rows, folds, classes, row_id=row_id, label=label, features=features, train_sums=kfold_sums), settings)
    finally:
        rows.unpersist()
    got = sorted((m, i, shown(settings[m][i]), g, right / n) for g, m, i, n, right in found)
    return df.sparkSession.createDataFrame(got, "model string, place int, setting string, fold int, score double")


def nested_summary(results: DataFrame) -> DataFrame:
    """Of each model: folds, mean and deviation of outer scores, mean inner score, and the settings chosen with counts."""
    counts = metrics.setting_counts(results).withColumn("_c", F.format_string("%s (%d)", "setting", "n")).groupBy("model").agg(F.concat_ws("; ", F.sort_array(F.collect_list("_c"))).alias("settings"))
    return metrics.fold_summary(results).join(counts, "model")


def holdout_curve(tuned: DataFrame) -> DataFrame:
    """Errors of training and validation by setting, and the gap between them."""
    train, validation, gap = metrics.error_rates(F.col("train_accuracy"), F.col("validation_accuracy"))
    return tuned.select("model", "place", "setting", train, validation, gap)
