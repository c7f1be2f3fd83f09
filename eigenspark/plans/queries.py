"""The queries of the entry module: each operator on the supplied tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import classifiers, clustering, convolution, linalg, metrics, neighbors, sampling, selection, svm
from ..sources import sinks

SEED, RATIO, OUTER, INNER = 42, 0.2, 5, 3
CLASSES, DIMS, KS = 10, 64, (1, 3, 5, 7)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, features and label of the embeddings."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"), "label")


def _r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _long(df: DataFrame, array, *keys: str, to: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("pos", to)).withColumn(to, _r(to))


def _holdout(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = sampling.stratified_holdout(vectors(spark, d), RATIO, seed=SEED)
    return rows.where("not is_holdout").drop("is_holdout"), rows.where("is_holdout").drop("is_holdout")


def class_counts(spark, d):
    return metrics.class_counts(vectors(spark, d))


def dense_class_counts(spark, d):
    return metrics.dense_class_counts(vectors(spark, d), CLASSES + 2)


def class_count_range(spark, d):
    return metrics.class_count_range(vectors(spark, d))


def dataset_summary(spark, d):
    return metrics.dataset_summary(vectors(spark, d))


def label_encode(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    return sampling.encoded(docs, "source").select("doc_id", "source", "label")


def label_decode(spark, d):
    names = vectors(spark, d).select("label").distinct().withColumn("name", F.concat(F.lit("person_"), F.col("label")))
    return sampling.decoded(vectors(spark, d), names).select("row_id", "label", "name")


def path_parse(spark, d):
    from ..sources.images import parsed

    rows = vectors(spark, d).select("row_id", F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("x_"), "row_id", F.lit(".pgm"))).when(F.col("row_id") % 3 == 0, F.concat(F.lit("set/p"), "label", F.lit("_i"), "row_id", F.lit("(2).pgm"))).otherwise(F.concat(F.lit("p"), "label", F.lit("_i"), "row_id", F.lit(".pgm"))).alias("path"))
    return parsed(rows).select("row_id", "path", "person_id", "image_id")


def per_class_cap(spark, d):
    return sampling.per_class_cap(vectors(spark, d), 20, seed=SEED).select("row_id", "label")


def first_n_per_class(spark, d):
    return sampling.first_per_class(vectors(spark, d), 30, "row_id").select("row_id", "label")


def global_cap(spark, d):
    return sampling.global_cap(vectors(spark, d), 100, seed=SEED).select("row_id", "label")


def stratified_holdout(spark, d):
    return sampling.stratified_holdout(vectors(spark, d), RATIO, seed=SEED).select("row_id", "label", "is_holdout")


def stratified_kfold(spark, d):
    return sampling.stratified_folds(vectors(spark, d), OUTER, seed=SEED).select("row_id", "label", "fold")


def three_way_split(spark, d):
    return sampling.three_way_split(vectors(spark, d), 0.15, 0.15, seed=SEED).select("row_id", "label", "split")


def shuffle_split(spark, d):
    return sampling.shuffle_split(vectors(spark, d), 0.25, seed=SEED).select("row_id", "label", "is_train")


def event_holdout(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"))
    return sampling.stratified_holdout(events, RATIO, seed=SEED).select("row_id", "label", "is_holdout")


def complement_train(spark, d):
    rows = vectors(spark, d).select("row_id", "label")
    return sampling.complement(rows, sampling.stratified_folds(rows, OUTER, seed=SEED).where("fold = 0"))


def nested_fold_assignment(spark, d):
    return sampling.nested_folds(vectors(spark, d).select("row_id", "label"), OUTER, INNER, seed=SEED).select("row_id", "outer_fold", "inner_fold")


def cv_feasibility(spark, d):
    return sampling.nested_feasibility(vectors(spark, d), OUTER, INNER)


def zscore_vector(spark, d):
    return _long(vectors(spark, d), A.zscore(F.col("features")), "row_id")


def minmax_vector(spark, d):
    return _long(vectors(spark, d), A.minmax(F.col("features")), "row_id")


def symmetric_scale(spark, d):
    return _long(vectors(spark, d), A.symmetric(F.col("features")), "row_id")


def flat_resize(spark, d):
    return _long(vectors(spark, d), A.resize(A.doubles(F.col("features")), 8, 8, 5, 6), "row_id")


def unflatten_rows(spark, d):
    rows = vectors(spark, d).select("row_id", F.posexplode(A.unflatten(A.doubles(F.col("features")), 8, 8)).alias("line", "x"))
    return rows.select("row_id", "line", _r(A.total(F.col("x"))).alias("line_sum"))


def bar_crop(spark, d):
    return _long(vectors(spark, d), A.crop_bar(F.col("features"), 8, 8, 2), "row_id")


def mean_vector(spark, d):
    return linalg.mean_vector(vectors(spark, d)).select("pos", _r("mean").alias("mean"))


def column_variance_total(spark, d):
    return linalg.moments(vectors(spark, d)).agg(_r(F.sum("variance")).alias("total_variance"))


def sq_norms(spark, d):
    return vectors(spark, d).select("row_id", _r(A.squared_norm(F.col("features"))).alias("sq_norm"))


def global_mean_std(spark, d):
    return linalg.global_moments(vectors(spark, d)).select("n", _r("mean").alias("mean"), _r("deviation").alias("deviation"))


def standardised_vector(spark, d):
    m = linalg.global_moments(vectors(spark, d)).first()
    return _long(vectors(spark, d), A.standardise(F.col("features"), m["mean"], m["deviation"]), "row_id")


def gram_matrix(spark, d):
    return linalg.gram(vectors(spark, d)).select("i", "j", _r("value").alias("value"))


def covariance_matrix(spark, d):
    return linalg.covariance(vectors(spark, d)).select("i", "j", _r("value").alias("value"))


def ls_cross_term(spark, d):
    return linalg.class_sums(vectors(spark, d)).select("label", "pos", _r("total").alias("total"))


def variance_curve(spark, d):
    values = linalg.moments(vectors(spark, d)).select("pos", F.col("variance").alias("value"))
    out = linalg.variance_curve(values, 0.5)
    return out.select("pos", "place", _r("ratio").alias("ratio"), _r("cumulative").alias("cumulative"), "n_target")


def class_centroids(spark, d):
    return classifiers.centroids(vectors(spark, d), CLASSES + 1).select("label", "pos", "n", _r("mean").alias("mean"))


def _nearest_mean(spark, d) -> DataFrame:
    train, test = _holdout(spark, d)
    return classifiers.fit_nearest_mean(train, CLASSES).transform(test).select("row_id", "label", "predicted")


def nearest_mean_predict(spark, d):
    return _nearest_mean(spark, d)


def nearest_mean_confusion(spark, d):
    return metrics.confusion(_nearest_mean(spark, d), CLASSES)


def nearest_mean_accuracy(spark, d):
    return metrics.accuracy(_nearest_mean(spark, d)).select("n", _r("accuracy").alias("accuracy"))


def match_report(spark, d):
    return _nearest_mean(spark, d).select("row_id", "label", "predicted", F.when(F.col("label") == F.col("predicted"), "OK").otherwise("MISS").alias("match"))


def label_agreement(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet")
    return metrics.confusion(rows.select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")), 2)


def _neighbors(spark, d, k: int) -> DataFrame:
    train, test = _holdout(spark, d)
    return neighbors.neighbors(test, train, k)


def knn_neighbors(spark, d):
    return _neighbors(spark, d, 5).select("query_id", "neighbor_id", "neighbor_label", _r("distance").alias("distance"), "rank")


def knn_predict(spark, d):
    return neighbors.vote(_neighbors(spark, d, 5))


def knn_vote_share(spark, d):
    return neighbors.vote_shares(_neighbors(spark, d, 5)).select("query_id", "label", "votes", _r("share").alias("share"))


def knn_k_sweep(spark, d):
    train, test = _holdout(spark, d)
    votes = neighbors.sweep(neighbors.neighbors(test, train, max(KS)), list(KS)).join(test.select(F.col("row_id").alias("query_id"), "label"), "query_id")
    out = votes.groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("label")).cast("long")).alias("correct"))
    return out.select("k", "n", "correct", _r(1 - F.col("correct") / F.col("n")).alias("error"))


def nested_knn_scores(spark, d):
    """Rightly classified rows of every inner fold, and of every outer one (inner_fold -1), from one search of all folds."""
    found = selection.nested_scores(vectors(spark, d), selection.grid(["knn"], DIMS), CLASSES, OUTER, INNER, SEED)
    return found.select("setting", "outer_fold", "inner_fold", "n", "correct")


def hyperparam_grid(spark, d):
    return selection.grid_frame(spark, selection.grid(None, 300))


def _fold_scores(spark, d) -> DataFrame:
    """Scores of neighbours and of the nearest class mean in all directions, on five folds."""
    return selection.kfold_scores(vectors(spark, d), selection.grid(["knn", "nearest_class_mean"], DIMS, components=(DIMS,)), CLASSES, OUTER, SEED)


def best_setting(spark, d):
    return metrics.best_settings(_fold_scores(spark, d)).select("model", "best_setting", _r("best_score").alias("best_score"))


def _best_folds(spark, d) -> DataFrame:
    """The fold scores of each family's best setting; inner_score is the mean over its settings."""
    rows = _fold_scores(spark, d)
    best = metrics.best_settings(rows).select("model", F.col("best_setting").alias("setting"))
    inner = rows.groupBy("model", "fold").agg(F.avg("score").alias("inner_score"))
    return rows.join(F.broadcast(best), ["model", "setting"]).join(inner, ["model", "fold"])


def fold_score_summary(spark, d):
    return metrics.fold_summary(_best_folds(spark, d)).select("model", "n_folds", *[_r(c).alias(c) for c in ("mean_score", "std_score", "mean_inner_score")])


def best_family(spark, d):
    rows = metrics.fold_summary(_best_folds(spark, d)).withColumn("place", F.ascii("model"))
    return metrics.best_model(rows).select("model", _r("mean_score").alias("mean_score"))


def _clusters(spark, d) -> DataFrame:
    rows = vectors(spark, d)
    return clustering.kmeans(rows, 4, steps=3, tolerance=0.0, seed=SEED).transform(rows)


def kmeans_fixed_iters(spark, d):
    return _clusters(spark, d).select("row_id", "cluster")


def cluster_purity(spark, d):
    return metrics.purity(_clusters(spark, d)).select("n_clusters", _r("purity").alias("purity"))


def one_hot(spark, d):
    return vectors(spark, d).select("row_id", F.posexplode(A.one_hot(F.col("label"), CLASSES)).alias("pos", "value"))


def ovr_targets(spark, d):
    return vectors(spark, d).select("row_id", F.posexplode(A.one_versus_rest(F.col("label"), CLASSES)).alias("pos", "value"))


def bias_append(spark, d):
    x = A.with_bias(F.col("features"))
    return vectors(spark, d).select("row_id", F.size(x).alias("size"), _r(F.element_at(x, -1)).alias("last"), _r(A.total(x)).alias("total"))


def component_prefix(spark, d):
    return _long(vectors(spark, d), A.prefix(A.doubles(F.col("features")), 16), "row_id")


def softmax_scores(spark, d):
    """The classes' shares by the scores of the nearest-mean model."""
    train, test = _holdout(spark, d)
    s = A.softmax(F.col("scores"))
    out = classifiers.fit_nearest_mean(train, CLASSES).transform(test, keep_scores=True)
    return out.select("row_id", A.argmax(s).alias("predicted"), _r(F.array_max(s)).alias("confidence"))


def pca_project(spark, d):
    train, test = _holdout(spark, d)
    return _long(linalg.project(test, linalg.fit_components(train, 8)), F.col("projected"), "row_id")


def pca_explained_variance(spark, d):
    basis = linalg.fit_components(vectors(spark, d), DIMS)
    values = spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(basis.explained_variance)), "value": basis.explained_variance}))
    out = linalg.variance_curve(values)
    return out.select(F.col("pos").cast("int").alias("pos"), _r("value").alias("explained_variance"), _r("ratio").alias("ratio"), _r("cumulative").alias("cumulative"), "n_target")


def ls_predict(spark, d):
    train, test = _holdout(spark, d)
    return classifiers.fit_least_squares(train, CLASSES).transform(test).select("row_id", "label", "predicted")


def ls_normal_equations(spark, d):
    """Sums of the residuals of least squares, times each component and alone (pos -1), by class: all are zero."""
    train, _ = _holdout(spark, d)
    out = classifiers.fit_least_squares(train, CLASSES).transform(train, keep_scores=True)
    residual = F.zip_with(A.one_hot(F.col("label"), CLASSES), "scores", lambda t, s: t.cast("double") - s)
    rows = out.select("features", F.posexplode(residual).alias("label", "r"))
    rows = rows.select("label", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("features").cast("array<double>"))).alias("pos", "x"), "r")
    return rows.groupBy("label", (F.col("pos") - 1).alias("pos")).agg(_r(F.sum(F.col("x") * F.col("r")), 5).alias("residual"))


def pca_decorrelated(spark, d):
    """Sums of the products of every two components of the projected training rows, by the variance: zero or one."""
    train, _ = _holdout(spark, d)
    basis = linalg.fit_components(train, 8)
    g = linalg.gram(linalg.project(train, basis).select("projected"), "projected")
    n = train.count()
    values = F.array(*[F.lit(float(v)) for v in basis.explained_variance])
    scale = F.sqrt(F.get(values, F.col("i")) * F.get(values, F.col("j"))) * (n - 1)
    return g.select("i", "j", _r(F.col("value") / scale, 5).alias("value"))


def pca_total_variance(spark, d):
    """All components explain the sum of the components' own variances."""
    basis = linalg.fit_components(vectors(spark, d), DIMS)
    return spark.createDataFrame([(float(basis.explained_variance.sum()),)], "v double").select(_r("v").alias("total_variance"))


def _svm(spark, d) -> tuple[svm.Certified, DataFrame, DataFrame]:
    train, test = _holdout(spark, d)
    return svm.certified(train, CLASSES), train, test


def svm_predict(spark, d):
    found, _, test = _svm(spark, d)
    return found.model.transform(test).select("row_id", "label", "predicted")


def svm_optimality(spark, d):
    """Of each class: training rows; whether no weights can be better by over 1e-4, the duality gap; and whether the weights'
    objective, measured by row functions, is the one that the gap was computed with."""
    found, train, _ = _svm(spark, d)
    signs = A.one_versus_rest(F.col("label"), CLASSES)
    loss = F.zip_with(signs, "scores", lambda t, s: F.greatest(F.lit(0.0), 1 - t.cast("double") * s))
    rows = found.model.transform(train, keep_scores=True).select(F.posexplode(loss).alias("label", "loss"))
    penalty = F.array(*[F.lit(float(v)) for v in svm.REG / 2 * (found.model.weights**2).sum(1)])
    primal, dual = (F.array(*[F.lit(float(v)) for v in x]) for x in (found.primal, found.dual))
    out = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))
    same = F.abs(F.col("loss") + F.get(penalty, F.col("label")) - F.get(primal, F.col("label"))) < 1e-9
    return out.select("label", "n", (F.get(primal, F.col("label")) - F.get(dual, F.col("label"))).between(-1e-9, 1e-4).alias("certified"), same.alias("same"))


def perceptron_predict(spark, d):
    train, test = _holdout(spark, d)
    out = classifiers.fit_perceptron(train, CLASSES, (16,), 10).transform(test)
    return out.select("row_id", "label", "predicted", "confidence", F.when(F.col("label") == F.col("predicted"), "OK").otherwise("MISS").alias("match"))


def convnet_predict(spark, d):
    """The vectors as images of 8 x 8; the epoch is chosen by a part of the training rows."""
    train, test = _holdout(spark, d)
    split = sampling.stratified_holdout(train, RATIO, seed=SEED + 1)
    net = convolution.fit_convnet(split.where("not is_holdout"), split.where("is_holdout"), CLASSES, (8, 8), widths=(8,), epochs=3, batch=256)
    return net.transform(test).select("row_id", "label", "predicted", "confidence")


def _settings() -> dict:
    """The whole grids of all four families; of the default numbers of components those that the vectors have."""
    return selection.grid(["linear_least_squares", "nearest_class_mean", "svm", "knn"], DIMS)


def holdout_tuning(spark, d):
    return selection.tuned_on_holdout(vectors(spark, d), _settings(), CLASSES, RATIO, SEED)


def bias_variance_curve(spark, d):
    grids = selection.grid(["linear_least_squares", "knn"], DIMS, components=selection.CURVE_COMPONENTS, ks=selection.CURVE_NEIGHBORS)
    return selection.holdout_curve(selection.tuned_on_holdout(vectors(spark, d), grids, CLASSES, RATIO, SEED))


def nested_cv_report(spark, d):
    return selection.nested_cv(vectors(spark, d), _settings(), CLASSES, OUTER, INNER, SEED)


def submission(spark, d):
    rows = vectors(spark, d)
    near = neighbors.vote(neighbors.neighbors(rows, rows, 1)).withColumnRenamed("query_id", "row_id")
    named = rows.select("row_id", "label", F.concat(F.lit("p"), "label", F.lit("_i"), "row_id", F.lit(".pgm")).alias("path")).join(near, "row_id")
    names = rows.select("label").distinct().withColumn("name", F.concat(F.lit("person_"), "label"))
    return sinks.submission(named, names)


QUERIES = {
    f.__name__: f
    for f in (
        class_counts, dense_class_counts, class_count_range, dataset_summary, label_encode, label_decode, path_parse, per_class_cap, first_n_per_class, global_cap,
        stratified_holdout, stratified_kfold, three_way_split, shuffle_split, event_holdout, complement_train, nested_fold_assignment, cv_feasibility,
        zscore_vector, minmax_vector, symmetric_scale, flat_resize, unflatten_rows, bar_crop, mean_vector, column_variance_total, sq_norms, global_mean_std, standardised_vector,
        gram_matrix, covariance_matrix, ls_cross_term, variance_curve, class_centroids, nearest_mean_predict, nearest_mean_confusion, nearest_mean_accuracy, match_report, label_agreement,
        knn_neighbors, knn_predict, knn_vote_share, knn_k_sweep, nested_knn_scores, hyperparam_grid, best_setting, fold_score_summary, best_family, kmeans_fixed_iters, cluster_purity,
        one_hot, ovr_targets, bias_append, component_prefix, softmax_scores, pca_project, pca_explained_variance, ls_predict, ls_normal_equations, pca_decorrelated, pca_total_variance, svm_predict, svm_optimality, perceptron_predict, convnet_predict, holdout_tuning, bias_variance_curve, nested_cv_report, submission,
    )
}
