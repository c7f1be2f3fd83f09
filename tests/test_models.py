import hashlib
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from eigenspark.operators import classifiers, clustering, convolution, families, linalg, metrics, models, neighbors, sampling, selection, svm
from eigenspark.plans import parts


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, label int")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    y = np.repeat(np.arange(4), 30)
    x = rng.normal(size=(120, 8)) * 0.4 + 4 * np.eye(8)[y]
    return x, y, frame(spark, x, y).repartition(3).persist()


def test_components_like_svd(blobs):
    x, _, df = blobs
    basis = linalg.fit_components(df, 5)
    s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    assert np.allclose(basis.explained_variance, (s**2 / 119)[:5])
    assert np.allclose(np.abs(basis.components @ v[:5].T), np.eye(5), atol=1e-6)
    assert (basis.components[np.arange(5), np.abs(basis.components).argmax(1)] > 0).all()
    assert linalg.fit_components(df, 99).components.shape == (8, 8)
    z = {r.row_id: r.projected for r in linalg.project(df, basis).collect()}
    assert np.allclose([z[i] for i in range(120)], basis.project(x))


def test_moments_survive_an_offset(spark):
    x = np.random.default_rng(0).normal(size=(50, 3)) + 1e6
    m = {r.pos: r for r in linalg.moments(frame(spark, x, np.zeros(50)).repartition(4)).collect()}
    assert np.allclose([m[i]["mean"] for i in range(3)], x.mean(0)) and np.allclose([m[i].variance for i in range(3)], x.var(0), rtol=1e-3)


def test_least_squares_like_lstsq_even_without_full_rank(spark, blobs):
    x, y, _ = blobs
    x = np.column_stack([x, x[:, 0]])
    model = classifiers.fit_least_squares(frame(spark, x, y), 4)
    z = np.column_stack([x, np.ones(120)])
    want = np.linalg.lstsq(z, np.eye(4)[y], rcond=None)[0]
    assert np.allclose(model.scores(x), z @ want, atol=1e-6)
    assert np.allclose(np.vstack([model.weights.T, model.bias]), want, atol=1e-5)


def test_sums_of_projected_rows(blobs):
    x, y, df = blobs
    sums = linalg.grouped_sums(df, 1, 4)[0]
    basis = linalg.components_of(sums, 3)
    z, p = basis.project(x), linalg.projected_sums(sums, basis)
    assert np.allclose(p.products, z.T @ z) and np.allclose(p.total, z.sum(0), atol=1e-8) and np.allclose(p.per_class, np.eye(4)[y].T @ z)


def test_nearest_mean_with_an_empty_class(spark):
    df = frame(spark, [[4, 4], [5, 5], [9, 9]], [0, 0, 2])
    model = classifiers.fit_nearest_mean(df, 3)
    got = model.transform(frame(spark, [[0.1, 0], [4, 4], [9, 8]], [0, 0, 0])).orderBy("row_id").collect()
    assert [r.predicted for r in got] == [1, 0, 2]
    rows = {(r.label, r.pos): (r.n, r["mean"]) for r in classifiers.centroids(df, 3).collect()}
    assert rows[1, 0] == (0, 0.0) and rows[0, 1] == (2, 4.5)


def test_neighbours_ties_and_cells(spark, blobs, monkeypatch):
    train = frame(spark, [[1, 0], [-1, 0], [0, 1], [0, 1]], [3, 2, 1, 1])
    query = spark.createDataFrame([(10, [0.0, 0.0], 0)], "row_id long, features array<double>, label int")
    near = neighbors.neighbors(query, train, 2).orderBy("rank").collect()
    assert [r.neighbor_id for r in near] == [0, 1]
    assert neighbors.vote(neighbors.neighbors(query, train, 2)).first().predicted == 2
    assert neighbors.vote(neighbors.neighbors(query, train, 99)).first().predicted == 1
    x, y, df = blobs
    monkeypatch.setattr(neighbors, "TRAIN_CELL", 25)
    monkeypatch.setattr(neighbors, "QUERY_CELL", 40)
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in neighbors.neighbors(df, df, 4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(120):
        assert [got[i, k] for k in (1, 2, 3, 4)] == list(np.lexsort((np.arange(120), d[i]))[:4])


def plain_neighbours(x, ids, allowed, i, k):
    d = ((x - x[i]) ** 2).sum(1)
    own = [j for j in np.lexsort((ids, d)) if allowed[j]]
    return [int(ids[j]) for j in own[:k]]


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 rows around 40 places, some repeated, with ids that no double holds."""
    rng = np.random.default_rng(21)
    x = np.repeat(rng.normal(size=(40, 8)) * 9, 75, 0) + rng.normal(size=(3000, 8)) * 0.3
    x[100:160] = x[100]
    ids = rng.permutation(3000) + (1 << 60)
    return x, ids, spark.createDataFrame([(int(i), v.tolist(), int(i) % 7) for i, v in zip(ids, x, strict=True)], "row_id long, features array<double>, label int").repartition(4).persist()


@pytest.mark.parametrize("sizes", [{"LEAF": 100}, {"LEAF": 20, "TRAIN_CELL": 30, "QUERY_CELL": 16, "STEP": 5}, {"LEAF": 3, "LEAVES": 500, "SAMPLE": 300}])
def test_metric_cells_are_exact(clustered, monkeypatch, sizes):
    x, ids, df = clustered
    for name, value in sizes.items():
        monkeypatch.setattr(neighbors, name, value)
    some = df.where("row_id % 9 = 0")
    got = {}
    for r in neighbors.neighbors(some, df, 6).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    assert got == {int(i): plain_neighbours(x, ids, np.ones(3000, bool), n, 6) for n, i in enumerate(ids) if i % 9 == 0}
    found = neighbors.measured(some, df, 6).first()
    assert found.pairs == some.count() * 3000 and found.computed < 0.2 * found.pairs


def test_a_query_is_sent_once_to_a_cell(spark, monkeypatch):
    """Where bounds save nothing, leaves share cells, and neither side is copied for each of them; 400 equal rows are told apart by id."""
    rng = np.random.default_rng(27)
    x, ids = rng.normal(size=(1500, 12)), rng.permutation(1500)
    x[:400] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist(), int(i) % 3) for i, v in zip(ids, x, strict=True)], "row_id long, features array<double>, label int").repartition(4).persist()
    monkeypatch.setattr(neighbors, "LEAF", 30)
    sent, search = [], neighbors._searched

    def counted(queries, train, *rest):
        sent.append(queries.count() + train.count())
        return search(queries, train, *rest)

    monkeypatch.setattr(neighbors, "_searched", counted)
    some = df.where("row_id % 2 = 0")
    got = {}
    for r in neighbors.neighbors(some, df, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    assert got == {int(i): plain_neighbours(x, ids, np.ones(1500, bool), n, 5) for n, i in enumerate(ids) if i % 2 == 0}
    assert sum(sent) <= 2 * (1500 + 750)


def test_cells_hold_few_rows_and_bytes():
    first, parts = neighbors.dealt(np.array([3, 4, 20, 1, 0, 9, 2]), 8)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 7] and parts.tolist() == [1, 1, 3, 1, 1, 2, 1]
    assert neighbors.rows_of(64, 10**6) * 64 * 8 <= neighbors.CELL_BYTES and neighbors.rows_of(10**9, 5) == 1


def test_metric_cells_of_few_rows(clustered, spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF", 1)
    df = clustered[2].limit(5)
    assert neighbors.neighbors(df, df, 9).count() == 25 and neighbors.neighbors(df, df.limit(0), 3).count() == 0 and neighbors.neighbors(df.limit(0), df, 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(30)], "row_id long, features array<double>, label int")
    assert {r.neighbor_id for r in neighbors.neighbors(same, same, 2).collect()} == {0, 1}


@pytest.mark.parametrize("leaf", [50, 10_000])
def test_masked_neighbours_are_those_of_each_group(clustered, monkeypatch, leaf):
    """Groups from 3 rows to all, and rows that are asked for in several."""
    monkeypatch.setattr(neighbors, "LEAF", leaf)
    x, ids, df = clustered
    holds = [((i % 3 != 0) << 0) | ((i % 1000 == 7) << 1) | (1 << 5) | ((i % 5 == 1) << 61) for i in ids.tolist()]
    asks = [((i % 40 == 0) << 0) | ((i % 60 == 0) << 1) | ((i % 80 == 0) << 5) | ((i % 120 == 0) << 61) for i in ids.tolist()]
    bit = lambda c, g: f"shiftleft(cast({c} as long), {g})"
    expr = lambda parts: F.expr(" + ".join(bit(c, g) for c, g in parts))
    rows = df.withColumn("holds", expr([("row_id % 3 <> 0", 0), ("row_id % 1000 = 7", 1), ("true", 5), ("row_id % 5 = 1", 61)]))
    rows = rows.withColumn("asks", expr([("row_id % 40 = 0", 0), ("row_id % 60 = 0", 1), ("row_id % 80 = 0", 5), ("row_id % 120 = 0", 61)]))
    got = {}
    for r in neighbors.masked_neighbors(rows, 5, "asks", "holds").orderBy("rank").collect():
        got.setdefault((r.g, r.query_id), []).append(r.neighbor_id)
    want = {}
    for g in (0, 1, 5, 61):
        allowed = np.array([h >> g & 1 for h in holds], bool)
        want |= {(g, int(i)): plain_neighbours(x, ids, allowed, n, 5) for n, i in enumerate(ids) if asks[n] >> g & 1}
    assert got == want


def test_one_search_serves_all_folds(blobs, monkeypatch):
    """As many right answers in every inner and outer fold as from a search fold by fold; each distance is computed once."""
    df = blobs[2]
    base = sampling.stratified_folds(df, 3).withColumnRenamed("fold", "_outer")
    nested = sampling.nested_folds(df, 3, 2)
    roles = selection.nested_roles(base, nested, 3, 2).persist()
    assert roles.count() == 120
    want = {}
    for g in range(9):
        own, train = (nested.where(f"outer_fold = {g // 2} and inner_fold {op} {g % 2}") if g < 6 else base.where(f"_outer {op} {g - 6}") for op in ("=", "<>"))
        for place, k in enumerate((1, 4)):
            said = neighbors.vote(neighbors.neighbors(own, train, k)).join(own.select(F.col("row_id").alias("query_id"), "label"), "query_id")
            want[g, place] = (own.count(), said.where("predicted = label").count())
    for groups in (neighbors.GROUPS, 4):  # all groups at once, or in three searches
        monkeypatch.setattr(neighbors, "GROUPS", groups)
        found = families.FAMILIES["knn"].judge(families.Folds(roles, 9, 4), [{"k": 1}, {"k": 4}])
        assert {(r.g, r.place): (r.n, r.right) for r in found.collect()} == want
    monkeypatch.undo()
    masked = roles.select("row_id", "features", "label", families.group_mask(F.col("_asks"), 0).alias("a"), families.group_mask(F.col("_trains"), 0).alias("t"))
    search = neighbors._search(masked, masked, 3, "row_id", "label", "features", None, F.col("a"), F.col("t"))
    assert search.found.agg(F.sum("looked")).first()[0] == 120 * 120


def test_sums_of_folds(blobs):
    """The training sums of nested folds, made from those over judged rows, are those over the training rows."""
    df = blobs[2]
    base = sampling.stratified_folds(df, 3).withColumnRenamed("fold", "_outer")
    roles = selection.nested_roles(base, sampling.nested_folds(df, 3, 2), 3, 2).persist()
    one, two = (families.Folds(roles, 9, 4, train_sums=s).spaces(3) for s in (selection.nested_sums(3, 2), None))
    for g in range(9):
        (a, z), (b, y) = one[g], two[g]
        assert np.allclose(a.components, b.components, atol=1e-7) and np.allclose(z.products, y.products, atol=1e-6) and z.counts.tolist() == y.counts.tolist() and z.n == y.n


class Majority(families.Family):
    """The commonest label of a bin of the first component, counted by Spark: no sums of vectors."""

    name, title = "bins", "Bins of the first feature"

    def settings(self, sizes, **grids):
        return [{"width": w} for w in (0.5, 4.0)]

    def fit(self, rows, setting, classes, row_id="row_id", label="label", features="features"):
        return BinModel(rows.groupBy(F.floor(F.col(features)[0] / setting["width"]).alias("_bin")).agg(F.mode(label, True).alias("predicted")), setting["width"])

    def judge(self, folds, settings):
        out = None
        for g in range(folds.groups):
            for i, s in enumerate(settings):
                said = self.fit(folds.rows.where(F.array_contains(folds.trains, g)), s, folds.classes).transform(folds.rows.where(F.array_contains(folds.asks, g)))
                own = said.agg(F.count("*").alias("n"), F.sum((F.coalesce("predicted", F.lit(-1)) == F.col("label")).cast("long")).alias("right")).select(F.lit(g).alias("g"), F.lit(i).alias("place"), "n", "right")
                out = own if out is None else out.unionByName(own)
        return out


class BinModel:
    def __init__(self, table, width):
        self.table, self.width = table, width

    def transform(self, df, features="features"):
        return df.withColumn("_bin", F.floor(F.col(features)[0] / self.width)).join(self.table, "_bin", "left").drop("_bin")


def test_families_of_other_kinds(blobs):
    """A fifth and a sixth family, neither made from sums: one of its own, and one of Spark's estimators."""
    df = blobs[2]
    families.register(Majority())
    families.register(families.Estimated("forest", "Random forest", lambda trees: RandomForestClassifier(numTrees=trees, seed=1), [{"trees": 3}]))
    try:
        settings = selection.grid(["bins", "forest", "nearest_class_mean"], 8, components=(4,))
        out = selection.nested_cv(df, settings, 4, outer=2, inner=2).collect()
        assert {r.model for r in out} == set(settings) and len(out) == 6 and all(r.score > 0.9 for r in out if r.model != "bins")
        assert all(r.setting == "width=0.5" or r.setting == "width=4.0" for r in out if r.model == "bins")
        chosen = parts.nested_selection(df, 4, ["forest", "bins"], 2, 2)
        assert chosen.family == "forest" and metrics.accuracy(chosen.model.transform(df)).first().accuracy > 0.9
        assert selection.tuned_on_holdout(df, settings, 4).count() == 4
    finally:
        del families.FAMILIES["bins"], families.FAMILIES["forest"]


def test_families_as_estimators(blobs):
    df = blobs[2]
    for name, setting in (("linear_least_squares", {"n_components": 5}), ("svm", {"n_components": 5, "reg_strength": 1e-3, "epochs": 9, "learning_rate": 0.1}), ("knn", {"k": 3})):
        estimator = families.FamilyEstimator(family=name, setting=setting, classes=4, predictionCol="said")
        model = Pipeline(stages=[estimator]).fit(df)
        out = model.transform(df)
        assert out.where("said = label").count() > 110 and set(out.columns) == {*df.columns, "said"}
        assert estimator.copy({estimator.family: "nearest_class_mean"}).getOrDefault("family") == "nearest_class_mean"


def test_svm_and_kmeans_find_blobs(blobs):
    x, y, df = blobs
    assert metrics.accuracy(svm.fit_svm(df, 4, epochs=20).transform(df)).first().accuracy > 0.95
    clusters = clustering.kmeans(df, 4, seed=1)
    assert 0.25 <= metrics.purity(clusters.transform(df)).first().purity <= 1
    with pytest.raises(ValueError):
        clustering.kmeans(df, 121)


def plain_svm(x, y, classes, reg, epochs, rate, order):
    """One class against the rest by steps of 256 rows with momentum, a row of weights at a time."""
    w, v = np.zeros((classes, x.shape[1] + 1)), np.zeros((classes, x.shape[1] + 1))
    for epoch in range(epochs):
        i = order(epoch)
        for a in range(0, len(x), 256):
            some = i[a : a + 256]
            for c in range(classes):
                g = np.zeros(x.shape[1] + 1)
                for r in some:
                    s = 1.0 if y[r] == c else -1.0
                    if s * (x[r] @ w[c, :-1] + w[c, -1]) < 1:
                        g -= s * np.append(x[r], 1.0) / len(some)
                g[:-1] += reg * w[c, :-1]
                v[c] = 0.9 * v[c] - rate / (1 + 0.1 * epoch) * g
                w[c] += v[c]
    return w


def keyed_order(ids, seed=42):
    return sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[i]}:{seed}".encode()).hexdigest())


def test_svm_is_the_plain_descent_in_one_part(spark, blobs):
    x, y, _ = blobs
    x, y = np.tile(x, (3, 1))[:300], np.tile(y, 3)[:300]
    model = svm.fit_svm(frame(spark, x, y).repartition(5), 4, reg=1e-2, epochs=3, rate=0.1)
    own = keyed_order(range(300))
    want = plain_svm(x[own], y[own], 4, 1e-2, 3, 0.1, lambda epoch: np.random.default_rng([42, epoch, 0]).permutation(300))
    assert np.allclose(np.column_stack([model.weights, model.bias]), want)


@pytest.mark.parametrize("rows", [4096, 70])
def test_svms_do_not_depend_on_order_or_partitions(spark, monkeypatch, rows):
    """To the last bit, in one part and in several."""
    monkeypatch.setattr(svm, "PART_ROWS", rows)
    rng = np.random.default_rng(22)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 3, 400)
    df = frame(spark, x, y)
    layouts = df.coalesce(1), df.orderBy(F.desc("row_id")).coalesce(1), df.repartition(8)
    for fit in (lambda d: svm.fit_svm(d, 3, epochs=3), lambda d: svm.certified(d, 3, rounds=3).model):
        one, *others = map(fit, layouts)
        assert all((one.weights == o.weights).all() and (one.bias == o.bias).all() for o in others) and np.abs(one.weights).max() > 0


def plain_objective(w, b, x, y, reg, classes):
    sign = np.where(y == np.arange(classes)[:, None], 1.0, -1.0)
    return np.maximum(0, 1 - sign * (w @ x.T + b[:, None])).mean(1) + reg / 2 * (w**2).sum(1)


@pytest.mark.parametrize(("rows", "parts", "reg", "tolerance"), [(120, 1, 1e-1, 1e-4), (120, 1, 1e-3, 1e-3), (1200, 4, 1e-1, 3e-3)])
def test_certified_svm(spark, monkeypatch, rows, parts, reg, tolerance):
    """The gap is true: no other weights, found by a long plain descent, are better than the dual value."""
    rng = np.random.default_rng(23)
    y = rng.integers(0, 4, rows)
    x = rng.normal(size=(rows, 6)) + 1.5 * np.eye(6)[y]  # overlapping
    monkeypatch.setattr(svm, "PART_ROWS", -(-rows // parts))
    found = svm.certified(frame(spark, x, y), 4, reg=reg, tolerance=tolerance)
    assert found.converged and (found.gaps <= tolerance).all() and (found.gaps >= -1e-9).all()
    assert np.allclose(plain_objective(found.model.weights, found.model.bias, x, y, reg, 4), found.primal)
    w, b = found.model.weights.copy(), found.model.bias.copy()
    for step in range(1, 4000):
        sign = np.where(y == np.arange(4)[:, None], 1.0, -1.0)
        active = sign * (sign * (w @ x.T + b[:, None]) < 1) / len(x)
        w, b = w - 0.3 / step**0.7 * (reg * w - active @ x), b + 0.3 / step**0.7 * active.sum(1)
        if step % 50 == 0:
            assert (plain_objective(w, b, x, y, reg, 4) >= found.dual - 1e-9).all()


def test_certified_svm_of_odd_classes(spark):
    """An empty class has hardly any weights and a bias near -1; classes that lines tell apart are told apart."""
    rng = np.random.default_rng(24)
    y = rng.integers(0, 2, 90)
    found = svm.certified(frame(spark, rng.normal(size=(90, 3)) * 0.1 + np.eye(3)[y], y), 3, reg=1e-3)
    # within the distance that the gap allows
    assert found.converged and (found.model.weights[2] ** 2).sum() <= 2 * found.gaps[2] / 1e-3 and found.model.bias[2] == pytest.approx(-1, abs=0.5)
    df = frame(spark, rng.normal(size=(90, 3)) * 0.1 + np.eye(3)[y], y)
    assert metrics.accuracy(found.model.transform(df)).first().accuracy == 1
    with pytest.raises(ValueError):
        svm.certified(df.limit(0), 3)
    few = svm.certified(df, 3, reg=1e-5, tolerance=1e-12, rounds=2)
    assert not few.converged and few.rounds == 2 and (few.gaps >= -1e-9).all()


def test_svms_of_several_sets_and_settings(blobs):
    _, _, df = blobs
    rows = df.withColumn("_trains", F.when(F.col("row_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    settings = [{"n_components": c, "reg_strength": 1e-3, "epochs": e, "learning_rate": 0.1} for c in (2, 6) for e in (2, 9)]
    bases = {g: linalg.fit_components(df, 6) for g in (0, 1)}
    found = svm.fit_svms(rows, settings, 4, bases, "_trains")
    assert set(found) == {(g, i) for g in (0, 1) for i in range(4)} and found[0, 2].weights.shape == (4, 6)
    alone = svm.fit_svms(rows.where("row_id % 2 = 0"), settings[3:], 4, {0: bases[0]}, "_trains")
    assert metrics.accuracy(alone[0, 0].transform(df)).first().accuracy > 0.95 and metrics.accuracy(found[0, 3].transform(df)).first().accuracy > 0.95


def same_as_svd(basis, x, k, accuracy=1e-8):
    s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    want = (s**2 / (len(x) - 1))[:k]
    assert np.allclose(basis.mean, x.mean(0)) and np.allclose(basis.explained_variance, want, rtol=0, atol=accuracy * want[0])
    told = want > 1e-6 * want[0]
    assert np.allclose(np.abs((basis.components * v[:k])[told].sum(1)), 1, atol=1e-7)
    assert np.allclose(basis.components @ basis.components.T, np.eye(k), atol=1e-10)


@pytest.mark.parametrize(("n", "p", "k"), [(60, 300, 6), (40, 50, 40), (30, 20, 20), (5, 40, 5)])
def test_lanczos_like_svd(spark, monkeypatch, n, p, k):
    x = np.random.default_rng(8).normal(size=(n, p)) @ np.diag(np.linspace(3, 0.1, p))
    df = frame(spark, x, np.zeros(n)).repartition(3)
    for block in (128, 3):
        monkeypatch.setattr(linalg, "BLOCK", block)
        same_as_svd(linalg.lanczos(df, k)[0], x, k)


def test_lanczos_at_image_size(spark):
    """4,096 features, to 1e-8 of the decomposition of all rows; through fit_components."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 30)) @ rng.normal(size=(30, 4096)) + rng.normal(size=(150, 4096)) * 0.3
    df = frame(spark, x, np.zeros(150)).repartition(3)
    same_as_svd(linalg.fit_components(df, 12), x, 12)


def test_lanczos_finds_equal_values_and_empty_space(spark, monkeypatch):
    """More equal variances than a block is wide, and more components than rows span."""
    monkeypatch.setattr(linalg, "BLOCK", 2)
    x = np.vstack([np.eye(7, 12) * 3, -np.eye(7, 12) * 3])
    basis = linalg.lanczos(frame(spark, x, np.zeros(14)), 9)[0]
    assert np.allclose(basis.explained_variance, [18 / 13] * 7 + [0] * 2) and np.allclose(basis.components @ basis.components.T, np.eye(9))
    flat = linalg.lanczos(frame(spark, np.ones((4, 6)), np.zeros(4)), 3)[0]
    assert np.allclose(flat.explained_variance, 0) and flat.components.shape == (3, 6)


def test_lanczos_of_sets_and_its_error(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BASES_BYTES", 1)
    x = np.random.default_rng(11).normal(size=(90, 40))
    df = frame(spark, x, np.arange(90) % 3).withColumn("sets", F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda g: g != F.col("label")))
    found = linalg.lanczos(df, 4, trains="sets", sets=[0, 1, 2])
    for g in range(3):
        same_as_svd(found[g], x[np.arange(90) % 3 != g], 4)
    z = linalg.basis_sums(df, found, 3, trains="sets")
    own = x[np.arange(90) % 3 != 1]
    assert np.allclose(z[1].products, found[1].project(own).T @ found[1].project(own)) and z[1].counts.tolist() == [30, 0, 30]
    monkeypatch.setattr(linalg, "BLOCK", 4)
    with pytest.raises(ArithmeticError):
        linalg.lanczos(df, 4, passes=1)
    with pytest.raises(ValueError):
        linalg.lanczos(df, 4, trains="sets", sets=[7])


def test_wide_folds_are_exact(spark, blobs, monkeypatch):
    """Each fold's own components, above and below the number of features from which they are found otherwise."""
    _, _, df = blobs
    settings = selection.grid(None, 8, components=(2, 5), ks=(1,), regs=(1e-3,), epochs=(3,), rates=(0.1,))
    narrow = [sorted(map(tuple, f(df, settings, 4).collect())) for f in (selection.tuned_on_holdout, lambda *a: selection.nested_cv(*a, outer=2, inner=2))]
    monkeypatch.setattr(linalg, "WIDE", 5)
    assert narrow == [sorted(map(tuple, f(df, settings, 4).collect())) for f in (selection.tuned_on_holdout, lambda *a: selection.nested_cv(*a, outer=2, inner=2))]


def test_all_families_at_image_size(spark):
    """4,096 features: nothing of their square comes to the driver."""
    rng = np.random.default_rng(9)
    y = np.repeat(np.arange(3), 16)
    x = rng.normal(size=(48, 4096)) + 3 * np.eye(3)[y].repeat(20, 1) @ rng.normal(size=(60, 4096)) / 8
    df = frame(spark, x, y).repartition(3).persist()
    settings = selection.grid(None, 48, components=(2, 8), ks=(1, 3), regs=(1e-3,), epochs=(3,), rates=(0.1,))
    out = selection.nested_cv(df, settings, 3, outer=2, inner=2).collect()
    assert {r.model for r in out} == set(families.FAMILIES) and len(out) == 8 and all(r.score > 0.6 for r in out)


def test_components_are_kept_by_contents(spark, tmp_path):
    """A rewritten table has other components; the same rows in another layout have the same."""
    store, rng = models.ModelStore(spark, str(tmp_path / "models")), np.random.default_rng(12)
    path = str(tmp_path / "rows")
    for scale in (1, 5):
        x = rng.normal(size=(50, 6)) * scale
        frame(spark, x, np.zeros(50)).write.mode("overwrite").parquet(path)
        same_as_svd(linalg.fit_components(spark.read.parquet(path), 3, store=store), x, 3)
        again = linalg.fit_components(spark.read.parquet(path).repartition(7).orderBy("row_id"), 3, store=store)
        same_as_svd(again, x, 3)
    assert sorted(store.versions("components")) == [1, 2] and store.load("components", 9) is None and store.load("nothing") is None
    kept = models.ModelStore(spark, str(tmp_path / "models")).load("components")
    assert kept.version == 2 and (kept.arrays["components"] == again.components).all() and kept.info == {"k": 3}
    assert models.content_digest(spark.read.parquet(path), ["features"]) != models.content_digest(spark.read.parquet(path).limit(49), ["features"])


def test_perceptron_finds_blobs(blobs):
    out = classifiers.fit_perceptron(blobs[2], 4, (8,), 60).transform(blobs[2])
    assert metrics.accuracy(out).first().accuracy > 0.95 and out.where("confidence < 0.25 or confidence > 1").count() == 0
    assert out.columns == ["row_id", "features", "label", "predicted", "confidence"]


def plain_lloyd(x, ids, k, steps, tolerance, seed=42):
    """Clusters by distances of all rows to all centres in each step, and the steps taken."""
    own = keyed_order(ids, seed)
    centres, spare = x[own[:k]], list(x[own[k : 2 * k]])
    for step in range(1, steps + 1):
        said = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[said == c].mean(0) if (said == c).any() else (spare.pop(0) if spare else centres[c]) for c in range(k)])
        moved, centres = np.sqrt(((new - centres) ** 2).sum()), new
        if moved < tolerance:
            break
    return said, step


@pytest.mark.parametrize(("k", "rows"), [(5, 4096), (12, 200), (1, 4096)])
def test_kmeans_with_bounds_is_lloyd(clustered, monkeypatch, k, rows):
    """The same clusters as by measuring everything, with fewer distances, past a checkpoint."""
    monkeypatch.setattr(svm, "PART_ROWS", rows)
    monkeypatch.setattr(clustering, "KEEP", 3)
    x, ids, df = clustered
    want, steps = plain_lloyd(x, ids, k, 30, 1e-4)
    found = clustering.kmeans(df, k)
    assert found.steps == steps
    said = {r.row_id: r.cluster for r in found.transform(df).collect()}
    assert [said[int(i)] for i in ids] == want.tolist()
    assert found.computed <= len(x) * k * steps and (steps < 4 or k < 5 or found.computed < 0.85 * len(x) * k * steps)
    again = clustering.kmeans(df.orderBy(F.desc("row_id")).coalesce(1), k)
    assert (again.centres == found.centres).all()


def test_kmeans_reads_its_source_twice(spark, clustered):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = clustered[2]
    clustering.kmeans(df.mapInPandas(run, df.schema), 4, steps=6, tolerance=0.0)
    assert seen.value <= 5 * 3000  # the first centres (a count, a histogram, a choice), the size of parts, the parts


def test_kmeans_refills_an_empty_cluster(spark):
    df = frame(spark, [[0, 0]] * 5 + [[9, 9]], [0] * 6)
    found = clustering.kmeans(df, 2, steps=5)
    assert found.centres.shape == (2, 2) and found.transform(df).count() == 6


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 2)], "label int, predicted int")
    assert metrics.accuracy(df).first().accuracy == 0.75
    assert np.isnan(metrics.accuracy(df.limit(0)).first().accuracy)
    assert metrics.confusion(df, 3).count() == 9 and metrics.confusion(df, 3).agg(F.sum("n")).first()[0] == 4
    scores = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.5, 0.6), ("b", 0.7, 0.6)], "model string, score double, inner_score double")
    rows = {r.model: r for r in metrics.fold_summary(scores).collect()}
    assert rows["a"].std_score == 0 and rows["b"].std_score == pytest.approx(np.std([0.5, 0.7], ddof=1))
    history = spark.createDataFrame([(1, 0.9, 0.3), (2, 0.9, 0.2), (3, 0.8, 0.1)], "epoch int, accuracy double, loss double")
    assert metrics.best_epoch(history).first().epoch == 2
    long = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.7, 0.5), (3, 0.7, 0.6), (4, 0.6, 0.4), (5, 0.9, 0.1)], "epoch int, accuracy double, loss double")
    assert [metrics.best_epoch(long, p).first().epoch for p in (None, 3, 2, 1)] == [5, 5, 2, 2]
    batches = spark.createDataFrame([(0.5, 3, 4), (0.1, 6, 6)], "loss double, right int, n int")
    got = metrics.weighted_scores(batches).first()
    assert got.loss == pytest.approx((0.5 * 4 + 0.1 * 6) / 10) and got.accuracy == pytest.approx(0.9)


def test_grids():
    assert families.family_names(None) == list(families.FAMILIES) == families.family_names(["svm", "all"])
    assert families.family_names([" knn", "svm", "knn"]) == ["knn", "svm"]
    with pytest.raises(ValueError):
        families.family_names(["tree"])
    g = selection.grid(None, 363)
    assert len(g["svm"]) == 48 and g["knn"] == [{"k": 1}, {"k": 3}, {"k": 5}] and len(g["linear_least_squares"]) == 4
    assert selection.grid(["svm"], 7)["svm"][0]["n_components"] == 7
    assert selection.restricted([{"n_components": 50}], 9) == [{"n_components": 9}]
    assert selection.shown({"n_components": 5, "k": 1}) == "k=1, n_components=5"


def test_nested_choice_of_all_families(blobs):
    _, _, df = blobs
    settings = selection.grid(None, 8, components=(2, 4), ks=(1, 3), regs=(1e-3,), epochs=(5,), rates=(0.1,))
    out = selection.nested_cv(df, settings, 4, outer=2, inner=2)
    rows = out.collect()
    assert len(rows) == 8 and all(r.score > 0.8 for r in rows if "n_components=2" not in r.setting)
    assert {r.model: r.n_folds for r in selection.nested_summary(out).collect()} == dict.fromkeys(settings, 2)
    tuned = selection.tuned_on_holdout(df, settings, 4)
    assert tuned.count() == 8 and selection.holdout_curve(tuned).where("gap < 0").count() == 0


def test_grouped_neighbours(blobs):
    x, _, df = blobs
    parts = df.withColumn("part", (F.col("row_id") % 3).cast("int"))
    near = neighbors.neighbors(parts, parts, 2, group="part").collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2) + 1e9 * (np.arange(120)[:, None] % 3 != np.arange(120)[None] % 3)
    far = neighbors.neighbors(parts.withColumn("part", F.col("part") * 50), parts.withColumn("part", F.col("part") * 50), 2, group="part")
    assert sorted((r.query_id, r["rank"], r.part, r.neighbor_id) for r in far.collect()) == sorted((r.query_id, r["rank"], 50 * r.part, r.neighbor_id) for r in near)
    got = {(r.query_id, r["rank"]): (r.part, r.neighbor_id) for r in near}
    assert got == {(i, k + 1): (i % 3, int(np.lexsort((np.arange(120), d[i]))[k])) for i in range(120) for k in (0, 1)}


def test_gradients_of_the_network():
    """Against differences, with odd sizes and equal pixels left out by chance."""
    rng = np.random.default_rng(40)
    params = convolution.initial(11, 9, 3, (3, 4), 2, 1)
    params = [p + rng.normal(size=p.shape) * 0.05 for p in params]
    x, y = rng.normal(size=(5, 1, 11, 9)), rng.integers(0, 3, 5)

    def loss():
        return convolution.losses(convolution.forward(params, x, 2)[0], y)[0].sum()

    scores, kept = convolution.forward(params, x, 2)
    found = convolution.backward(params, kept, convolution.losses(scores, y)[1])
    for p, g in zip(params, found, strict=True):
        assert p.shape == g.shape
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def plain_adamw(p, gradients, rate, decay, clip):
    m = v = np.zeros_like(p)
    for t, g in enumerate(gradients, 1):
        g = g * min(1, clip / (np.sqrt((g**2).sum()) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - rate * decay * p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def test_steps_of_the_optimiser():
    rng = np.random.default_rng(41)
    p, gradients = rng.normal(size=7), [rng.normal(size=7) * s for s in (0.1, 5, 1)]
    steps = convolution.Steps([p.copy()], [np.zeros(7)], [np.zeros(7)])
    for g in gradients:
        steps.take([g], 0.01, 0.1, 2.0)
    assert np.allclose(steps.params[0], plain_adamw(p, gradients, 0.01, 0.1, 2.0))


@pytest.fixture(scope="module")
def patterns(spark):
    """Images with a bright bar, square or corner at a random place: what a linear model of pixels can't tell well."""
    rng = np.random.default_rng(42)
    x, y = rng.normal(size=(420, 12, 12)) * 0.3, rng.integers(0, 3, 420)
    for i, c in enumerate(y):
        a, b = rng.integers(1, 8, 2)
        place = {0: np.s_[a : a + 4, b], 1: np.s_[a, b : b + 4], 2: np.s_[a : a + 2, b : b + 2]}[c]
        x[i][place] += 2
    df = frame(spark, x.reshape(420, -1), y)
    return df.where("row_id < 300").persist(), df.where("row_id >= 300").persist()


def test_network_learns_shapes(patterns):
    train, test = patterns
    net = convolution.fit_convnet(train, test, 3, (12, 12), widths=(8, 16), epochs=15, batch=32, rate=5e-3)
    found = metrics.accuracy(net.transform(test)).first().accuracy
    history = net.history.collect()
    line = metrics.accuracy(classifiers.fit_least_squares(train, 3).transform(test)).first().accuracy
    assert found > 0.85 > line and found == pytest.approx(max(h.accuracy for h in history)) and history[0].loss > min(h.loss for h in history)
    assert metrics.best_epoch(net.history, convolution.PATIENCE).first().epoch == net.epoch
    assert net.transform(test).where("confidence < 0.33 or confidence > 1").count() == 0


def test_network_training_does_not_depend_on_the_layout(patterns, monkeypatch):
    """Barrier tasks, one task, and other orders and partitions give the same weights."""
    monkeypatch.setattr(svm, "PART_ROWS", 80)
    train, test = patterns
    how = {"widths": (4,), "epochs": 2, "batch": 50, "rate": 1e-2, "vary": lambda x, rng: x + rng.normal(size=x.shape) * 0.01}
    one = convolution.fit_convnet(train.coalesce(1), test, 3, (12, 12), tasks=1, **how)
    for df, tasks in ((train.orderBy(F.desc("row_id")).repartition(7), 3), (train, None)):
        other = convolution.fit_convnet(df, test, 3, (12, 12), tasks=tasks, **how)
        assert all((a == b).all() for a, b in zip(one.params, other.params, strict=True))
    with pytest.raises(ValueError):
        convolution.fit_convnet(train.limit(0), test, 3, (12, 12))


def test_many_steps_of_several_tasks_take_little_time(patterns, monkeypatch):
    """60 steps, of several lanes and tasks, don't wait a second each, and give the weights of one task."""
    monkeypatch.setattr(svm, "PART_ROWS", 80)
    monkeypatch.setattr(convolution, "LANE_PIXELS", 150, raising=False)
    monkeypatch.setattr(convolution, "CHUNK", 7, raising=False)
    train, test = patterns
    how = {"widths": (4,), "epochs": 1, "batch": 5, "rate": 1e-2}
    one = convolution.fit_convnet(train, test, 3, (12, 12), tasks=1, **how)
    began = time.monotonic()
    several = convolution.fit_convnet(train, test, 3, (12, 12), tasks=3, **how)
    assert time.monotonic() - began < 45
    assert all((a == b).all() for a, b in zip(one.params, several.params, strict=True))


def test_rate_falls_and_training_stops(patterns):
    """With a rate that leads nowhere, the rate falls on a plateau and training ends early."""
    train, test = patterns
    net = convolution.fit_convnet(train, test.where("row_id < 330"), 3, (12, 12), widths=(2,), epochs=12, batch=300, rate=1e-30, patience=5)
    history = net.history.orderBy("epoch").collect()
    assert len(history) < 12 and history[-1].rate < history[0].rate and net.epoch <= len(history) - 5
