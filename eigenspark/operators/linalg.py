"""Sums over vectors, principal components and least squares.

Each task adds up its own rows with NumPy and hands on one table of sums, which Spark adds up by place: what is shuffled
grows with the number of tasks and components, not of rows.  Solvers run on the sums, whose size is a matter of the
number of components only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import ModelStore, content_digest


def block(column: pd.Series) -> np.ndarray:
    """A column of arrays as the rows of a matrix of doubles."""
    return np.array(column.tolist(), float).reshape(len(column), -1)


def mean_vector(df: DataFrame, features: str = "features") -> DataFrame:
    """pos, mean of each component."""
    return moments(df, features).select("pos", "mean")


def moments(df: DataFrame, features: str = "features") -> DataFrame:
    """pos, n, mean and variance (population) of each component.

    Tasks give sums about their own first row's values, so large offsets don't cost digits; these are combined exactly.
    """

    def run(batches):
        n = 0
        for pdf in batches:
            x = block(pdf[features])
            if not len(x):
                continue
            if n == 0:
                mean, spread = np.zeros(x.shape[1]), np.zeros(x.shape[1])
            m, s = x.mean(0), ((x - x.mean(0)) ** 2).sum(0)
            d = m - mean
            spread = spread + s + d**2 * n * len(x) / (n + len(x))
            mean, n = mean + d * len(x) / (n + len(x)), n + len(x)
        if n:
            yield pd.DataFrame({"pos": np.arange(len(mean), dtype=np.int32), "n": n, "m": mean, "s": spread})

    parts = df.select(features).mapInPandas(run, "pos int, n long, m double, s double")
    first = parts.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    return first.select("pos", "n", "mean", ((F.col("s") + F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / F.col("n")).alias("variance"))


def global_moments(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: n, mean and deviation (population) of all components of all rows; a deviation below 1e-6 becomes 1."""
    m = moments(df, features)
    out = m.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * (F.col("variance") + F.col("mean") ** 2)).alias("q"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.col("mean") ** 2))
    return out.select("n", "mean", F.when(deviation < 1e-6, 1.0).otherwise(deviation).alias("deviation"))


def gram(df: DataFrame, features: str = "features") -> DataFrame:
    """i, j, value: sum over rows of the products of components i and j."""

    def run(batches):
        g = None
        for pdf in batches:
            x = block(pdf[features])
            if len(x):
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            p = len(g)
            for a in range(0, p, 256):  # some rows of the table at a time
                own = np.arange(a, min(p, a + 256), dtype=np.int32)
                yield pd.DataFrame({"i": np.repeat(own, p), "j": np.tile(np.arange(p, dtype=np.int32), len(own)), "value": g[own].ravel()})

    return df.select(features).mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def class_sums(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """label, pos, n, total: sums of each component over the rows of each class."""

    def run(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            x, y = block(pdf[features]), pdf[label].to_numpy()
            for c in np.unique(y):
                own = x[y == c]
                old = sums.setdefault(int(c), [0, 0.0])
                old[0] += len(own)
                old[1] = old[1] + own.sum(0)
        for c, (n, s) in sums.items():
            yield pd.DataFrame({"label": c, "pos": np.arange(len(s), dtype=np.int32), "n": n, "total": s})

    parts = df.select(features, F.col(label).cast("int").alias(label)).where(F.col(label).isNotNull()).mapInPandas(run, "label int, pos int, n long, total double")
    return parts.groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def covariance(df: DataFrame, features: str = "features") -> DataFrame:
    """i, j, value: sample covariance (n - 1) of components i and j."""
    m = moments(df, features)
    g = gram(df, features)
    a = m.select(F.col("pos").alias("i"), F.col("mean").alias("mi"), "n")
    b = m.select(F.col("pos").alias("j"), F.col("mean").alias("mj"))
    return g.join(a, "i").join(b, "j").select("i", "j", ((F.col("value") - F.col("n") * F.col("mi") * F.col("mj")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("value"))


@dataclass(frozen=True)
class Sums:
    """Sums over the rows of a training set: enough for components, least squares and class means.

    n: rows; total: of each component; products: of pairs of components; per_class: of each component by class;
    counts: rows by class.
    """

    n: int
    total: np.ndarray
    products: np.ndarray
    per_class: np.ndarray
    counts: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.total - other.total, self.products - other.products, self.per_class - other.per_class, self.counts - other.counts)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.total + other.total, self.products + other.products, self.per_class + other.per_class, self.counts + other.counts)


#: Bytes of a piece of sums that travels as one value.
PIECE = 1 << 20


def summed(df: DataFrame, run, columns: list[str]) -> dict[int, np.ndarray]:
    """Sums by key of the matrices that tasks add up: run takes an iterator of pandas tables and gives {key: matrix}.

    Matrices travel and are added in pieces of whole rows; what comes to the driver is one matrix for each key.
    """

    def parts(batches):
        for k, m in run(batches).items():
            m = np.ascontiguousarray(m, float)
            step = max(1, PIECE // (8 * max(1, m.shape[1])))
            for a in range(0, len(m), step):
                yield pd.DataFrame({"k": [k], "at": [a], "width": [m.shape[1]], "data": [m[a : a + step].tobytes()]})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["data"].iloc[0]).copy()
        for d in pdf["data"].iloc[1:]:
            total += np.frombuffer(d)
        return pd.DataFrame({"k": [key[0]], "at": [key[1]], "width": [pdf["width"].iloc[0]], "data": [total.tobytes()]})

    schema = "k int, at int, width int, data binary"
    rows = df.select(*columns).mapInPandas(parts, schema).groupBy("k", "at").applyInPandas(add, schema).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.k, r["at"])):
        out.setdefault(r.k, []).append(np.frombuffer(r.data).reshape(-1, r.width))
    return {k: np.concatenate(v) for k, v in out.items()}


def grouped_sums(df: DataFrame, groups: int, classes: int, group: str | None = None, features: str = "features", label: str = "label") -> list[Sums]:
    """Sums of each group (an int column, from 0) in one pass.  What comes to the driver: groups * (p * p + classes * p) numbers."""

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, y = block(pdf[features]), pdf[label].to_numpy(int)
            which = pdf[group].to_numpy(int) if group else np.zeros(len(y), int)
            for k in np.unique(which):
                z, c = x[which == k], y[which == k]
                hot = np.zeros((classes, len(c)))
                hot[c, np.arange(len(c))] = 1
                p = z.shape[1]
                new = np.zeros((p + classes, p + 1))  # products, then class sums; counts in the last column
                new[:p, :p], new[p:, :p], new[p:, p] = z.T @ z, hot @ z, hot.sum(1)
                own[int(k)] = new if int(k) not in own else own[int(k)] + new
        return own

    found = summed(df, run, [features, label, *([group] if group else [])])
    out = []
    for g in range(groups):
        if g not in found:
            raise ValueError(f"no training rows in group {g}")
        p = found[g].shape[1] - 1
        per_class, counts = found[g][p:, :p], found[g][p:, p]
        out.append(Sums(int(counts.sum()), per_class.sum(0), found[g][:p, :p], per_class, counts.astype(np.int64)))
    return out


@dataclass(frozen=True)
class Components:
    """mean (p), components (k, p) and explained variance (k) of a training set."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T


def components_of(sums: Sums, k: int) -> Components:
    """Principal components; k is held to [1, min(n, p)], and the largest loading of each is positive."""
    p = len(sums.total)
    k = max(1, min(k, sums.n, p))
    mean = sums.total / sums.n
    cov = (sums.products - sums.n * np.outer(mean, mean)) / max(sums.n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    own = vectors[:, order].T
    own = own * np.where(own[np.arange(k), np.abs(own).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Components(mean, own, np.maximum(values[order], 0.0))


def projected_sums(sums: Sums, basis: Components) -> Sums:
    """The sums of the projected rows, without a pass over them."""
    v, m = basis.components, basis.mean
    total = v @ (sums.total - sums.n * m)
    centred = sums.products - np.outer(sums.total, m) - np.outer(m, sums.total) + sums.n * np.outer(m, m)
    return Sums(sums.n, total, v @ centred @ v.T, (sums.per_class - sums.counts[:, None] * m) @ v.T, sums.counts)


def fit_components(df: DataFrame, k: int, features: str = "features", store: ModelStore | None = None) -> Components:
    """Principal components of the rows of df: from the sums of one pass, or with over WIDE features by `lanczos`.

    store: where components are kept by the contents of the rows, and found again; other rows have other ones.
    """
    key = None
    if store is not None:
        key = f"{content_digest(df, [features])}-{k}"
        if (kept := store.find("components", key)) is not None:
            return Components(kept.arrays["mean"], kept.arrays["components"], kept.arrays["explained_variance"])
    one = df.select(features, F.lit(0).alias("_label"))
    if len((df.select(features).first() or [[]])[0]) <= WIDE:
        basis = components_of(grouped_sums(one, 1, 1, features=features, label="_label")[0], k)
    else:
        basis = lanczos(df, k, features)[0]
    if store is not None:
        store.save("components", key, {"k": k}, {"mean": basis.mean, "components": basis.components, "explained_variance": basis.explained_variance})
    return basis


#: Features up to which the products of all pairs are added up; beyond that components come from `lanczos`.
WIDE = 1024
#: Columns of a block, at most; bytes of the bases of the training sets that are worked on together; passes, at most.
BLOCK, BASES_BYTES, PASSES = 128, 256 << 20, 200


class Krylov:
    """The block Lanczos process of a symmetric matrix that is known by its products with blocks of columns only.

    Every new block is made orthogonal to all before it, twice, so that rounding costs no direction.
    """

    def __init__(self, p: int, width: int, rng: np.random.Generator):
        self.p, self.rng, self.size = p, rng, 0
        self.blocks = [np.linalg.qr(rng.normal(size=(p, min(width, p))))[0]]
        self.diagonal: list[np.ndarray] = []
        self.below: list[np.ndarray] = []  # from each block to the next
        self.fresh = self.probed = False  # whether the last block, and the one before, has directions at random

    def last(self) -> np.ndarray:
        return self.blocks[-1]

    def take(self, product: np.ndarray) -> None:
        """The product of the matrix with the last block."""
        q = self.blocks[-1]
        self.diagonal.append((q.T @ product + product.T @ q) / 2)
        basis = np.column_stack(self.blocks)
        self.size = basis.shape[1]
        w = product
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        scale = max(np.abs(np.linalg.eigvalsh(d)).max() for d in self.diagonal)
        room = min(q.shape[1], self.p - self.size)
        new = u[:, s > 1e-11 * max(scale, 1e-300)][:, :room]  # what is smaller is rounding
        self.fresh, self.probed = new.shape[1] < room, self.fresh
        if self.fresh:  # nothing more is reached from here: other directions may hold equal values
            new = np.column_stack([new, self.rng.normal(size=(self.p, room - new.shape[1]))])
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        if room:
            self.below.append(new.T @ w)
            self.blocks.append(new)

    def found(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k largest values, their vectors (columns), and how far the matrix takes each vector off its line."""
        sizes = [d.shape[0] for d in self.diagonal]
        ends = np.cumsum(sizes)
        t = np.zeros((ends[-1], ends[-1]))
        for j, d in enumerate(self.diagonal):
            a = slice(ends[j] - sizes[j], ends[j])
            t[a, a] = d
            if j + 1 < len(sizes):
                b = slice(ends[j], ends[j + 1])
                t[b, a], t[a, b] = self.below[j], self.below[j].T
        values, y = np.linalg.eigh(t)
        top = np.argsort(-values, kind="stable")[:k]
        off = np.zeros(len(top)) if len(self.blocks) == len(sizes) else np.sqrt(((self.below[-1] @ y[-sizes[-1] :, top]) ** 2).sum(0))
        return values[top], np.column_stack(self.blocks[: len(sizes)]) @ y[:, top], off


def lanczos(df: DataFrame, k: int, features: str = "features", trains: str | None = None, sets: list[int] | None = None, tolerance: float = 1e-9, passes: int = PASSES, seed: int = 42) -> dict[int, Components]:
    """Principal components of each training set, with a known error: block Lanczos with one pass over the rows for a block.

    trains: an array column, the sets that a row belongs to (all rows are set 0 by default).  A set is done when each of its
    k components is taken off its line by no more than `tolerance` of the largest variance; no variance is then off by more
    than that.  An error if that isn't reached within so many passes.  What is added up and goes out is a block of features
    by up to BLOCK columns for each set; sets take turns where their bases would be over BASES_BYTES.
    """
    rows = df.select(F.col(features).alias("_x"), (F.col(trains) if trains else F.array(F.lit(0))).alias("_sets"))
    p = len((rows.select("_x").first() or [[]])[0])
    sets = [0] if sets is None else list(sets)
    out: dict[int, Components] = {}
    together = max(1, BASES_BYTES // max(1, 8 * p * 4 * k))
    for a in range(0, len(sets), together):
        out |= _lanczos(rows, p, k, sets[a : a + together], tolerance, passes, seed)
    return out


def _lanczos(rows: DataFrame, p: int, k: int, sets: list[int], tolerance: float, passes: int, seed: int) -> dict[int, Components]:
    def of_sets(pdf: pd.DataFrame, wanted):
        x, member = block(pdf["_x"]).reshape(-1, p), [set(s) for s in pdf["_sets"]]
        for g in wanted:
            own = np.array([g in m for m in member], bool)
            if own.any():
                yield g, x[own]

    def totals(batches):
        sums = {}
        for pdf in batches:
            for g, x in of_sets(pdf, sets):
                sums[g] = sums.get(g, 0) + np.append(x.sum(0), len(x))[None]
        return sums

    whole = summed(rows, totals, ["_x", "_sets"])
    if missing := [g for g in sets if g not in whole]:
        raise ValueError(f"no training rows in group {missing[0]}")
    n = {g: int(whole[g][0, p]) for g in sets}
    mean = {g: whole[g][0, :p] / n[g] for g in sets}
    want = {g: max(1, min(k, n[g], p)) for g in sets}
    going = {g: Krylov(p, min(want[g], BLOCK), np.random.default_rng([seed, g])) for g in sets}
    out: dict[int, Components] = {}
    for _ in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast({g: (mean[g], s.last()) for g, s in going.items()})

        def products(batches):
            sums = {}
            for pdf in batches:
                for g, x in of_sets(pdf, sent.value):
                    m, q = sent.value[g]
                    x = x - m
                    sums[g] = sums.get(g, 0) + x.T @ (x @ q)
            return sums

        for g, w in summed(rows, products, ["_x", "_sets"]).items():
            space = going[g]
            space.take(w / max(n[g] - 1, 1))
            values, vectors, off = space.found(want[g])
            whole_space = space.size == p
            if whole_space or (len(values) == want[g] and (space.probed or not space.fresh) and (off <= tolerance * max(values.max(), 0.0) + 1e-300).all()):
                own = vectors.T
                own = own * np.where(own[np.arange(len(own)), np.abs(own).argmax(1)] < 0, -1.0, 1.0)[:, None]
                out[g] = Components(mean[g], own, np.maximum(values, 0.0))
                del going[g]
        sent.unpersist()
        if not going:
            return out
    raise ArithmeticError(f"components of {len(going)} training sets didn't converge in {passes} passes")


def basis_sums(df: DataFrame, bases: dict[int, Components], classes: int, features: str = "features", label: str = "label", trains: str | None = None) -> dict[int, Sums]:
    """Sums over the projected rows of each training set, in one pass; sets as in `lanczos`."""
    rows = df.select(F.col(features).alias("_x"), F.col(label).cast("int").alias("_y"), (F.col(trains) if trains else F.array(F.lit(0))).alias("_sets"))
    sent = df.sparkSession.sparkContext.broadcast(bases)

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, y, member = block(pdf["_x"]), pdf["_y"].to_numpy(int), [set(s) for s in pdf["_sets"]]
            for g, basis in sent.value.items():
                rows_of = np.flatnonzero([g in m for m in member])
                z, hot = basis.project(x[rows_of]), np.zeros((classes, len(rows_of)))
                hot[y[rows_of], np.arange(len(rows_of))] = 1
                q = z.shape[1]
                new = np.zeros((q + classes, q + 1))
                new[:q, :q], new[q:, :q], new[q:, q] = z.T @ z, hot @ z, hot.sum(1)
                own[g] = new if g not in own else own[g] + new
        return own

    out = {}
    for g, m in summed(rows, run, ["_x", "_y", "_sets"]).items():
        q = m.shape[1] - 1
        out[g] = Sums(int(m[q:, q].sum()), m[q:, :q].sum(0), m[:q, :q], m[q:, :q], m[q:, q].astype(np.int64))
    return out


def project(df: DataFrame, basis: Components, features: str = "features", to: str = "projected") -> DataFrame:
    """Adds the projection of each row; the basis travels with the function (k * p numbers)."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(basis.project(block(x))))

    return df.withColumn(to, run(features))


def variance_curve(values: DataFrame, target: float = 0.95) -> DataFrame:
    """Of rows (pos, value): ratio, cumulative ratio and n_target, the number of values that first reach the target.

    n_target is 1 if the target is never reached.  The rows are as many as there are components.
    """
    whole = Window.partitionBy()
    upto = Window.orderBy(F.desc("value"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    out = values.withColumn("ratio", F.col("value") / F.sum("value").over(whole)).withColumn("cumulative", F.sum("ratio").over(upto)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "pos")))
    return out.withColumn("n_target", F.coalesce(F.min(F.when(F.col("cumulative") >= target, F.col("place"))).over(whole), F.lit(1)))
