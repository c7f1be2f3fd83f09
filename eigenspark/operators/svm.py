"""Support vector machines, one class against the rest: hinge loss with half the squared norm times reg, the bias free.

Rows are dealt to parts by the md5 of id and seed and ordered by it in a part, and parts are added up in their order; so
neither the partitions nor the order of the rows change a result.  `fit_svms` goes down by mini-batches, for several
training sets and settings at once.  `certified` goes up the dual problem by coordinates, with a dual variable for each row
and class that stays with the rows, and stops at a duality gap, which proves how far the weights are from the best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifiers import LinearModel
from .linalg import Components, block
from .sampling import key
from .tables import checkpointed

#: Fixed values of the descent: rows of a step, momentum, and how the rate falls by epoch; usual settings.
STEP_ROWS, MOMENTUM, DECAY = 256, 0.9, 0.1
EPOCHS, REG, RATE = 12, 1e-3, 0.2
#: Rows and bytes of features of a part, about.
PART_ROWS, PART_BYTES = 4096, 32 << 20
#: Bytes of a piece of sums that travels as one value; parts whose sums one task adds up.
PIECE, TOGETHER = 1 << 20, 64
#: The dual ascent: rows whose products are computed at once, passes over a part and steps in a round at least, rounds between
#: two checkpoints.
AT_ONCE, PASSES, STEPS, KEEP = 64, 10, 16_384, 10


def packed_parts(df: DataFrame, features: str, label: str, row_id: str, seed: int, trains: str | None = None) -> DataFrame:
    """part, n, x, y and sets: the rows of each part by key, packed; sets: the training sets of each row, all of them numbered.

    The number of parts depends on the number of rows and features only.
    """
    rows = df.select(key(row_id, seed).alias("_key"), F.col(row_id).alias("_id"), F.col(features).alias("_x"), F.col(label).cast("int").alias("_y"), (F.col(trains) if trains else F.array(F.lit(0))).alias("_sets"))
    rows = rows.where(F.size("_sets") > 0)
    n, p = rows.agg(F.count("*"), F.max(F.size("_x"))).first()
    parts = max(1, -(-n // max(1, min(PART_ROWS, PART_BYTES // (8 * max(1, p or 1))))))
    part = (F.conv(F.substring("_key", 1, 12), 16, 10).cast("long") % parts).cast("int")

    def pack(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_id"], kind="stable")
        x = block(pdf["_x"])
        size = np.array([len(s) for s in pdf["_sets"]], np.int32)
        sets = np.concatenate([np.asarray(s, np.int32) for s in pdf["_sets"]])
        return pd.DataFrame({"part": [k[0]], "n": [len(x)], "x": [x.tobytes()], "y": [pdf["_y"].to_numpy(np.int32).tobytes()], "sets": [np.concatenate([size, sets]).tobytes()]})

    return rows.withColumn("part", part).groupBy("part").applyInPandas(pack, "part int, n int, x binary, y binary, sets binary")


def _unpacked(n: int, x: bytes, y: bytes, sets: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Features, labels, and the places of the rows of each training set."""
    numbers = np.frombuffer(sets, np.int32)
    row = np.repeat(np.arange(n), numbers[:n])
    return np.frombuffer(x).reshape(n, -1), np.frombuffer(y, np.int32), {int(g): row[numbers[n:] == g] for g in np.unique(numbers[n:])}


_SUMS = "k int, at int, width int, part int, data binary"


def pieces_of(part: int, matrices: dict[int, np.ndarray]):
    """Rows k, at, width, part and data of a part's matrices by key."""
    for k, m in matrices.items():
        m = np.ascontiguousarray(m, float)
        step = max(1, PIECE // (8 * max(1, m.shape[1])))
        for a in range(0, len(m), step):
            yield k, a, m.shape[1], part, m[a : a + step].tobytes()


def added_in_order(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by key of the parts' matrices, the same to the last bit however the parts lie; one matrix for each key comes back."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        total = np.frombuffer(pdf["data"].iloc[0]).copy()
        for d in pdf["data"].iloc[1:]:
            total += np.frombuffer(d)
        return pd.DataFrame({"k": [key[0]], "at": [key[1]], "width": [pdf["width"].iloc[0]], "part": [key[2]], "data": [total.tobytes()]})

    some = rows.groupBy("k", "at", F.floor(F.col("part") / TOGETHER).cast("int").alias("part")).applyInPandas(add, _SUMS)
    out: dict[int, list] = {}
    for r in sorted(some.groupBy("k", "at", F.lit(0).alias("part")).applyInPandas(add, _SUMS).collect(), key=lambda r: (r.k, r["at"])):
        out.setdefault(r.k, []).append(np.frombuffer(r.data).reshape(-1, r.width))
    return {k: np.concatenate(v) for k, v in out.items()}


def descend(w: np.ndarray, v: np.ndarray, z: np.ndarray, y: np.ndarray, reg: float, rate: float) -> None:
    """Steps over the rows in turn, in place: hinge loss of every class against the rest, the bias (last) unpenalised."""
    for a in range(0, len(z), STEP_ROWS):
        x, sign = z[a : a + STEP_ROWS], np.where(y[a : a + STEP_ROWS, None] == np.arange(len(w)), 1.0, -1.0)
        active = sign * (sign * (x @ w[:, :-1].T + w[:, -1]) < 1) / len(x)
        g = -np.column_stack([active.T @ x, active.sum(0)])
        g[:, :-1] += reg * w[:, :-1]
        v *= MOMENTUM
        v -= rate * g
        w += v


def fit_svms(df: DataFrame, settings: list[dict], classes: int, bases: dict[int, Components | None], trains: str, features: str = "features", label: str = "label", seed: int = 42, row_id: str = "row_id") -> dict[tuple[int, int], LinearModel]:
    """Support vector machines of several training sets and settings at once, by (training set, place of the setting).

    trains: an array column, the training sets that a row belongs to; bases: the components of each.  Settings have
    n_components (0: all), reg_strength, epochs and learning_rate.  Each epoch is one pass: every part goes down from the
    weights so far over its own rows, and the weights of all parts are averaged by their rows.  What goes out and comes
    back is one matrix of classes by components for each training set and setting; those that differ in epochs share one.
    """
    descents: dict[tuple, int] = {}
    for s in settings:
        descents.setdefault((s.get("n_components", 0), s["reg_strength"], s["learning_rate"]), len(descents))
    parts = packed_parts(df, features, label, row_id, seed, trains).persist()
    shapes = parts.select("part", (F.length("x") / 8 / F.col("n")).cast("int").alias("width")).collect()  # two numbers for each part
    width = max((r.width for r in shapes), default=0)
    kinds, most = list(descents), max(s["epochs"] for s in settings)
    size = lambda g, c: min(c or width, len(bases[g].components) if bases[g] is not None else width)
    state = {(g, d): np.zeros((2, classes, size(g, c) + 1)) for g in bases for d, (c, _, _) in enumerate(kinds)}
    out: dict[tuple[int, int], LinearModel] = {}
    try:
        # one part has nothing to average with, so it goes on by itself up to the next number of epochs that a setting wants
        stops = sorted({s["epochs"] for s in settings}) if len(shapes) <= 1 else range(1, most + 1)
        for began, epoch in zip([0, *stops], stops, strict=False):
            sent = df.sparkSession.sparkContext.broadcast((state, bases))

            def run(batches):
                start, basis_of = sent.value
                for pdf in batches:
                    rows = []
                    for part, n, x, y, sets in zip(pdf.part, pdf.n, pdf.x, pdf.y, pdf.sets, strict=True):
                        x, y, places = _unpacked(n, x, y, sets)
                        turns = []
                        for e in range(began, epoch):
                            turn = np.empty(n, np.int64)
                            turn[np.random.default_rng([seed, e, part]).permutation(n)] = np.arange(n)
                            turns.append(turn)
                        flat = {}
                        for g, basis in basis_of.items():
                            if g not in places:
                                continue
                            own = x[places[g]] if basis is None else basis.project(x[places[g]])
                            weights = [start[g, d].copy() for d in range(len(kinds))]
                            for e, turn in enumerate(turns, began):
                                order = np.argsort(turn[places[g]])
                                z, labels = own[order], y[places[g]][order]
                                for m, (_, reg, rate) in zip(weights, kinds, strict=True):
                                    descend(m[0], m[1], z[:, : m.shape[2] - 1], labels, reg, rate / (1 + DECAY * e))
                            for d, m in enumerate(weights):
                                flat[g * len(kinds) + d] = np.append(len(own) * m.ravel(), len(own))[None]
                        rows += pieces_of(part, flat)
                    yield pd.DataFrame(rows, columns=["k", "at", "width", "part", "data"])

            for k, m in added_in_order(parts.mapInPandas(run, _SUMS)).items():
                g, d = divmod(k, len(kinds))
                state[g, d] = (m[0, :-1] / m[0, -1]).reshape(state[g, d].shape)
            sent.unpersist()
            for i, s in enumerate(settings):
                if s["epochs"] == epoch:
                    d = descents[s.get("n_components", 0), s["reg_strength"], s["learning_rate"]]
                    for g in bases:
                        w = state[g, d][0]
                        out[g, i] = LinearModel(w[:, :-1].copy(), w[:, -1].copy(), bases[g], s)
    finally:
        parts.unpersist()
    return out


def fit_svm(df: DataFrame, classes: int, reg: float = REG, epochs: int = EPOCHS, rate: float = RATE, features: str = "features", label: str = "label", basis: Components | None = None, row_id: str = "row_id") -> LinearModel:
    """One support vector machine by mini-batch descent."""
    rows = df.withColumn("_trains", F.array(F.lit(0)))
    return fit_svms(rows, [{"reg_strength": reg, "epochs": epochs, "learning_rate": rate}], classes, {0: basis}, "_trains", features, label, row_id=row_id)[0, 0]


@dataclass(frozen=True)
class Certified:
    """A model, the primal and dual values of each class at its weights, rounds taken, and whether all gaps came under the tolerance.

    No weights have a primal value below the dual one; so the best squared distance to the weights is at most 2 * gap / reg.
    """

    model: LinearModel
    primal: np.ndarray
    dual: np.ndarray
    rounds: int
    converged: bool

    @property
    def gaps(self) -> np.ndarray:
        return self.primal - self.dual


def ascend(x: np.ndarray, y: np.ndarray, a: np.ndarray, w: np.ndarray, b: np.ndarray, scale: float, bias_scale: float, safe: float, rng: np.random.Generator, passes: int) -> None:
    """Passes of coordinate ascent over the dual variables a (classes, rows) of a part, in place.

    w and b: the weights so far; a variable times its sign adds scale * x to w and bias_scale to b.  safe: the number of
    parts that move at the same time, by which each part's own moves are magnified for itself.
    """
    w, b = w.copy(), b.copy()
    own = scale * (x**2).sum(1) + bias_scale
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), AT_ONCE):
            rows = order[at : at + AT_ONCE]
            z, sign = x[rows], np.where(y[rows] == np.arange(len(w))[:, None], 1.0, -1.0)
            margin, gram = sign * (w @ z.T + b[:, None]), scale * (z @ z.T) + bias_scale
            moved, old = np.zeros_like(sign), a[:, rows]
            for j in range(len(rows)):
                step = np.clip(old[:, j] + (1 - margin[:, j]) / (safe * own[rows[j]]), 0.0, 1.0) - old[:, j]
                moved[:, j] = step * sign[:, j]
                margin += safe * sign * (moved[:, j, None] * gram[j])
            a[:, rows] = old + moved * sign
            w += safe * scale * moved @ z
            b += safe * bias_scale * moved.sum(1)


def certified(df: DataFrame, classes: int, reg: float = REG, tolerance: float = 1e-4, rounds: int = 200, features: str = "features", label: str = "label", row_id: str = "row_id", seed: int = 42) -> Certified:
    """The support vector machines of all classes by dual coordinate ascent, to a duality gap of `tolerance` in each class.

    Every round is one pass: each part goes up its own variables, and the moves of all parts are added up.  The bias is
    free: it is drawn to a middle value, which moves on whenever the problem with that pull is solved well enough, so that
    the pull vanishes; the dual value is that of variables scaled to balance, as a free bias demands.  What goes out and comes back is a few matrices of classes by features.  An
    error without rows; `converged` tells whether the tolerance was reached in time.
    """
    spark = df.sparkSession
    start = packed_parts(df, features, label, row_id, seed)
    state = start.select("part", "n", "x", "y", F.lit(None).cast("binary").alias("a"), F.array().cast(f"array<struct<{_SUMS.replace(' ', ':').replace(',:', ',')}>>").alias("out")).persist()
    try:
        n, parts, p, squares = _sizes(state)
        if not n or not p:
            raise ValueError("no training rows")
        scale, bias_scale = 1 / (reg * n), max(squares / n, 1e-12) / (reg * n)
        # held: the dual value of the problem in which the bias is drawn to `middle` with this strength
        pull = 1 / (bias_scale * n)
        w, b, middle = np.zeros((classes, p)), np.zeros(classes), np.zeros(classes)
        dual, held = np.zeros(classes), np.zeros(classes)
        for done in range(1, rounds + 1):
            sent = spark.sparkContext.broadcast((w, b))

            def run(batches):
                w, b = sent.value
                for pdf in batches:
                    out, moved = [], []
                    for part, n, x, y, a in zip(pdf.part, pdf.n, pdf.x, pdf.y, pdf.a, strict=True):
                        x, y = np.frombuffer(x).reshape(n, -1), np.frombuffer(y, np.int32)
                        a = np.frombuffer(a).reshape(classes, n).copy() if a is not None else np.zeros((classes, n))
                        sign = np.where(y == np.arange(classes)[:, None], 1.0, -1.0)
                        loss = np.maximum(0.0, 1 - sign * (w @ x.T + b[:, None])).sum(1)
                        ascend(x, y, a, w, b, scale, bias_scale, float(parts), np.random.default_rng([seed, done, part]), max(PASSES, STEPS // n))
                        up, down = a * (sign > 0), a * (sign < 0)
                        out.append([dict(zip(("k", "at", "width", "part", "data"), r, strict=True)) for r in pieces_of(part, {0: np.vstack([np.column_stack([up @ x, up.sum(1)]), np.column_stack([down @ x, down.sum(1)])]), 1: loss[None]})])
                        moved.append(a.tobytes())
                    yield pdf.assign(a=moved, out=out)

            older, state = state, state.mapInPandas(run, state.schema).persist()
            if done % KEEP == 0:
                kept, state = state, checkpointed(state)
                kept.unpersist()
            got = added_in_order(state.select(F.explode("out").alias("o")).select("o.*"))
            older.unpersist()
            sent.unpersist()
            primal = got[1][0] / n + reg / 2 * (w**2).sum(1)
            if (primal - dual <= tolerance).all():
                return Certified(LinearModel(w, b, None, {"reg_strength": reg}), primal, dual, done, True)
            last, pulled = (w, b, primal, dual), pull / 2 * (b - middle) ** 2
            close = primal + pulled - held <= np.maximum(tolerance / 4, pulled / 2)  # the held problem is solved well enough
            up, down = got[0][:classes], got[0][classes:]
            lean = up[:, p] - down[:, p]
            w = (up[:, :p] - down[:, :p]) * scale
            middle = np.where(close, middle + lean * bias_scale, middle)
            b = middle + lean * bias_scale
            held = (up[:, p] + down[:, p] - middle * lean) / n - reg / 2 * (w**2).sum(1) - pull / 2 * (lean * bias_scale) ** 2
            # scaled so that both sides weigh the same, as the free bias demands
            even = np.minimum(up[:, p], down[:, p])
            s, t = (np.divide(even, v, out=np.zeros(classes), where=v > 0) for v in (up[:, p], down[:, p]))
            fair = (s[:, None] * up[:, :p] - t[:, None] * down[:, :p]) * scale
            dual = 2 * even / n - reg / 2 * (fair**2).sum(1)
        return Certified(LinearModel(last[0], last[1], None, {"reg_strength": reg}), last[2], last[3], rounds, False)
    finally:
        state.unpersist()


def _sizes(state: DataFrame) -> tuple[int, int, int, float]:
    """Rows, parts, features, and the sum of the squares of all features."""

    @F.pandas_udf("double")
    def square(x: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(v) ** 2).sum()) for v in x], dtype=float)

    rows = state.select("part", "n", (F.length("x") / 8 / F.col("n")).cast("int").alias("p"), square("x").alias("s")).groupBy("part").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.max("s").alias("s"))
    each = sorted(rows.collect())  # a row of four numbers for each part
    return sum(r.n for r in each), len(each), max((r.p for r in each), default=0), float(sum(r.s for r in each))
