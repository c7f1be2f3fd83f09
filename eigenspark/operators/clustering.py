"""k-means by Lloyd's steps with kept bounds.

Rows are packed into parts once; every row keeps its cluster, an upper bound of the distance to that cluster's centre and a
lower bound of the distance to any other.  A step moves the bounds by what the centres have moved, and measures only rows
whose bounds cross; a pass hands on sums by cluster, the same to the last bit however the rows lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import block
from .sampling import global_cap, key
from .svm import added_in_order, packed_parts, pieces_of
from .tables import checkpointed

#: Numbers of distances that are computed at once, steps between two checkpoints.
AT_ONCE, KEEP = 1 << 22, 10


@dataclass(frozen=True)
class Clusters:
    """centres (k, p), those that the last assignment was made with, steps taken, whether the centres came to rest, and how many
    distances were computed."""

    centres: np.ndarray
    assigned_with: np.ndarray
    steps: int
    converged: bool
    computed: int = 0

    def transform(self, df: DataFrame, features: str = "features", last: bool = False) -> DataFrame:
        """Adds cluster, the nearest centre, the first of equals; last: by the centres after the last update."""
        centres = self.centres if last else self.assigned_with

        @F.pandas_udf("int")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(nearest(block(x), centres)[0].astype(np.int32)) if len(x) else pd.Series([], dtype=np.int32)

        return df.withColumn("cluster", run(features))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, its distance, and the distance of the next one (endless if there is none).

    Distances come from products; where rounding could change the order, they are computed again from differences.
    """
    out, first, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    square = (centres**2).sum(1)
    for a in range(0, len(x), step := max(1, AT_ONCE // len(centres))):
        some = x[a : a + step]
        own = (some**2).sum(1)
        d = np.maximum(own[:, None] + square[None] - 2 * some @ centres.T, 0.0)
        room = 1e-11 * (own + square.max() + 1)
        close = (d <= (d.min(1) + room)[:, None]).sum(1) > 1
        for r in np.flatnonzero(close):
            d[r] = ((some[r] - centres) ** 2).sum(1)
        best = d.argmin(1)
        rows = np.arange(len(some))
        out[a : a + step], first[a : a + step] = best, np.sqrt(d[rows, best])
        if len(centres) > 1:
            d[rows, best] = np.inf
            second[a : a + step] = np.sqrt(d.min(1))
    return out, first, second


def kmeans(df: DataFrame, k: int, steps: int = 30, tolerance: float = 1e-4, row_id: str = "row_id", features: str = "features", seed: int = 42) -> Clusters:
    """Lloyd's steps from k rows in seeded order, until the centres move by less than the tolerance.

    The source is read for the first centres and then once more.  An empty cluster goes to the next row in seeded order.
    As in the usual loop, `assigned_with` are the centres of the last assignment, which are from before the last update.
    """
    ordered = global_cap(df.select(row_id, features), 2 * k, row_id, seed).orderBy(key(row_id, seed), row_id)
    starts = [np.array(r[features], float) for r in ordered.collect()]  # 2 * k rows
    if len(starts) < k:
        raise ValueError(f"{k} clusters need {k} rows")
    centres, spare = np.array(starts[:k]), starts[k:]
    p = centres.shape[1]
    parts = packed_parts(df.select(row_id, features, F.lit(0).alias("_l")), features, "_l", row_id, seed).select("part", "n", "x")
    state = parts.withColumns({c: F.lit(None).cast("binary") for c in ("own", "upper", "lower")}).withColumn("computed", F.lit(0).cast("long")).withColumn("out", F.array().cast("array<struct<k:int,at:int,width:int,part:int,data:binary>>")).persist()
    moved_by, computed = None, 0
    try:
        for done in range(1, steps + 1):
            sent = df.sparkSession.sparkContext.broadcast((centres, moved_by))

            def run(batches):
                centres, moves = sent.value
                for pdf in batches:
                    rows = []
                    for part, n, x, own, upper, lower in zip(pdf.part, pdf.n, pdf.x, pdf.own, pdf.upper, pdf.lower, strict=True):
                        x = np.frombuffer(x).reshape(n, -1)
                        if own is None:
                            own, upper, lower = nearest(x, centres)
                            looked = n * len(centres)
                        else:
                            own, upper, lower = np.frombuffer(own, np.int64).copy(), np.frombuffer(upper).copy(), np.frombuffer(lower).copy()
                            upper += moves[own]
                            far = np.argsort(-moves, kind="stable")[:2]
                            lower -= np.where(own == far[0], moves[far[-1]] if len(far) > 1 else 0.0, moves[far[0]])
                            room = 1e-9 * (1 + upper)
                            cross = np.flatnonzero(upper + room >= lower)
                            upper[cross] = np.sqrt(((x[cross] - centres[own[cross]]) ** 2).sum(1))  # often enough
                            looked = len(cross)
                            cross = cross[upper[cross] + room[cross] >= lower[cross]]
                            own[cross], upper[cross], lower[cross] = nearest(x[cross], centres)
                            looked += len(cross) * len(centres)
                        sums = np.zeros((len(centres), x.shape[1] + 1))
                        order = np.argsort(own, kind="stable")
                        start = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
                        sums[own[order][start], :-1] = np.add.reduceat(x[order], start, axis=0)
                        sums[:, -1] = np.bincount(own, minlength=len(centres))
                        out = [dict(zip(("k", "at", "width", "part", "data"), r, strict=True)) for r in pieces_of(part, {0: sums})]
                        rows.append((own.tobytes(), upper.tobytes(), lower.tobytes(), looked, out))
                    yield pdf.assign(**dict(zip(("own", "upper", "lower", "computed", "out"), map(list, zip(*rows, strict=True)), strict=True)))

            older, state = state, state.mapInPandas(run, state.schema).persist()
            if done % KEEP == 0:
                kept, state = state, checkpointed(state)
                kept.unpersist()
            got = added_in_order(state.select(F.explode("out").alias("o")).select("o.*"))[0]
            computed += state.agg(F.sum("computed")).first()[0]
            older.unpersist()
            sent.unpersist()
            sums, sizes = got[:, :p], got[:, p]
            new = sums / np.maximum(sizes, 1)[:, None]
            for c in np.flatnonzero(sizes == 0):
                new[c] = spare.pop(0) if spare else centres[c]
            moved_by = np.sqrt(((new - centres) ** 2).sum(1))
            before, centres = centres, new
            if float(np.sqrt((moved_by**2).sum())) < tolerance:
                return Clusters(centres, before, done, True, computed)
        return Clusters(centres, before, steps, False, computed)
    finally:
        state.unpersist()
