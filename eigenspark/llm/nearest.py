"""Exact search of the largest inner products, with bounds from distances to pivots.

Vectors are lifted to a sphere of one dimension more, where the largest inner products are the smallest distances.  There
the greatest difference of two vectors' distances to a pivot is a lower bound of their own distance.  The distances to all
pivots together also place a vector in the pivots' span, up to a rest of known length; the greater of both bounds counts.
Candidates live at their nearest pivot; the ranges of distances there tell which pivots a query has to visit at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, SAMPLE = 64, 2000
#: Candidates and queries of a cell, about.
CELL, QUERIES = 16_384, 4_096
#: Candidates evaluated between two looks at the bounds, at first.
STEP = 64

_WIDTHS = {b"h": np.int16, b"i": np.int32, b"q": np.int64}


def packed_rows(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: a letter for the smallest type that holds them all, and the numbers."""
    most = np.abs(values).max(initial=0.0)
    if most >= 2.0**63:
        raise ValueError("a component times the scale leaves the range of 64-bit integers")
    letter = next(c for c, t in _WIDTHS.items() if most <= np.iinfo(t).max and (t is np.int64 or most < np.iinfo(t).max))
    data, size = values.astype(_WIDTHS[letter]).tobytes(), np.dtype(_WIDTHS[letter]).itemsize
    return [letter + data[a * size : b * size] for a, b in zip(ends, ends[1:], strict=False)]


def quantised(vectors: DataFrame, scale: int = 256, more: str = "") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as packed integers, dims, and the sum of their squares; more: other
    columns to keep, with their types.

    Vectors that are null or hold a null or non-finite component have no row; nor have null ids.  An empty vector is one
    of no components.  An error if a component leaves the 64-bit range.
    """

    def run(batches):
        for b in batches:
            lists = b.column(1)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null is not a number then
            ends = np.append(0, np.cumsum(size))
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            keep = (bad[ends[1:]] == bad[ends[:-1]]) & np.array(lists.is_valid()) & np.array(b.column(0).is_valid())
            v = np.floor(x[np.repeat(keep, size)] * scale)
            size = size[keep]
            ends = np.append(0, np.cumsum(size))
            sums = np.append(0.0, np.cumsum(v * v))
            squares = sums[ends[1:]] - sums[ends[:-1]] if not len(set(size.tolist())) == 1 or not size[0] else (v * v).reshape(len(size), -1).sum(1)
            yield pa.record_batch([b.column(0).filter(pa.array(keep)), pa.array(packed_rows(v, ends), pa.binary()), pa.array(size.astype(np.int32)), pa.array(squares, pa.float64()), *(c.filter(pa.array(keep)) for c in b.columns[2:])], ["vec_id", "v", "dims", "square", *b.schema.names[2:]])

    kept = [c.split()[0] for c in more.split(",") if c]
    schema = "vec_id long, v binary, dims int, square double" + (f", {more}" if more else "")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *kept).mapInArrow(run, schema)


def matrix(packed, dims: int, kind=np.float64) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled with zeros."""
    packed = [bytes(p) for p in packed]
    if packed and len({(len(p), p[:1]) for p in packed}) == 1:
        t = _WIDTHS[packed[0][:1]]
        own = np.frombuffer(b"".join(p[1:] for p in packed), t).reshape(len(packed), -1)
        if own.shape[1] == dims:
            return own.astype(kind)
    out = np.zeros((len(packed), dims), kind)
    for k, p in enumerate(packed):
        v = np.frombuffer(p, _WIDTHS[p[:1]], offset=1)
        out[k, : len(v)] = v.tolist() if kind is object else v
    return out


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """Rows that lie far from each other: each next one is the farthest from those before."""
    if not len(x):
        return x
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Vectors on a sphere of one dimension more; there, the largest inner products are the smallest distances."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, radius - (x**2).sum(1)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))


def most_product(low: np.ndarray, far: float, both: float) -> np.ndarray:
    """The largest whole inner product at a distance of at least `low`; far: the largest distance in question, for rounding.

    both: the sum of the squares of the query and of the sphere.
    """
    low = np.maximum(0.0, np.asarray(low, float) - 2e-6 * (1 + far))
    return np.floor((both - low**2) / 2 + 1e-6 * (1 + abs(both)))


#: Directions of the pivots' span with a smaller share of the largest one's square aren't told from rounding, and left out.
THIN = 1e-3


class Span:
    """Places of vectors in the span of the pivots, from their distances to these."""

    def __init__(self, pivots: np.ndarray):
        self.squares = (pivots**2).sum(1)
        values, vectors = np.linalg.eigh(pivots @ pivots.T)
        keep = values > THIN * max(values.max(initial=0.0), 1e-300)
        self.turn = vectors[:, keep] / np.sqrt(values[keep])

    def place(self, far: np.ndarray, squares, room: float) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of vectors with these squares, and the most that the rest can measure; room: for rounding."""
        z = ((np.asarray(squares, float)[..., None] + self.squares - far.astype(float) ** 2) / 2) @ self.turn
        return z, np.sqrt(np.maximum(0.0, squares - (z**2).sum(1)) + room)


def search(query: np.ndarray, own: int, q_far: np.ndarray, both: float, ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int, floor: float = -np.inf, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best candidates of one cell, and how many were evaluated.

    Candidates are evaluated in the order of their bounds, some at a time, until the next bound is below the k-th score or
    `floor`, a k-th score that is known from elsewhere.  far: a row for each pivot; x and query: whole numbers in a type
    that holds their products exactly; most: other bounds of the products.
    """
    if most is not None and floor > -np.inf:
        near = np.flatnonzero(most >= floor)
        ids, x, far, most = ids[near], x[near], far[:, near], most[near]
    low, gap = np.zeros(len(ids), far.dtype), np.empty(len(ids), far.dtype)
    for own_far, to_pivot in zip(far, q_far.astype(far.dtype), strict=True):
        np.abs(np.subtract(own_far, to_pivot, out=gap), out=gap)
        np.maximum(low, gap, out=low)
    high = most_product(low, q_far.max(initial=0) + far.max(initial=0), both)
    high = high if most is None else np.minimum(high, most)
    left = np.flatnonzero((ids != own) & (high >= floor))
    looked, step = 0, STEP
    best_ids, best = np.empty(0, np.int64), np.empty(0, x.dtype if x.dtype == object else np.int64)
    while len(left):
        if len(left) > step:
            top = np.argpartition(-high[left], step)
            some, left = left[top[:step]], left[top[step:]]
        else:
            some, left = left, left[:0]
        score = x[some] @ query
        score = score if x.dtype == object else score.astype(np.int64)
        looked += len(some)
        best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, score])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        if len(best) == k:
            left = left[high[left] >= max(floor, best[-1])]
        step *= 4
    if x.dtype == object and any(abs(s) >= 1 << 63 for s in best):
        raise OverflowError("an inner product leaves the range of 64-bit integers")
    return best_ids, best, looked


#: Pairs of a cell and a block of queries up to which they are broadcast.
SENT = 1_000_000


def wanted_only(candidates: DataFrame, visits: DataFrame, most: int) -> DataFrame:
    """candidates (with their cell c) once for each block of queries that visits it; there are at most `most` such pairs."""
    wanted = visits.distinct()
    return candidates.join(F.broadcast(wanted) if most <= SENT else wanted, "c")


def _found(vectors: DataFrame, every: int, k: int, scale: int, pivots: int, cell: int, queries: int) -> DataFrame | None:
    """query_id, q (the query's vector), vec_id, score and looked: the best of each visited cell; looked is the number of
    candidates evaluated there, on one row of each query and cell.  None without queries."""
    raw = stored(quantised(vectors, scale))
    n, radius, dims, n_queries = raw.agg(F.count("*"), F.max("square"), F.max("dims"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not n or not n_queries:
        return None
    # no sum of products is over the largest square, so these hold it exactly
    exact = np.float32 if radius < 2**23 else np.float64 if radius < 2**52 else np.int64 if radius < 2**62 else object
    sample = raw.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # a bounded sample
    points = spread_out(lifted(matrix([r.v for r in sample], dims), radius), pivots)
    span, room = Span(points), 2e-5 * (1 + radius)

    def placed(batches):
        for b in batches:
            to = distances(lifted(matrix(b.column(1).to_pylist(), dims), radius), points)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([d.tobytes() for d in to.astype(np.float32)], pa.binary()), pa.array(to.argmin(1).astype(np.int32))], ["vec_id", "v", "square", "far", "home"])

    table = stored(raw.select("vec_id", "v", "square").mapInArrow(placed, "vec_id long, v binary, square double, far binary, home int"))

    def ranges(batches):
        for b in batches:
            home, far = b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(b.num_rows, -1)
            for h in np.unique(home):
                own = far[home == h]
                yield pa.record_batch([pa.array(np.full(len(points), h, np.int32)), pa.array(np.arange(len(points), dtype=np.int32)), pa.array(own.min(0)), pa.array(own.max(0)), pa.array(np.full(len(points), len(own)))], ["home", "pivot", "lo", "hi", "n"])

    # at most a row for each pair of pivots
    spans = table.select("far", "home").mapInArrow(ranges, "home int, pivot int, lo float, hi float, n long").groupBy("home", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    lo, hi, held = np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf), np.zeros(len(points), np.int64)
    for r in spans:
        lo[r.home, r.pivot], hi[r.home, r.pivot], held[r.home] = r.lo, r.hi, r.n
    parts = -(-held // cell)
    base = np.cumsum(parts) - parts  # cells are numbered by home and part
    down = max(1, -(-n_queries // queries))
    cells = F.create_map(*[F.lit(int(v)) for h in np.flatnonzero(parts) for v in (h, base[h])])
    sizes = F.create_map(*[F.lit(int(v)) for h in np.flatnonzero(parts) for v in (h, parts[h])])
    own = cells[F.col("home")] + F.pmod(F.xxhash64(F.monotonically_increasing_id()), sizes[F.col("home")])
    candidates = table.select("vec_id", "v", "far", own.cast("long").alias("c"))

    def visits(later: bool):
        """Cells that a query has to visit: first those of the pivots with the best bounds that hold over k candidates together,
        later all others whose bound reaches its floor."""

        def run(batches):
            for b in batches:
                rows = []
                for i, (v, square, floor) in enumerate(zip(*(b.column(c).to_pylist() for c in ("v", "square", "floor")), strict=True)):
                    q = matrix([v], dims)
                    far = distances(np.column_stack([q, [0.0]]), points)[0]
                    low = np.maximum(lo - far, far - hi).max(1, initial=0.0)
                    high = np.where(parts > 0, most_product(np.where(parts > 0, low, 0.0), far.max() + float(hi.max()), square + radius), -np.inf)
                    order = np.lexsort((far, -high))
                    first = order[: int(np.searchsorted(np.cumsum(held[order]), k, "right")) + 1]
                    first = first[parts[first] > 0].tolist()
                    homes = first if not later else [h for h in np.flatnonzero((parts > 0) & (high >= (-np.inf if floor is None else floor))) if h not in first]
                    rows += [(i, c, far.tobytes()) for h in homes for c in range(base[h], base[h] + parts[h])]
                at = pa.array([r[0] for r in rows], pa.int64())
                t = b.take(at)
                yield pa.record_batch([*(t.column(c) for c in ("vec_id", "v", "square", "floor", "h")), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["vec_id", "v", "square", "floor", "h", "q_far", "c"])

        return run

    def within(key, own: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(want):
            ids, x = own.vec_id.to_numpy(), matrix(own.v, dims, exact)
            far = np.frombuffer(b"".join(own.far), np.float32).reshape(len(own), -1)
            z, rest = span.place(far, np.full(len(own), radius), room)
            z, far = z.astype(np.float32), np.ascontiguousarray(far.T)
            for a in range(0, len(want), 64):
                some = want.iloc[a : a + 64]
                to = np.frombuffer(b"".join(some.q_far)).reshape(len(some), -1)
                zq, rest_q = span.place(to, some.square.to_numpy(), room)
                bounds = z @ zq.T.astype(np.float32)
                for i, (q, v, square, floor) in enumerate(zip(some.vec_id, some.v, some.square, some.floor, strict=True)):
                    most = np.floor(bounds[:, i] + rest * rest_q[i] + room)
                    best, score, looked = search(matrix([v], dims, exact)[0], q, to[i], square + radius, ids, x, far, k, -np.inf if pd.isna(floor) else floor, most)
                    found += [(q, v, j, s, 0 if r else looked) for r, (j, s) in enumerate(zip(best.tolist(), score.tolist(), strict=True))] or [(q, v, None, None, looked)]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = ("int64", "object", "Int64", "Int64", "int64")  # scores stay whole numbers beside nulls
        return pd.DataFrame({n: pd.array(list(c), t) if t == "Int64" else pd.Series(c, dtype=t) for n, c, t in zip(("query_id", "q", "vec_id", "score", "looked"), columns, kinds, strict=True)})

    def searched(asked: DataFrame, later: bool) -> DataFrame:
        sent = asked.mapInArrow(visits(later), "vec_id long, v binary, square double, floor double, h long, q_far binary, c long")
        there = wanted_only(candidates, sent.select("c", F.col("h").alias("block")), int(parts.sum()) * down)
        return there.groupBy("c", "block").cogroup(sent.groupBy("c", "h")).applyInPandas(within, "query_id long, q binary, vec_id long, score long, looked long")

    asked = table.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "square", F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(down)).alias("h"))
    first = stored(searched(asked.withColumn("floor", F.lit(None).cast("double")), False))
    # a double may round a large score up by one part in 2**53
    floors = ranked(first, k).groupBy("query_id", "q").agg(F.when(F.count("*") == k, F.min("score").cast("double") - F.abs(F.min("score")) * 1e-15).alias("floor")).withColumnsRenamed({"query_id": "vec_id", "q": "v"})
    return first.unionByName(searched(asked.join(floors, ["vec_id", "v"], "left").select("vec_id", "v", "square", "floor", "h"), True))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def largest_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = PIVOTS, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest integer inner products of each query with every other vector.

    Queries: vectors whose id is divisible by `every`.  Ties go to the smaller id.  The pivots come from a sample of at
    most SAMPLE vectors, which changes how much is evaluated, never the result.  A query first visits the cells of about
    `cell` candidates at the pivots with the best bounds; the k-th score there tells which other pivots' cells it visits.
    Rows with the query's id aren't its candidates; a repeated id is a candidate as often as it occurs, and each different
    vector of it a query.  Vectors of fewer components, down to none, count as filled up with zeros.  Null vectors, those
    with a null or non-finite component and null ids take no part; an empty table gives no rows; other columns don't
    matter.  Components may have any size, but for an error where a component or a score leaves the 64-bit range.
    """
    found = _found(vectors, every, k, scale, pivots, cell, queries)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def evaluated(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = PIVOTS, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """One row: queries, and the number of candidates whose product was computed for them."""
    found = _found(vectors, every, k, scale, pivots, cell, queries)
    return found.agg(F.count_distinct("query_id", "q").alias("queries"), F.sum("looked").alias("evaluated"))
