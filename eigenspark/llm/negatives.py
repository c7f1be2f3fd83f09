"""Hard negatives: for every anchor and each of its positives, high-scoring rows of another label within limits.

The scores of an anchor with all rows are sorted block by block: a block's scores are one matrix product, sorted by score
and id; the place of a positive's upper limit is found by binary search, and the rows of other labels that follow are read
until the lower limit or the k-th of them.  A window then merges what the blocks have found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored
from .nearest import matrix, quantised

#: Rows of a block, and bytes of its vectors, at most; blocks that a task works through; anchors of a task, about.
BLOCK, BLOCK_BYTES, BLOCKS, ANCHORS = 16_384, 8 << 20, 16, 4_096
#: Rows of a block below which more tasks don't pay.
LEAST = 1024
#: Labels are counted and kept together by so many hashes of them.
BUCKETS = 4096


def exact_type(radius: float):
    """A type that holds every sum of products: none is over the largest square of a vector."""
    return np.float32 if radius < 2**23 else np.float64 if radius < 2**52 else np.int64 if radius < 2**62 else object


def full_order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, then rising id; ids rise already, so places stand for them."""
    if scores.dtype != object and len(scores) and float(np.abs(scores).max()) < 2.0**45 and len(scores) <= 1 << 17:
        keys = -scores.astype(np.int64) * (1 << 17) + np.arange(len(scores))  # one number sorts like score and place
        keys.sort()
        return keys & ((1 << 17) - 1)
    return np.lexsort((ids, -scores))


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole score s with low * positive <= 100 * s <= high * positive."""
    return max(-(-low * positive // 100), -(1 << 63)), min(high * positive // 100, (1 << 63) - 1)


def within_limits(falling: np.ndarray, positive: int, low: int, high: int, k: int) -> tuple[int, int]:
    """(first, last) of the first k of the falling scores that lie within a positive's limits."""
    least, most = limits(positive, low, high)
    up = falling[::-1]
    first = len(up) - int(np.searchsorted(up, most, "right"))  # binary search of the upper limit
    last = len(up) - int(np.searchsorted(up, least, "left"))
    return first, max(first, min(last, first + k))


def _packed(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's rows by id, as one row of arrays."""
    rows = rows.sort_values("vec_id", kind="stable")
    sizes = np.array([len(v) for v in rows.v], np.int32)
    return pd.DataFrame({"cell": [key[0]], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "labels": [rows.label.to_numpy(np.int64).tobytes()], "sizes": [sizes.tobytes()], "vs": [b"".join(map(bytes, rows.v))]})


def _block(row, dims: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.append(0, np.cumsum(np.frombuffer(row.sizes, np.int32)))
    data = bytes(row.vs)
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64), matrix([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], dims, kind)


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as whole numbers; an error where a long can't hold one."""
    if scores.dtype == object:
        if any(abs(s) >= 1 << 63 for s in scores.ravel()):
            raise OverflowError("an inner product leaves the range of 64-bit integers")
        return scores
    return scores.astype(np.int64)


def _top(found: pd.DataFrame, by: list[str], k: int) -> pd.DataFrame:
    """The first k of each group by falling score and rising id."""
    found = found.sort_values([*by, "score", "id"], ascending=[*[True] * len(by), False, True], kind="stable")
    return found[found.groupby(by).cumcount() < k]


class Table:
    """Rows in blocks, each block of few labels; anchors, stored; what is known of both."""

    def __init__(self, vectors: DataFrame, every: int, scale: int):
        labelled = vectors.where("label is not null").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
        raw = stored(quantised(labelled, scale, "label long").withColumn("b", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")))
        counts = {r.b: (r.n, r.a) for r in raw.groupBy("b").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("a")).collect()}  # at most BUCKETS rows
        self.rows, self.spark = sum(n for n, _ in counts.values()), raw.sparkSession
        if not self.rows:
            return
        radius, self.dims, width = raw.agg(F.max("square"), F.max("dims"), F.max(F.length("v"))).first()
        self.kind = exact_type(radius)
        most = max(1, min(BLOCK, BLOCK_BYTES // max(1, width), max(LEAST, -(-self.rows // partitions(raw)))))
        # buckets of labels in a row share a block until it is full; a large bucket has several blocks to itself
        plan, cell, room = {}, 0, most
        for b in sorted(counts):
            n = counts[b][0]
            if n > room and room < most:
                cell, room = cell + 1, most
            parts = max(1, -(-n // most))
            plan[b] = (cell, parts)
            cell, room = (cell + parts, most) if parts > 1 else (cell, room - n)
        self.cells = cell + (room < most)
        schema = "b int, cell int, parts int, tall int"
        plan = [(b, c, p, max(1, -(-counts[b][1] // ANCHORS))) for b, (c, p) in plan.items()]
        home = F.broadcast(self.spark.createDataFrame(plan, schema))
        part = F.pmod(F.xxhash64("_i"), F.col("parts"))  # repeated rows are spread too; which part it is changes no result
        placed = raw.withColumn("_i", F.monotonically_increasing_id()).join(home, "b").select("vec_id", "label", "v", (F.col("cell") + part).cast("int").alias("cell"))
        blocks = "cell int, ids binary, labels binary, sizes binary, vs binary"
        self.blocks = stored(placed.groupBy("cell").applyInPandas(_packed, blocks))
        anchors = raw.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"]).join(home, "b")
        self.anchors = stored(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v", "cell", "parts", "tall"))
        self.tall = max(1, -(-sum(a for _, a in counts.values()) // ANCHORS))
        # blocks that several labels share are as tall as the tallest of these
        self.heights = F.broadcast(self.spark.createDataFrame(sorted({(c + i, t) for _, c, p, t in plan for i in range(p)}), "cell int, tall int").groupBy("cell").agg(F.max("tall").alias("tall")))

    def positives(self, k: int) -> DataFrame:
        """anchor, place (from 1), positive_id and score of the k best other rows of each anchor's label."""
        dims, kind = self.dims, self.kind

        def run(key, blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            out = []
            for block in blocks.itertuples():
                ids, labels, x = _block(block, dims, kind)
                for label, own in anchors.groupby("label"):
                    mine = np.flatnonzero(labels == label)
                    for a in range(0, len(own) if len(mine) else 0, 64):
                        some = own.iloc[a : a + 64]
                        scores = _whole(matrix(some.v, dims, kind) @ x[mine].T)
                        for anchor, i, s in zip(some.anchor, some.vec_id, scores, strict=True):
                            order = full_order(s, ids[mine])
                            best = order[: k + int((ids[mine] == i).sum())]
                            best = best[ids[mine][best] != i][:k]
                            out.append((np.full(len(best), anchor), ids[mine][best], s[best].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 3
            return pd.DataFrame(dict(zip(("anchor", "id", "score"), columns, strict=True)))

        left = self.blocks.join(self.heights, "cell").withColumn("h", F.explode(F.expr("sequence(0, tall - 1)"))).drop("tall")
        # an anchor's row among those of its bucket of labels
        right = self.anchors.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)"))).select("anchor", "vec_id", "label", "v", (F.col("cell") + F.col("i")).alias("cell"), F.pmod(F.xxhash64("anchor"), F.col("tall")).cast("int").alias("h"))
        found = left.groupBy("cell", "h").cogroup(right.groupBy("cell", "h")).applyInPandas(run, "anchor long, id long, score long")
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    def negatives(self, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """anchor, place, id, score and rank of the k best rows of other labels within the limits of each positive.

        asked: the anchors with `positives`, an array of scores in the order of places.
        """
        dims, kind = self.dims, self.kind

        def run(key, blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            found = pd.DataFrame({"anchor": np.empty(0, np.int64), "place": np.empty(0, np.int32), "id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
            for block in blocks.itertuples() if len(anchors) else ():
                ids, labels, x = _block(block, dims, kind)
                new = []
                for a in range(0, len(anchors), 64):
                    some = anchors.iloc[a : a + 64]
                    scores = _whole(matrix(some.v, dims, kind) @ x.T)
                    for anchor, i, label, wanted, s in zip(some.anchor, some.vec_id, some.label, some.positives, scores, strict=True):
                        order = full_order(s, ids)
                        order = order[(labels[order] != label) & (ids[order] != i)]
                        falling = s[order]
                        for place, positive in enumerate(wanted):
                            first, last = within_limits(falling, int(positive), low, high, k)
                            if last > first:
                                new.append((np.full(last - first, anchor), np.full(last - first, place + 1, np.int32), ids[order[first:last]], falling[first:last].astype(np.int64)))
                if new:
                    columns = [np.concatenate(c) for c in zip(*new, strict=True)]
                    found = _top(pd.concat([found, pd.DataFrame(dict(zip(found.columns, columns, strict=True)))]), ["anchor", "place"], k)
            return found

        # blocks in a row go to one task, as long as there are enough tasks
        span = max(1, min(BLOCKS, self.cells * self.tall // partitions(asked)))
        groups = -(-self.cells // span)
        left = self.blocks.withColumn("g", F.floor(F.col("cell") / span).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(self.tall - 1))))
        right = asked.select("anchor", "vec_id", "label", "v", "positives", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("anchor"), F.lit(self.tall)).cast("int").alias("h"))
        best = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(run, "anchor long, place int, id long, score long")
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from vec_id, embedding and label.

    Anchors: rows whose id is divisible by `every`; positives: the first so many other rows of an anchor's label by falling
    score and rising id; negatives: the first k rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score.  Scores are exact integer inner products of floor(scale * x); an error where a component or a
    score leaves the 64-bit range.  Rows with a null id, label or vector or a null or non-finite component take no part;
    vectors of fewer components, down to none, count as filled up with zeros.  Rows with the anchor's id aren't its
    partners; of a repeated id every different vector and label is an anchor, and a repeated row is a partner as often as
    it occurs.  Anchors without a positive, and positives without a negative, have no rows, nor has an empty table; other
    columns don't matter.  A label may hold any share of the rows: blocks are bounded, and so are tasks.
    """
    table = Table(vectors, every, scale)
    if not table.rows:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    each = stored(table.positives(positives))
    listed = each.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select("anchor", F.col("p.positive_score").alias("positives"))  # at most `positives` of each
    asked = stored(table.anchors.join(listed, "anchor"))
    found = table.negatives(asked, k, low, high).join(each, ["anchor", "place"]).join(table.anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
