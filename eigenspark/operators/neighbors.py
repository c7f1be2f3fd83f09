"""Exact nearest neighbours by metric cells.

A tree of balls is made from a bounded sample of the training rows; every training row goes to a leaf of it, and leaves get
their true radii and counts.  Leaves that are next to each other share a cell, a large leaf has several.  A query first visits
the cells of the smallest ball on its way down that holds enough rows; the k-th distance found there tells by the triangle
inequality which other leaves can hold a nearer row, and only their cells are visited.  A query is sent once to each cell
that it visits, a cell's rows are copied once for every QUERY_CELL visits, and what a task holds is bounded in rows and
bytes.  Rows belong to groups, such as the folds of a cross-validation, by the bits of a mask: all groups are searched at
once, and a distance is computed once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linalg import block
from .tables import written

#: Training rows and visits of a cell, at most; training rows of a leaf, about; visits for which a cell isn't copied for more tasks.
TRAIN_CELL, QUERY_CELL, LEAF, FEW_VISITS = 32_768, 32_768, 4_096, 2_048
#: Bytes of the features of either side of a cell (as doubles), at most; of the rows that a task reads, about.
CELL_BYTES, TASK_BYTES = 16 << 20, 32 << 20
#: Leaves, sampled rows, and bytes of either, at most.
LEAVES, SAMPLE, TREE_BYTES = 4_096, 32_768, 32 << 20
#: Groups of one search: bits of a long.
GROUPS = 62
#: Queries, and training rows, whose distances are computed together; queries whose visits are found together.
STEP, RUN, SOME = 128, 8_192, 512
#: Rows near a query that are kept without a look at their order.
LOOSE = 64


@dataclass
class Balls:
    """A binary tree; node 0 is the root, leaves are numbered from left to right.

    centres: of each node; left and right: child nodes, or -1; first and last: the leaves below a node.
    """

    centres: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.last[0]) + 1

    def leaf_nodes(self) -> np.ndarray:
        nodes = np.flatnonzero(self.left < 0)
        return nodes[np.argsort(self.first[nodes])]

    def down(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance to its centre) of each row: at every node on to the nearer child, the left one of equals."""
        node = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if self.left[at] < 0 or not len(rows):
                node[rows] = at
                continue
            a, b = self.left[at], self.right[at]
            nearer = ((x[rows] - self.centres[a]) ** 2).sum(1) <= ((x[rows] - self.centres[b]) ** 2).sum(1)
            todo += [(a, rows[nearer]), (b, rows[~nearer])]
        return self.first[node], np.sqrt(((x - self.centres[node]) ** 2).sum(1))

    def reached(self, x: np.ndarray, within: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that can hold something no farther from a row than `within`; radii: of the nodes, -1 if empty."""
        rows_of, leaf_of, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if radii[at] < 0:
                continue
            far = np.sqrt(((x[rows] - self.centres[at]) ** 2).sum(1))
            rows = rows[far - radii[at] <= within[rows] + 1e-9 * (1 + far)]
            if len(rows) and self.left[at] < 0:
                rows_of.append(rows)
                leaf_of.append(np.full(len(rows), self.first[at]))
            elif len(rows):
                todo += [(self.left[at], rows), (self.right[at], rows)]
        return (np.concatenate(rows_of), np.concatenate(leaf_of)) if rows_of else (np.empty(0, np.int64), np.empty(0, np.int64))


def grown(sample: np.ndarray, leaves: int) -> Balls:
    """A tree of at most so many leaves: the node with most rows is split between two rows far from each other and their means."""
    centres, left, right, members = [sample.mean(0)], [-1], [-1], [np.arange(len(sample))]
    open_ = {0: len(sample)}
    while open_ and len(open_) < leaves:
        at = max(open_, key=lambda n: (open_[n], -n))
        if open_[at] < 2:
            break
        own = sample[members[at]]
        a = own[((own - centres[at]) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        for _ in range(3):
            nearer = ((own - a) ** 2).sum(1) <= ((own - b) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            a, b = own[nearer].mean(0), own[~nearer].mean(0)
        if nearer.all() or not nearer.any():
            open_[at] = 0  # rows of one place
            continue
        for centre, part in ((a, members[at][nearer]), (b, members[at][~nearer])):
            centres.append(centre)
            left.append(-1)
            right.append(-1)
            members.append(part)
            open_[len(centres) - 1] = len(part)
        left[at], right[at] = len(centres) - 2, len(centres) - 1
        del open_[at]
    first, last, count = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), 0
    stack = [(0, False)]
    while stack:
        at, done = stack.pop()
        if left[at] < 0:
            first[at] = last[at] = count
            count += 1
        elif done:
            first[at], last[at] = first[left[at]], last[right[at]]
        else:
            stack += [(at, True), (right[at], False), (left[at], False)]
    return Balls(np.array(centres), np.array(left), np.array(right), first, last)


def node_radii(tree: Balls, leaf_radii: np.ndarray) -> np.ndarray:
    """Radii of balls around the nodes' centres that hold all below; -1 where there is nothing."""
    nodes = tree.leaf_nodes()
    out = np.full(len(tree.centres), -1.0)
    for at in range(len(out)):
        below = np.arange(tree.first[at], tree.last[at] + 1)
        below = below[leaf_radii[below] >= 0]
        if len(below):
            out[at] = (np.sqrt(((tree.centres[nodes[below]] - tree.centres[at]) ** 2).sum(1)) + leaf_radii[below]).max()
    return out


def bits(mask: int) -> list[int]:
    return [g for g in range(GROUPS) if mask >> g & 1]


def rows_of(p: int, most: int) -> int:
    """Rows of so many features that a side of a cell may hold."""
    return max(1, min(most, CELL_BYTES // (8 * p)))


def dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf its first cell and the number of its cells: leaves in a row share one of at most so many rows, a larger leaf has some of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    cell, held = -1, most + 1
    for i, n in enumerate(sizes.tolist()):
        if held + n > most:
            cell, held = cell + 1, 0
        first[i] = cell
        cell, held = cell + int(parts[i]) - 1, held + n
    return first, parts


def foremost(rows: np.ndarray, ids: np.ndarray, distance: np.ndarray, bits_of: np.ndarray, asks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, their bits, limits): those of the k nearest of each row and group, and the largest k-th distance of each row's groups.

    rows: the query (an index into asks) of each place; ties go to the smaller id; a row with a group of fewer has no limit.
    """
    order = np.lexsort((ids, distance, rows))
    rows, distance, bits_of = rows[order], distance[order], bits_of[order]
    kept, limits = np.zeros(len(order), np.int64), np.zeros(len(asks))
    for g in bits(int(np.bitwise_or.reduce(asks, initial=0))):
        near = np.flatnonzero(bits_of >> g & 1)
        own = rows[near]
        rank = np.arange(len(near)) - np.searchsorted(own, own)
        kept[near[rank < k]] |= 1 << g
        last = np.full(len(asks), np.inf)
        last[own[rank == k - 1]] = distance[near[rank == k - 1]]
        limits = np.where(asks >> g & 1, np.maximum(limits, last), limits)
    found = np.flatnonzero(kept)
    return order[found], kept[found], limits


def nearby(d: np.ndarray, holds: np.ndarray, asks: int, k: int, slack: float) -> np.ndarray:
    """Places of all that rounding could bring among the k nearest of a group that is asked for."""
    out = np.zeros(len(d), bool)
    for g in bits(asks):
        near = np.flatnonzero(holds >> g & 1)
        if len(near) > k:
            edge = np.partition(d[near], k - 1)[k - 1]
            near = near[d[near] <= edge + 1e-9 * (1 + abs(edge)) + slack]
        out[near] = True
    return np.flatnonzero(out)


def best_in_cell(ids, holds, x, leaf, far, q, asks, within, lo, hi, gaps, k):
    """(row of the query, place of the neighbour, bits, squared distance) of the k nearest of each query in each of its groups,
    and how many distances were computed.

    Training rows come by leaf and by rising distance to its centre (far).  within: the largest distance (not squared) that
    still matters to a query; lo and hi: leaves that it visits whatever their distance, before the others; gaps: distances
    to the centre of each leaf that the cell has.  What is found in a leaf narrows the search in the next ones.
    """
    edges = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
    square = (x**2).sum(1)
    with_square = np.column_stack([x, square])
    top, looked, out = float(square.max(initial=0.0)), 0, []
    closest = gaps.argmin(1)
    order = np.lexsort((gaps[np.arange(len(q)), closest], closest))
    for a in range(0, len(order), STEP):
        some = order[a : a + STEP]
        own_q, own_asks, gap = q[some], asks[some], gaps[some]
        lifted, own_square = np.column_stack([-2 * own_q, np.ones(len(some))]), (own_q**2).sum(1)
        limit, slack = within[some].copy(), 4e-16 * (x.shape[1] + 16) * (own_square + top)  # the last: rounding of products
        rows, places, distance, kept, last = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), 0
        home = (lo[some, None] <= leaf[edges[:-1]]) & (leaf[edges[:-1]] <= hi[some, None])
        turns = [(j, True) for j in np.flatnonzero(home.any(0))] + [(j, False) for j in gap.mean(0).argsort(kind="stable") if not home[:, j].all()]
        for j, first in turns:
            if len(rows) > last + LOOSE // 4 * len(some) or (last == 0 and len(rows)):  # enough is new for closer limits
                best, kept, limits = foremost(rows, ids[places], distance, kept, own_asks, k)
                rows, places, distance, last = rows[best], places[best], distance[best], len(best)
                limit = np.minimum(limit, np.sqrt(limits))
            room, radius = limit + 1e-9 * (1 + gap[:, j]), far[edges[j + 1] - 1]
            which = np.flatnonzero(home[:, j] if first else ~home[:, j] & (gap[:, j] - radius <= room))
            if not len(which):
                continue
            begin = edges[j] + np.searchsorted(far[edges[j] : edges[j + 1]], (gap[which, j] - room[which]).min(), "left")
            end = edges[j] + np.searchsorted(far[edges[j] : edges[j + 1]], (gap[which, j] + room[which]).max(), "right")
            for at in range(begin, end, RUN):
                held, stop = holds[at : min(end, at + RUN)], min(end, at + RUN)
                rough = lifted[which] @ with_square[at:stop].T  # squared distances but for the query's square
                looked += rough.size
                bound = limit[which] ** 2
                hit = rough <= (bound * (1 + 1e-9) + 1e-9 + slack[which] - own_square[which])[:, None]
                many = np.count_nonzero(hit, 1) > LOOSE
                r, c = np.nonzero(hit & ~many[:, None])
                pairs = [(which[r], at + c)]
                for i in np.flatnonzero(many):
                    near = nearby(rough[i] + own_square[which[i]], held, int(own_asks[which[i]]), k, float(slack[which[i]]))
                    near = near[hit[i, near]]
                    if len(near) > 4 * LOOSE:  # equal ones, mostly
                        exact = ((x[at + near] - own_q[which[i]]) ** 2).sum(1)
                        near = near[foremost(np.zeros(len(near), np.int64), ids[at + near], exact, held[near] & own_asks[which[i]], own_asks[which[i : i + 1]], k)[0]]
                    pairs.append((np.full(len(near), which[i]), at + near))
                new_rows, new = (np.concatenate(v) for v in zip(*pairs, strict=True))
                mask = holds[new] & own_asks[new_rows]
                new_rows, new, mask = new_rows[mask != 0], new[mask != 0], mask[mask != 0]
                rows, places, kept = np.append(rows, new_rows), np.append(places, new), np.append(kept, mask)
                distance = np.append(distance, ((x[new] - own_q[new_rows]) ** 2).sum(1))
        best, kept, _ = foremost(rows, ids[places], distance, kept, own_asks, k)
        out.append((some[rows[best]], places[best], kept, distance[best]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0), 0)
    return (*(np.concatenate(v) for v in zip(*out, strict=True)), looked)


def _searched(queries: DataFrame, train: DataFrame, k: int, centres: np.ndarray, tasks: int) -> DataFrame:
    """Of cells: query_id, neighbor_id, neighbor_label, bits, distance; and looked, on a row without bits for each cell.

    queries: cell, h, query_id, q, asks, within, lo and hi; train: cell, h, neighbor_id, neighbor_label, holds, x and leaf;
    centres: of the leaves.
    """
    columns = ["query_id", "neighbor_id", "neighbor_label", "bits", "distance", "looked"]

    def run(key, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({c: [] for c in columns})
        q, x, leaf, ids = block(asked.pop("q")), block(own.pop("x")), own.leaf.to_numpy(), own.neighbor_id.to_numpy()
        far, gaps = np.empty(len(x)), []
        for at in np.unique(leaf):
            rows = leaf == at
            far[rows] = np.sqrt(((x[rows] - centres[at]) ** 2).sum(1))
            gaps.append(np.concatenate([np.sqrt(((q[a : a + RUN] - centres[at]) ** 2).sum(1)) for a in range(0, len(q), RUN)]))
        order = np.lexsort((ids, far, leaf))
        ids, x = ids[order], x[order]
        rows, found, kept, distance, looked = best_in_cell(ids, own.holds.to_numpy()[order], x, leaf[order], far[order], q, *(asked[c].to_numpy() for c in ("asks", "within", "lo", "hi")), np.column_stack(gaps), k)
        out = {"query_id": asked.query_id.to_numpy()[rows], "neighbor_id": ids[found], "neighbor_label": own.neighbor_label.to_numpy()[order[found]], "bits": kept, "distance": distance, "looked": np.zeros(len(rows), np.int64)}
        return pd.DataFrame({c: np.append(v, looked if c == "looked" else v.dtype.type(0)) for c, v in out.items()})

    schema = "query_id long, neighbor_id long, neighbor_label int, bits long, distance double, looked long"
    left, right = (df.repartition(tasks, "cell", "h").groupBy("cell", "h") for df in (queries, train))
    return left.cogroup(right).applyInPandas(run, schema)


def _ranked(found: DataFrame, k: int, groups: list[int]) -> DataFrame:
    """query_id, g, neighbor_id, neighbor_label, distance and rank of the k nearest of each query and group."""
    each = found.withColumn("g", F.explode(F.expr(f"filter(array({', '.join(map(str, groups))}), g -> (shiftright(bits, g) & 1) = 1)")))
    order = Window.partitionBy("g", "query_id").orderBy("distance", "neighbor_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "g", "neighbor_id", "neighbor_label", "distance", "rank")


class Search:
    """One search: `found` holds the nearest of every cell, `looked` the distances computed; `groups`: those that are asked for."""

    def __init__(self, queries: DataFrame, train: DataFrame, k: int, sizes: tuple[int, int] | None = None):
        """queries: query_id, q and asks; train: neighbor_id, neighbor_label, x and holds."""
        self.k = k
        queries, train = written(queries), written(train)
        n_queries, asks = queries.agg(F.count("*"), F.bit_or("asks")).first()
        n_train = sizes[1] if sizes else train.count()
        self.groups = bits(asks or 0) or [0]
        p = max(1, len((train.select("x").first() or [[]])[0] or []))
        self.most = rows_of(p, QUERY_CELL)
        self.row_bytes = 64 + p * (4 if "float" in train.schema["x"].dataType.simpleString() else 8)
        self.slots = queries.sparkSession.sparkContext.defaultParallelism
        cell_rows = rows_of(p, TRAIN_CELL)
        leaves = min(LEAVES, max(1, TREE_BYTES // (16 * p)), -(-n_train // LEAF))
        if leaves <= 1:
            across = max(1, -(-n_train // cell_rows))
            down = self.tall(n_queries, across)
            asked = queries.select("*", F.lit(float("inf")).alias("within"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cell"))
            own = train.select("*", F.lit(0).alias("leaf"), F.pmod(F.xxhash64("neighbor_id"), F.lit(across)).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("h"))
            self.found = _searched(asked, own, k, np.zeros((1, p)), self.tasks(across * down, n_queries * across + n_train * down))
            return
        rows = max(leaves, min(SAMPLE, TREE_BYTES // (8 * p)))
        tree = grown(np.array([r.x for r in train.orderBy(F.xxhash64("neighbor_id"), "neighbor_id").limit(rows).select("x").collect()], float), leaves)  # a bounded sample

        @F.pandas_udf("leaf int, far double")
        def placed(x: pd.Series) -> pd.DataFrame:
            leaf, far = tree.down(block(x))
            return pd.DataFrame({"leaf": leaf.astype(np.int32), "far": far})

        train = written(train.withColumn("at", placed("x")).select("neighbor_id", "neighbor_label", "x", "holds", "at.leaf", "at.far"))
        held = [F.sum(F.expr(f"shiftright(holds, {g}) & 1")).alias(f"g{g}") for g in self.groups]
        radii, counts, sizes_of = np.full(tree.leaves, -1.0), np.zeros((tree.leaves, GROUPS), np.int64), np.zeros(tree.leaves, np.int64)
        for r in train.groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n"), *held).collect():  # a row for each leaf
            radii[r.leaf], sizes_of[r.leaf], counts[r.leaf, self.groups] = r.far, r.n, r[3:]
        self.tree, self.radii = tree, node_radii(tree, radii)
        self.start, self.parts = dealt(sizes_of, cell_rows)
        self.cell_sizes = np.bincount(np.repeat(self.start, self.parts) + np.concatenate([np.arange(n) for n in self.parts]), np.repeat(sizes_of / self.parts, self.parts))
        self.upto = np.vstack([np.zeros((1, GROUPS), np.int64), np.cumsum(counts, 0)])  # rows of each group in the leaves before
        leaf_cells = F.broadcast(queries.sparkSession.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(self.start, self.parts, strict=True))], "leaf int, start int, parts int"))
        train = train.join(leaf_cells, "leaf").select("neighbor_id", "neighbor_label", "x", "holds", "leaf", (F.col("start") + F.pmod(F.xxhash64("neighbor_id"), F.col("parts"))).cast("int").alias("cell"))
        first = written(self.searched(queries.withColumn("within", F.lit(float("inf"))), train, False))
        # the k-th distance in the group where it is largest; endless where a group has fewer so far
        kth = _ranked(first, k, self.groups).groupBy("query_id", "g").agg(F.count("*").alias("n"), F.max("distance").alias("d")).groupBy("query_id").agg(F.count("*").alias("groups"), F.min("n").alias("n"), F.sqrt(F.max("d")).alias("d"))
        asked = queries.join(kth, "query_id", "left").withColumn("within", F.when((F.col("groups") == F.bit_count("asks")) & (F.col("n") == k), F.col("d")).otherwise(float("inf"))).drop("groups", "n", "d")
        self.found = first.unionByName(self.searched(asked, train, True))

    def tall(self, visits: int, cells: int) -> int:
        """Tasks that share the visits of a cell, so that none has too many of them, and all slots have work if there are visits enough."""
        return max(1, -(-visits // self.most), min(-(-visits // FEW_VISITS), 2 * self.slots // max(1, cells)))

    def tasks(self, pairs: int, rows: int) -> int:
        """Tasks for so many pairs of a cell and a share of its visits, which read so many rows."""
        return max(1, min(pairs, max(2 * self.slots, -(-rows * self.row_bytes // TASK_BYTES))))

    def visits(self, queries: DataFrame, later: bool) -> DataFrame:
        """queries with the cells that they visit.  First those of the smallest ball on the way down that holds k rows of every group
        asked for, whose leaves are from lo to hi; later the others with a leaf that can hold a row within reach."""
        tree, radii, upto, start, parts, k = self.tree, self.radii, self.upto, self.start, self.parts, self.k
        nodes, cells = tree.leaf_nodes(), int(start[-1] + parts[-1])
        up = np.full(len(tree.centres), -1)
        for at in np.flatnonzero(tree.left >= 0):
            up[[tree.left[at], tree.right[at]]] = at

        def run(batches):
            balls: dict[tuple[int, int], int] = {}

            def ball(leaf: int, asks: int) -> int:
                if (leaf, asks) not in balls:
                    at, want = nodes[leaf], bits(asks)
                    while up[at] >= 0 and (upto[tree.last[at] + 1] - upto[tree.first[at]])[want].min(initial=k) < k:
                        at = up[at]
                    balls[leaf, asks] = at
                return balls[leaf, asks]

            for whole in batches:
                for a in range(0, len(whole), SOME):
                    pdf = whole.iloc[a : a + SOME]
                    x = block(pdf.q)
                    at = np.array([ball(int(leaf), int(asks)) for leaf, asks in zip(tree.down(x)[0], pdf.asks, strict=True)], np.int64)
                    lo, hi = tree.first[at], tree.last[at]
                    begin, end = start[lo], start[hi] + parts[hi]
                    if later:
                        rows, leaf = tree.reached(x, pdf.within.to_numpy(float), radii)
                        n = parts[leaf]
                        cell = np.repeat(start[leaf] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        rows, cell = np.divmod(np.unique(np.repeat(rows, n) * cells + cell), cells)
                        new = (cell < begin[rows]) | (cell >= end[rows])
                        rows, cell = rows[new], cell[new].astype(np.int32)
                        own = np.split(cell, np.searchsorted(rows, np.arange(1, len(x))))
                        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), -1)
                    else:
                        own = [np.arange(b, e, dtype=np.int32) for b, e in zip(begin, end, strict=True)]
                    yield pdf.assign(lo=lo.astype(np.int32), hi=hi.astype(np.int32), cells=own)

        return queries.mapInPandas(run, f"query_id long, q {queries.schema['q'].dataType.simpleString()}, asks long, within double, lo int, hi int, cells array<int>")

    def searched(self, queries: DataFrame, train: DataFrame, later: bool) -> DataFrame:
        spark, asked = queries.sparkSession, written(self.visits(queries.select("query_id", "q", "asks", "within"), later))
        met = {r.cell: r.n for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        plan = [(int(c), self.tall(n, len(met))) for c, n in met.items()]
        cells = F.broadcast(spark.createDataFrame(plan, "cell int, tall int"))
        left = asked.withColumn("cell", F.explode("cells")).drop("cells").join(cells, "cell").withColumn("h", F.pmod(F.xxhash64("query_id"), F.col("tall")).cast("int")).drop("tall")
        right = train.join(cells, "cell").withColumn("h", F.explode(F.expr("sequence(0, tall - 1)"))).drop("tall")
        tasks = self.tasks(sum(t for _, t in plan), sum(met.values()) + int(sum(self.cell_sizes[c] * t for c, t in plan)))
        return _searched(left, right, self.k, self.tree.centres[self.tree.leaf_nodes()], tasks)


def _search(queries: DataFrame, train: DataFrame, k: int, row_id: str, label: str, features: str, sizes, asks: Column, holds: Column) -> Search:
    left = queries.select(F.col(row_id).cast("long").alias("query_id"), F.col(features).alias("q"), asks.cast("long").alias("asks"))
    right = train.select(F.col(row_id).cast("long").alias("neighbor_id"), F.col(label).cast("int").alias("neighbor_label"), F.col(features).alias("x"), holds.cast("long").alias("holds"))
    return Search(left, right, max(1, k), sizes)


def neighbors(queries: DataFrame, train: DataFrame, k: int, row_id: str = "row_id", label: str = "label", features: str = "features", sizes: tuple[int, int] | None = None, group: str | None = None) -> DataFrame:
    """query_id, neighbor_id, neighbor_label, distance (squared) and rank of the k nearest rows; k is held to [1, rows].

    Ties go to the smaller id.  sizes: rows of queries and of train if they are known; else both are counted.  group: an int
    column of both, from 0; then neighbours are looked for among the rows of the query's group, and the result has the
    column too.
    """
    if group is None:
        search = _search(queries, train, k, row_id, label, features, sizes, F.lit(1), F.lit(1))
        return _ranked(search.found, search.k, search.groups).drop("g")
    most = train.agg(F.max(group)).first()[0] or 0
    out = None
    for wave in range(most // GROUPS + 1):
        own = F.floor(F.col(group) / GROUPS) == wave
        bit = F.expr(f"shiftleft(1L, cast(`{group}` % {GROUPS} as int))")
        search = _search(queries.where(own), train.where(own), k, row_id, label, features, None, bit, bit)
        near = _ranked(search.found, search.k, search.groups)
        near = near.withColumn("g", F.col("g") + wave * GROUPS).withColumnRenamed("g", group)
        out = near if out is None else out.unionByName(near)
    return out


def masked_neighbors(rows: DataFrame, k: int, asks: str, holds: str, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """query_id, g, neighbor_id, neighbor_label, distance and rank of the k nearest rows in several groups at once.

    asks and holds: long columns; a row is a query in the groups whose bits asks has, and a training row in those of holds
    (at most GROUPS).  Each distance is computed once, whatever number of groups it counts in.
    """
    search = _search(rows.where(F.col(asks) != 0), rows.where(F.col(holds) != 0), k, row_id, label, features, None, F.col(asks), F.col(holds))
    return _ranked(search.found, search.k, search.groups)


def measured(queries: DataFrame, train: DataFrame, k: int, row_id: str = "row_id", label: str = "label", features: str = "features") -> DataFrame:
    """One row: distances that a search computes, and those of all pairs."""
    search = _search(queries, train, k, row_id, label, features, None, F.lit(1), F.lit(1))
    return search.found.agg(F.sum("looked").alias("computed")).withColumn("pairs", F.lit(queries.count() * train.count()))


def vote_shares(near: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, label, votes and share of the labels among the k nearest."""
    rows = near if k is None else near.where(F.col("rank") <= k)
    votes = rows.groupBy("query_id", F.col("neighbor_label").alias("label")).agg(F.count("*").alias("votes"))
    return votes.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("query_id")))


def vote(near: DataFrame, k: int | None = None) -> DataFrame:
    """query_id and predicted: the commonest label of the k nearest, the smallest of equals."""
    shares = vote_shares(near, k)
    return shares.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("predicted"))


def sweep(near: DataFrame, ks: list[int], group: str | None = None) -> DataFrame:
    """k, query_id and predicted (and group) for several k from one table of neighbours."""
    by = ["k", "query_id", *([group] if group else [])]
    each = near.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(ks))]))).where("rank <= k")
    votes = each.groupBy(*by, F.col("neighbor_label").alias("label")).agg(F.count("*").alias("votes"))
    return votes.groupBy(*by).agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("predicted"))
