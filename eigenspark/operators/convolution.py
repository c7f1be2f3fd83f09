"""A small convolutional network, trained by data-parallel steps.

The rows of a mini-batch come from all parts of the training rows, and lie in a fixed number of lanes.  An epoch deals the
rows out by step and lane once; every step is a job on the lanes of that step alone, which give their gradients, and the
driver adds these up in order and makes the step.  The driver has the weights, a gradient of each lane and the history only;
a lost executor repeats a step.  The network: blocks of a 3 x 3 convolution, a rectifier and 2 x 2 pooling, then averages
over a grid and a dense layer.
"""

from __future__ import annotations

import gc
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .linalg import block
from .svm import packed_parts

#: Fixed values of the training: rows of a step, epochs, rate, decay of weights, longest gradient, waits, and the fall of the rate.
BATCH, EPOCHS, RATE, DECAY, CLIP, PATIENCE = 64, 20, 3e-4, 1e-4, 2.0, 6
FALL, WAIT = 0.5, 2
#: Usual constants of the optimiser, and the least relative gain that counts as one for the rate.
MEAN, SQUARE, SMALL, GAIN = 0.9, 0.999, 1e-8, 1e-4
#: Images whose layers are computed at once.
AT_ONCE = 256
#: Shares of a mini-batch that are computed apart, at most, and pixels of one, about; steps whose rows lie together, at least, and
#: such chunks of an epoch, at most.
LANES, LANE_PIXELS, CHUNK, CHUNKS = 16, 4096, 16, 64


def windows(x: np.ndarray) -> np.ndarray:
    """The 3 x 3 neighbourhoods of each pixel, with zeros around: n, channels, height, width, 3, 3."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))


def averages(size: int, cells: int) -> np.ndarray:
    """A matrix that averages so many places over cells of equal reach."""
    out = np.zeros((cells, size))
    for i in range(cells):
        a, b = i * size // cells, -(-(i + 1) * size // cells)
        out[i, a:b] = 1 / (b - a)
    return out


def initial(height: int, width: int, classes: int, widths: tuple[int, ...], grid: int, seed: int) -> list[np.ndarray]:
    """Weights and biases of the blocks and of the dense layer."""
    rng, before, out = np.random.default_rng(seed), 1, []
    for c in widths:
        out += [rng.normal(size=(c, before, 3, 3)) * np.sqrt(2 / (9 * before)), np.zeros(c)]
        before, height, width = c, height // 2, width // 2
    if not height or not width:
        raise ValueError("more blocks than the images can be halved")
    n = before * min(grid, height) * min(grid, width)
    return [*out, rng.normal(size=(classes, n)) * np.sqrt(1 / n), np.zeros(classes)]


def forward(params: list[np.ndarray], x: np.ndarray, grid: int) -> tuple[np.ndarray, list]:
    """Scores of the classes, and what the way back needs."""
    kept = []
    for w, b in zip(params[:-2:2], params[1:-2:2], strict=True):
        near = windows(x)
        z = np.tensordot(near, w, axes=([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2) + b[:, None, None]
        n, c, h, v = z.shape
        cells = np.maximum(z, 0.0)[:, :, : h // 2 * 2, : v // 2 * 2].reshape(n, c, h // 2, 2, v // 2, 2)
        x = cells.max((3, 5))
        kept.append((near, z, cells, x))
    down, across = averages(x.shape[2], min(grid, x.shape[2])), averages(x.shape[3], min(grid, x.shape[3]))
    flat = (down @ x @ across.T).reshape(len(x), -1)
    kept.append((flat, down, across))
    return flat @ params[-2].T + params[-1], kept


def backward(params: list[np.ndarray], kept: list, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of the parameters from those of the scores."""
    flat, down, across = kept[-1]
    out = [slope.sum(0), slope.T @ flat]
    channels = params[-2].shape[1] // (len(down) * len(across))
    d = down.T @ (slope @ params[-2]).reshape(len(slope), channels, len(down), len(across)) @ across
    for at in range(len(kept) - 2, -1, -1):
        near, z, cells, x = kept[at]
        most = cells == x[:, :, :, None, :, None]
        share = most * (d / most.sum((3, 5)))[:, :, :, None, :, None]  # equal largest pixels share
        back = np.zeros_like(z)
        n, c, h, _, v, _ = cells.shape
        back[:, :, : 2 * h, : 2 * v] = share.reshape(n, c, 2 * h, 2 * v)
        back *= z > 0
        out += [back.sum((0, 2, 3)), np.tensordot(back, near, axes=([0, 2, 3], [0, 2, 3]))]
        if at:
            w = params[2 * at][:, :, ::-1, ::-1]
            d = np.tensordot(windows(back), w, axes=([1, 4, 5], [0, 2, 3])).transpose(0, 3, 1, 2)
    return out[::-1]


def losses(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each row, and its gradient in the scores."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    share = e / e.sum(1, keepdims=True)
    slope = share.copy()
    slope[np.arange(len(y)), y] -= 1
    return -np.log(np.maximum(share[np.arange(len(y)), y], 1e-300)), slope


@dataclass
class Steps:
    """Parameters and the state of the optimiser: running means of gradients and of their squares, with decay of weights aside."""

    params: list[np.ndarray]
    mean: list[np.ndarray]
    square: list[np.ndarray]
    done: int = 0

    def take(self, gradients: list[np.ndarray], rate: float, decay: float, clip: float) -> None:
        length = float(np.sqrt(sum((g**2).sum() for g in gradients)))
        shorter = min(1.0, clip / (length + 1e-6))
        self.done += 1
        for i, g in enumerate(gradients):
            g = g * shorter
            self.mean[i] = MEAN * self.mean[i] + (1 - MEAN) * g
            self.square[i] = SQUARE * self.square[i] + (1 - SQUARE) * g * g
            step = self.mean[i] / (1 - MEAN**self.done) / (np.sqrt(self.square[i] / (1 - SQUARE**self.done)) + SMALL)
            self.params[i] = self.params[i] * (1 - rate * decay) - rate * step


@dataclass(frozen=True)
class ConvNet:
    """A trained network for images of one shape; history: epoch, rate, train_loss, train_accuracy, loss and accuracy."""

    params: list[np.ndarray]
    shape: tuple[int, int]
    grid: int
    mean: float
    deviation: float
    epoch: int
    history: DataFrame

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = ((x - self.mean) / self.deviation).reshape(-1, 1, *self.shape)
        return np.concatenate([np.zeros((0, len(self.params[-1]))), *(forward(self.params, x[a : a + AT_ONCE], self.grid)[0] for a in range(0, len(x), AT_ONCE))])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds predicted and confidence, the largest of the class probabilities."""
        net = replace(self, history=None)  # what travels

        @F.pandas_udf("predicted int, confidence double")
        def run(x: pd.Series) -> pd.DataFrame:
            s = net.scores(block(x)) if len(x) else np.zeros((0, len(net.params[-1])))
            e = np.exp(s - s.max(1, keepdims=True, initial=-np.inf))
            return pd.DataFrame({"predicted": s.argmax(1).astype(np.int32), "confidence": (e / e.sum(1, keepdims=True)).max(1, initial=0.0)})

        out = df.withColumn("_out", run(features))
        return out.withColumn("predicted", F.col("_out.predicted")).withColumn("confidence", F.col("_out.confidence")).drop("_out")


def evaluated(df: DataFrame, net: ConvNet, features: str, label: str) -> tuple[float, float]:
    """Loss and accuracy over the rows of df, from those of batches by their sizes."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                s, y = net.scores(block(pdf["_x"])), pdf["_y"].to_numpy(int)
                yield pd.DataFrame({"loss": [float(losses(s, y)[0].mean())], "right": [int((s.argmax(1) == y).sum())], "n": [len(y)]})

    parts = df.select(F.col(features).alias("_x"), F.col(label).cast("int").alias("_y")).mapInPandas(run, "loss double, right long, n long")
    got = metrics.weighted_scores(parts).first()
    return got.loss, got.accuracy


def _moments(parts: DataFrame) -> tuple[dict[int, int], float, float]:
    """Rows of each part, and the mean and deviation of all features of all rows (1 for one below 1e-6), added up in the order of parts."""

    def run(batches):
        for pdf in batches:
            x = [np.frombuffer(v) for v in pdf["x"]]
            yield pd.DataFrame({"part": pdf["part"], "n": pdf["n"], "m": [v.mean() for v in x], "s": [float(((v - v.mean()) ** 2).sum()) for v in x], "size": [len(v) for v in x]})

    got = sorted(parts.mapInPandas(run, "part int, n int, m double, s double, size long").collect())  # five numbers for each part
    if not got:
        raise ValueError("no training rows")
    whole = sum(r.size for r in got)
    mean = sum(r.m * r.size for r in got) / whole
    deviation = float(np.sqrt(sum(r.s + r.size * (r.m - mean) ** 2 for r in got) / whole))
    return {r.part: r.n for r in got}, float(mean), deviation if deviation >= 1e-6 else 1.0


@dataclass(frozen=True)
class Batches:
    """The mini-batches of an epoch.  share: rows of each part in a step; lanes: a part's lane is its number modulo these."""

    seed: int
    epoch: int
    steps: int
    share: dict[int, int]
    lanes: int
    shape: tuple[int, int]
    vary: object

    def of_part(self, part: int, x: bytes, y: bytes):
        """(step, images, labels) of the rows of a part."""
        labels = np.frombuffer(y, np.int32)
        x, n = np.frombuffer(x).reshape(len(labels), -1), self.share[part]
        order = np.random.default_rng([self.seed, self.epoch, part]).permutation(len(labels))
        for step in range(min(self.steps, -(-len(order) // n))):
            pick = order[step * n : (step + 1) * n]
            image = x[pick].reshape(-1, *self.shape)
            if self.vary is not None:
                rng = np.random.default_rng([self.seed, self.epoch, part, step])
                image = np.stack([self.vary(i, rng) for i in image])
            yield step, image, labels[pick]


def lane_gradients(params: list[np.ndarray], rows: list[tuple[int, np.ndarray, np.ndarray]], mean: float, deviation: float, grid: int) -> tuple[int, float, int, list[np.ndarray]]:
    """Rows, their loss, those classified rightly, and the gradients, of a lane's (part, images, labels)."""
    rows = sorted(rows, key=lambda r: r[0])
    x, y = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    scores, kept = forward(params, ((x - mean) / deviation)[:, None], grid)
    each, slope = losses(scores, y)
    return len(y), float(each.sum()), int((scores.argmax(1) == y).sum()), backward(params, kept, slope)


def stepped(state: Steps, lanes: list[tuple], rate: float, decay: float, clip: float) -> tuple[float, int]:
    """Makes a step by the gradients of the lanes, in their order; the loss and the right answers."""
    n = sum(v[0] for v in lanes)
    if n:
        state.take([sum(g[1:], g[0]) / n for g in zip(*(v[3] for v in lanes), strict=True)], rate, decay, clip)
    return sum(v[1] for v in lanes), sum(v[2] for v in lanes)


def fit_convnet(train: DataFrame, validation: DataFrame, classes: int, shape: tuple[int, int], widths: tuple[int, ...] = (16, 32), grid: int = 4, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, clip: float = CLIP, patience: int = PATIENCE, vary=None, tasks: int | None = None, features: str = "features", label: str = "label", row_id: str = "row_id", seed: int = 42) -> ConvNet:
    """A network for `train`, of the epoch that does best on `validation`; training stops after `patience` epochs without a gain.

    Features are standardised by the mean and deviation over all of train.  Steps are AdamW with gradients of a length of
    `clip` at most; the rate falls by FALL where the loss on validation hasn't gained for over WAIT epochs.  vary: makes
    a varied copy of an image (2-d) from it and a generator, for each use of it in training.  tasks: those that hold the
    rows, by default as many as there are parts of rows and slots; a single one makes all steps of an epoch by itself.
    Neither order nor partitions matter.
    """
    spark = train.sparkSession
    parts = packed_parts(train, features, label, row_id, seed).select("part", "n", "x", "y").persist()
    validation = validation.select(features, label).persist()
    try:
        counts, mean, deviation = _moments(parts)
        rows = sum(counts.values())
        tasks = max(1, min(len(counts), tasks or spark.sparkContext.defaultParallelism))
        params = initial(*shape, classes, widths, grid, seed)
        state = Steps(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])
        steps, share = -(-rows // batch), {k: -(-batch * n // rows) for k, n in counts.items()}
        lanes = max(1, min(LANES, len(counts), batch * shape[0] * shape[1] // LANE_PIXELS))
        history, nets, least, waited, best, since = [], {}, np.inf, 0, None, 0
        for epoch in range(1, epochs + 1):
            batches = Batches(seed, epoch, steps, share, lanes, shape, vary)
            if tasks > 1:
                loss_sum, right = _epoch_of_jobs(parts.repartition(tasks, "part"), batches, state, mean, deviation, grid, rate, decay, clip)
            else:
                state, loss_sum, right = _epoch_of_a_task(parts.coalesce(1), batches, state, mean, deviation, grid, rate, decay, clip)
            net = ConvNet(list(state.params), shape, grid, mean, deviation, epoch, None)
            loss, accuracy = evaluated(validation, net, features, label)
            history.append((epoch, rate, loss_sum / rows, right / rows, loss, accuracy))
            if best is None or (accuracy, -loss) > best:
                best, since, nets = (accuracy, -loss), 0, {epoch: net}
            else:
                since += 1
            if loss < least * (1 - GAIN):
                least, waited = loss, 0
            else:
                waited += 1
                if waited > WAIT:
                    rate, waited = rate * FALL, 0
            if since >= patience:
                break
    finally:
        parts.unpersist()
        validation.unpersist()
    table = spark.createDataFrame(history, "epoch int, rate double, train_loss double, train_accuracy double, loss double, accuracy double")
    chosen = metrics.best_epoch(table, patience).first().epoch
    return ConvNet(nets[chosen].params, shape, grid, mean, deviation, chosen, table)


def _epoch_of_jobs(parts: DataFrame, batches: Batches, state: Steps, mean: float, deviation: float, grid: int, rate: float, decay: float, clip: float) -> tuple[float, int]:
    """All steps of an epoch, changing state: rows are dealt out by chunk of steps and lane, and a step is a job on the lanes of its chunk."""
    context, lanes = parts.sparkSession.sparkContext, batches.lanes
    chunk = max(CHUNK, -(-batches.steps // CHUNKS))
    chunks = -(-batches.steps // chunk)

    def deal(rows):
        for r in rows:
            for step, image, y in batches.of_part(int(r.part), r.x, r.y):
                yield step // chunk * lanes + r.part % lanes, (step, int(r.part), image, y)

    dealt = parts.rdd.mapPartitions(deal).partitionBy(chunks * lanes, int).persist()
    loss = right = 0
    try:
        for step in range(batches.steps):
            params = state.params

            def gradients(rows, step=step, params=params):
                if not gc.get_freeze_count():
                    gc.freeze()  # workers collect garbage after every task, which takes longer than a step with all modules in it
                own = [r[1:] for _, r in rows if r[0] == step]
                return [lane_gradients(params, own, mean, deviation, grid)] if own else []

            first = step // chunk * lanes
            more, good = stepped(state, context.runJob(dealt, gradients, list(range(first, first + lanes))), rate, decay, clip)
            loss, right = loss + more, right + good
    finally:
        dealt.unpersist()
    return float(loss), right


def _epoch_of_a_task(parts: DataFrame, batches: Batches, state: Steps, mean: float, deviation: float, grid: int, rate: float, decay: float, clip: float) -> tuple[Steps, float, int]:
    """The state after all steps of an epoch, the loss and the right answers; for rows that one task holds."""

    def run(pdfs):
        own = Steps(list(state.params), list(state.mean), list(state.square), state.done)
        mine = [(int(r.part), batches.of_part(int(r.part), r.x, r.y)) for pdf in pdfs for r in pdf.itertuples()]
        loss = right = 0
        for step in range(batches.steps):
            given: dict[int, list] = {}
            for k, turns in mine:
                if (turn := next(turns, None)) is not None:
                    given.setdefault(k % batches.lanes, []).append((k, *turn[1:]))
            more, good = stepped(own, [lane_gradients(own.params, given[v], mean, deviation, grid) for v in sorted(given)], rate, decay, clip)
            loss, right = loss + more, right + good
        yield pd.DataFrame({"state": [pickle.dumps(own)], "loss": [float(loss)], "right": [right]})

    got = parts.mapInPandas(run, "state binary, loss double, right long").collect()[0]  # one row
    return pickle.loads(got.state), got.loss, got.right  # noqa: S301  made above
