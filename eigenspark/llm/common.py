"""Small helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
BLANK = r"[\x20\x09-\x0D]+"


#: Bytes of a batch that goes to Python, unless the session says something else.
BATCH_BYTES = 6 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed (local mode, tests), and bounds their batches."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":  # the default
        spark.conf.set(size, BATCH_BYTES)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Without either, a new folder in /tmp, in local mode only; an error on a cluster, whose machines don't share it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, prefix: str = "") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{prefix}{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored under a path."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared checkpoint folder; sets one only where the session names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared checkpoint folder: smaller than checkpoint() for many rows."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None, least: int = 100) -> DataFrame | None:
    """Keys that more than 1 / (16 * partitions) of the rows have (and more than `least`), with their count `_n`.

    There are fewer than 16 * partitions such keys, so they can be collected and broadcast; None if there are none.
    """
    total = rows.count() if total is None else total
    if total <= least:
        return None
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, total / (16 * partitions(rows))))
    return local(found)


def local(found: DataFrame) -> DataFrame | None:
    """A table of a proven size as one that is sent along with the plan; None if it is empty."""
    got = found.collect()
    return found.sparkSession.createDataFrame(got, found.schema) if got else None


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row for each key; rows of hot keys (hot_keys) meet theirs by broadcast.

    So no task gets all rows of a hot key.
    """
    if hot is None:
        return rows.join(table, keys, how)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    few = table.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    at_once = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, how)
    return at_once.unionByName(marked.where("_hot is null").drop("_hot").join(table, keys, how))


def widened(df: DataFrame, more: str) -> T.StructType:
    """The schema of df followed by the columns of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def blank_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3; 1 marks the held-out rows."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(1))


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# Hashes of words and of runs of words, over many texts at once.

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


#: Powers that a task keeps from slice to slice inside `kept_powers`, at most: 16 MB for each base.
_KEPT_POWERS = 1 << 21
_kept: dict[int, np.ndarray] | None = None


@contextmanager
def kept_powers():
    """Inside, powers are computed once for all slices of a task; afterwards an idle worker holds none of them."""
    global _kept
    _kept = {}
    try:
        yield
    finally:
        _kept = None


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2**64."""
    base &= 0xFFFFFFFFFFFFFFFF
    out = None if _kept is None else _kept.get(base)
    if out is None or len(out) < n:
        size = n if _kept is None or n > _KEPT_POWERS else 1 << max(12, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if _kept is not None and size <= _KEPT_POWERS:
            _kept[base] = out
    return out[:n]


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))


#: Odd multipliers, so that they have inverses modulo 2**64.
_SEEDS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_VALUES = [_byte_values(s) for s, _ in _SEEDS]


class Words:
    """Words of a batch of UTF-8 texts: places of each in the joined bytes, and the number of words of each text."""

    def __init__(self, texts: list[bytes], keep: np.ndarray):
        """keep[b] is true for the bytes of words."""
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = keep[self.data]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; which: one of two independent ones."""
        n = len(self.data)
        base = _SEEDS[which][1]
        sums = np.zeros(n + 1, np.uint64)
        value = _VALUES[which][self.data]
        value *= _powers(base, max(n, 1))[:n]
        np.cumsum(value, out=sums[1:])
        del value
        back = _powers(pow(base, -1, 2**64), max(n, 1))
        length = (self.end - self.start).astype(np.uint64)
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + length * np.uint64(0x632BE59BD9B4E019))


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of so many consecutive words, by its first word; len(words) - length + 1 of them."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, m = np.zeros(n, np.uint64), np.uint64(_SEEDS[1 - which][1])
    for i in range(length):
        out *= m
        out += words[i : i + n]
    return mix(out)


#: Characters whose words are hashed at once: a few dozen bytes of memory for each.
SLICE = 500_000

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def slices(texts, limit: int = SLICE, rows: int = 4096):
    """(first, last) of runs of at most so many rows whose texts hold about so many characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > limit or i - first >= rows):
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
