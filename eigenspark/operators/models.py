"""A store of fitted models: arrays and settings in versions, found by what they were fitted on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece of an array that is stored as one value.
PIECE = 1 << 20
_SCHEMA = "key string, info string, array string, kind string, shape array<int>, place int, data binary"


def content_digest(df: DataFrame, columns: list[str]) -> str:
    """A digest of the rows' values in some columns, whatever their order, from one pass: their number, and the sum and the
    exclusive or of two hashes of each."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)
    row = df.agg(F.count("*"), F.sum(one.cast("decimal(38, 0)")), F.bit_xor(two), F.sum(two.cast("decimal(38, 0)"))).first()
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    return hashlib.sha1(repr((kinds, *map(str, row))).encode()).hexdigest()


@dataclass(frozen=True)
class Stored:
    """A version of a model: the key of what it was fitted on, its settings, and its arrays by name."""

    version: int
    key: str
    info: dict
    arrays: dict[str, np.ndarray]


class ModelStore:
    """Models by name under a folder that all sessions share; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/version={version}"

    def _all(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_SCHEMA}, version int").parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def versions(self, name: str) -> dict[int, str]:
        """The key of each version."""
        rows = self._all(name)
        return {} if rows is None else {r.version: r.key for r in sorted(rows.select("version", "key").distinct().collect())}

    def save(self, name: str, key: str, info: dict, arrays: dict[str, np.ndarray]) -> int:
        """The number of the new version."""
        version, rows = max(self.versions(name), default=0) + 1, []
        for label, x in {"": np.empty(0), **arrays}.items():  # the first row holds the settings also where there is no array
            data = np.ascontiguousarray(x).tobytes()
            rows += [(key, json.dumps(info, sort_keys=True), label, x.dtype.str, list(x.shape), i, data[a : a + PIECE]) for i, a in enumerate(range(0, max(1, len(data)), PIECE))]
        self.spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")]), _SCHEMA).coalesce(1).write.parquet(self.path(name, version))
        return version

    def load(self, name: str, version: int | None = None) -> Stored | None:
        """A version, by default the last; None if there is none."""
        versions = self.versions(name)
        version = max(versions, default=0) if version is None else version
        if version not in versions:
            return None
        rows = sorted(self.spark.read.schema(_SCHEMA).parquet(self.path(name, version)).collect(), key=lambda r: (r.array, r.place))
        data: dict[str, tuple] = {}
        for r in rows:
            data.setdefault(r.array, (r.kind, r.shape, []))[2].append(bytes(r.data))
        arrays = {k: np.frombuffer(b"".join(d), np.dtype(t)).reshape(shape).copy() for k, (t, shape, d) in data.items() if k}
        return Stored(version, rows[0].key, json.loads(rows[0].info), arrays)

    def find(self, name: str, key: str) -> Stored | None:
        """The last version that was fitted on this."""
        own = [v for v, k in self.versions(name).items() if k == key]
        return self.load(name, max(own)) if own else None
