"""Decoded images that are kept from run to run and follow their files.

A store has one folder of features for each time that something was decoded, and one manifest for each state: path, stamp,
digest and the folder that holds the features.  The stamp of a file is its length and time, that of an archive's member its
length and checksum, which archives list; a listing so tells what is new, changed or gone, and only what is new or changed
is read.  A state is never overwritten, so whoever reads an older one isn't disturbed.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, stamp string, digest string, held int"
FEATURES = "path string, stamp string, digest string, height int, width int, raw_height int, raw_width int, features array<float>"
#: Names are broadcast up to so many; beyond that they are joined by a shuffle.
SMALL = 200_000


class ImageStore:
    """The store of images that are prepared in one way, of any files; settings: all that features depend on."""

    def __init__(self, spark: SparkSession, folder: str, *settings):
        self.spark = spark
        self.at = f"{folder}/{hashlib.sha1(repr(settings).encode()).hexdigest()[:12]}"

    def version(self) -> int:
        """The number of the last state; 0 if there is none."""
        try:
            return self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.at}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, stamp, digest and held of a state, by default the last one."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.at}/manifest/version={version}")

    def update(self, listed: DataFrame, wanted: DataFrame, decode) -> DataFrame:
        """The manifest after a look at the files: `decode` is called for the rows of `wanted` that aren't held.

        listed and wanted: path and stamp, and what decode needs; decode gives the columns of FEATURES.  Images that are
        no longer listed as they were are dropped.
        """
        number, keys = self.version(), ["path", "stamp"]
        old = self.manifest(number)
        live = old.join(listed.select(*keys), keys, "left_semi")
        new = wanted.join(old.select(*keys), keys, "left_anti")
        more = new.count()
        if more == 0 and live.count() == old.count():
            return old
        if more:
            decode(new).select(*[c.split()[0] for c in FEATURES.split(", ")]).write.parquet(f"{self.at}/features/version={number + 1}")
            live = live.unionByName(self.features(number + 1).select(*keys, "digest", F.lit(number + 1).alias("held")))
        live.write.parquet(f"{self.at}/manifest/version={number + 1}")
        return self.manifest(number + 1)

    def features(self, version: int) -> DataFrame:
        return self.spark.read.schema(FEATURES).parquet(f"{self.at}/features/version={version}")

    def read(self, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
        """wanted with the columns of FEATURES for each row that the manifest holds."""
        own = wanted.join(manifest.select("path", "stamp", "held"), ["path", "stamp"])
        folders = [r.held for r in own.select("held").distinct().collect()]
        if not folders:
            return wanted.limit(0).join(self.spark.createDataFrame([], FEATURES), ["path", "stamp"])
        kept = self.spark.read.schema(f"{FEATURES}, version int").option("basePath", f"{self.at}/features").parquet(*[f"{self.at}/features/version={v}" for v in folders])
        own = F.broadcast(own) if own.count() <= SMALL else own
        return kept.withColumnRenamed("version", "held").join(own, ["path", "stamp", "held"]).drop("held")

    def compact(self) -> int:
        """Writes all that the last manifest holds to one folder, as a state of its own; the number of that state."""
        number, held = self.version(), self.manifest()
        rows = self.read(held, held.select("path", "stamp"))
        rows.select(*[c.split()[0] for c in FEATURES.split(", ")]).write.parquet(f"{self.at}/features/version={number + 1}")
        self.features(number + 1).select("path", "stamp", "digest", F.lit(number + 1).alias("held")).write.parquet(f"{self.at}/manifest/version={number + 1}")
        return number + 1
