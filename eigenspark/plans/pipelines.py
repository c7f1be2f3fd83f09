"""Fitted pipelines that other sessions use: preprocessing, components, weights and names, stored in versions.

A pipeline is found by the contents of the rows that it was fitted on, its family and setting; the same rows in any layout
find it again, and other rows make a new version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.families import FAMILIES, NeighborModel
from ..operators.models import ModelStore, content_digest
from ..sources import images
from ..sources.sinks import submission
from ..streaming.scoring import predicted_stream

#: Labels that are named in a pipeline, at most; more are an error, not a cut.
NAMES = 100_000


@dataclass(frozen=True)
class Pipeline:
    """A family's fitted model with the preparation of its images and the names of its labels.

    version: in the store; fresh: whether it was fitted just now rather than found.
    """

    family: str
    setting: dict
    classes: int
    names: dict[int, str]
    size: tuple[int, int] | None
    how: str
    model: object
    version: int = 0
    fresh: bool = False

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows (with row_id and features) with predicted and predicted_name."""
        return self.named(self.model.transform(rows))

    def named(self, rows: DataFrame) -> DataFrame:
        if not self.names:
            return rows.withColumn("predicted_name", F.lit(None).cast("string"))
        table = rows.sparkSession.createDataFrame(sorted(self.names.items()), "predicted int, predicted_name string")
        return rows.join(F.broadcast(table), "predicted", "left")

    def images(self, spark: SparkSession, path: str | list[str], **how) -> DataFrame:
        """The images under a path, prepared as those that the pipeline was fitted on, with predicted and predicted_name."""
        return self.transform(images.read_images(spark, path, self.size, how=self.how, **how))

    def image(self, spark: SparkSession, path: str) -> DataFrame:
        """One image, a file or archive.zip/member, with predicted and predicted_name."""
        return self.transform(images.read_image(spark, path, self.size, self.how).withColumn("row_id", F.lit(0).cast("long")))

    def stream(self, spark: SparkSession, path: str) -> DataFrame:
        """path, predicted and predicted_name of each new image under a directory.  Neighbours can't be searched in a stream: an error."""
        if isinstance(self.model, NeighborModel):
            raise ValueError("a stream needs a model that is fitted, not neighbours")
        return self.named(predicted_stream(spark, path, self.model, self.size, self.how))

    def submission(self, rows: DataFrame) -> DataFrame:
        """Paths with true and predicted names."""
        return submission(self.model.transform(rows), rows.sparkSession.createDataFrame(sorted(self.names.items()), "label int, name string"))


def _key(rows: DataFrame, classes: int, family: str, setting: dict, size, how: str) -> str:
    named = ["name"] if "name" in rows.columns else []
    return f"{content_digest(rows, ['row_id', 'label', 'features', *named])}-{images.VERSION}-{classes}-{family}-{sorted(setting.items())}-{size}-{how}"


def stored_pipeline(rows: DataFrame, classes: int, family: str, setting: dict, folder: str, name: str, size: tuple[int, int] | None = None, how: str = "zscore") -> Pipeline:
    """The pipeline `name` in the store under a folder for these rows: found if one was fitted on them, else fitted and stored.

    rows: row_id, label, features and perhaps name; size and how: the preparation that they went through.
    """
    spark, store = rows.sparkSession, ModelStore(rows.sparkSession, folder)
    key = _key(rows, classes, family, setting, size, how)
    if (kept := store.find(name, key)) is not None:
        return loaded_pipeline(spark, folder, name, kept.version)
    names = {}
    if "name" in rows.columns:
        got = rows.select("label", "name").distinct().limit(NAMES + 1).collect()
        if len(got) > NAMES:
            raise ValueError(f"more than {NAMES} named labels")
        names = {r.label: r["name"] for r in got}
    model = FAMILIES[family].fit(rows, setting, classes)
    version = max(store.versions(name), default=0) + 1
    if isinstance(model, NeighborModel):
        model.rows.write.parquet(f"{folder}/{name}-rows/version={version}")
    info = {"family": family, "setting": setting, "classes": classes, "names": {str(k): v for k, v in names.items()}, "size": size, "how": how}
    store.save(name, key, info, model.arrays)
    return Pipeline(family, setting, classes, names, size, how, model, version, True)


def loaded_pipeline(spark: SparkSession, folder: str, name: str, version: int | None = None) -> Pipeline:
    """A stored pipeline, by default its last version; an error if there is none."""
    kept = ModelStore(spark, folder).load(name, version)
    if kept is None:
        raise FileNotFoundError(f"{folder}/{name}: no pipeline" + ("" if version is None else f" of version {version}"))
    i = kept.info
    family = FAMILIES[i["family"]]
    rows = None if kept.arrays else spark.read.parquet(f"{folder}/{name}-rows/version={kept.version}")
    names = {int(k): v for k, v in i["names"].items()}
    return Pipeline(i["family"], i["setting"], i["classes"], names, tuple(i["size"]) if i["size"] else None, i["how"], family.restored(i["setting"], kept.arrays, rows), kept.version)
