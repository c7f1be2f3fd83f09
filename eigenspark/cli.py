"""python -m eigenspark.cli a|b|d PATH [options]: the three analyses of a labelled image set."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import convolution, families, sampling, selection
from .plans import parts, pipelines
from .sources import images


#: Names of options are fixed values.
def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eigenspark")
    p.add_argument("part", choices=("a", "b", "d", "submit", "variance", "fit", "predict", "network"))
    p.add_argument("dataset")
    p.add_argument("--image-height", type=int)
    p.add_argument("--image-width", type=int)
    p.add_argument("--max-images", type=int)
    p.add_argument("--max-images-per-person", type=int, default=0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--models", nargs="*", default=None, help=", ".join(families.FAMILIES))
    p.add_argument("--validation-ratio", type=float, default=0.2)
    p.add_argument("--outer-folds", type=int, default=5)
    p.add_argument("--inner-folds", type=int, default=3)
    p.add_argument("--component-grid", type=int, nargs="*", default=list(selection.COMPONENTS))
    p.add_argument("--knn-neighbors", type=int, nargs="*", default=list(selection.NEIGHBORS))
    p.add_argument("--svm-reg-grid", type=float, nargs="*", default=list(selection.SVM_REG))
    p.add_argument("--svm-epochs-grid", type=int, nargs="*", default=list(selection.SVM_EPOCHS))
    p.add_argument("--svm-learning-rate-grid", type=float, nargs="*", default=list(selection.SVM_RATES))
    p.add_argument("--family", default="knn", help="model of submit and fit: " + ", ".join(families.FAMILIES))
    p.add_argument("--setting", nargs="*", default=["k=1"], metavar="NAME=VALUE", help="its setting")
    p.add_argument("--cache", default="image_cache", help="folder of stored datasets")
    p.add_argument("--store", default="model_store", help="folder of stored pipelines")
    p.add_argument("--name", default="pipeline", help="name of the pipeline that fit stores and predict uses")
    p.add_argument("--no-cache", action="store_true")
    network = p.add_argument_group("network")
    network.add_argument("--image-size", type=int, nargs=2, metavar=("HEIGHT", "WIDTH"))
    network.add_argument("--val-ratio", type=float, default=parts.VALIDATION)
    network.add_argument("--test-ratio", type=float, default=parts.TEST)
    network.add_argument("--batch-size", type=int, default=convolution.BATCH)
    network.add_argument("--epochs", type=int, default=convolution.EPOCHS)
    network.add_argument("--learning-rate", type=float, default=convolution.RATE)
    network.add_argument("--weight-decay", type=float, default=convolution.DECAY)
    network.add_argument("--patience", type=int, default=convolution.PATIENCE)
    network.add_argument("--disable-augmentation", action="store_true")
    network.add_argument("--dry-run", action="store_true", help="read and split the images only")
    p.add_argument("--quiet", action="store_true", help="print nothing but the result")
    p.add_argument("--rows", type=int, default=100, help="rows of the result that are shown")
    p.add_argument("--output", help="folder for a CSV result")
    return p


def setting_of(pairs: list[str]) -> dict:
    """A setting from texts like n_components=50."""
    return {k: float(v) if set(v) & set(".e") else int(v) for k, v in (p.split("=", 1) for p in pairs)}


def main(argv: list[str] | None = None) -> None:
    a = options().parse_args(argv)
    spark = SparkSession.builder.appName("eigenspark").getOrCreate()
    if a.quiet:
        spark.sparkContext.setLogLevel("ERROR")
    cache = None if a.no_cache else a.cache
    size = tuple(a.image_size) if a.image_size else images.image_size(a.image_height, a.image_width)
    if a.part == "predict":
        found = pipelines.loaded_pipeline(spark, a.store, a.name)
        out = found.images(spark, a.dataset, max_images=a.max_images, max_per_class=a.max_images_per_person, seed=a.seed, cache=cache).select("path", "name", "predicted_name")
        return shown(out, a)
    rows = images.read_images(spark, a.dataset, size, a.max_images, a.max_images_per_person, a.seed, how="minmax" if a.part == "network" else "zscore", cache=cache).persist()
    if not a.quiet:
        print(f"{rows.count()} images")
    classes = rows.select("label").distinct().count() if a.part == "a" else int(rows.selectExpr("max(label)").first()[0]) + 1
    grids = {"components": a.component_grid, "ks": a.knn_neighbors, "regs": a.svm_reg_grid, "epochs": a.svm_epochs_grid, "rates": a.svm_learning_rate_grid}
    if a.part == "a":
        out = parts.summary(rows)
    elif a.part == "b":
        out = parts.comparison(rows, classes, a.models, a.validation_ratio, a.seed, **grids)
    elif a.part == "d":
        out = parts.nested_selection(rows, classes, a.models, a.outer_folds, a.inner_folds, a.seed, **grids).summary
    elif a.part == "submit":
        out = parts.submitted(rows, classes, families.family_names([a.family])[0], setting_of(a.setting))
    elif a.part == "network" and a.dry_run:
        out = parts.split_report(sampling.three_way_split(rows, a.val_ratio, a.test_ratio, seed=a.seed))
    elif a.part == "network":
        out = parts.network(rows, classes, a.val_ratio, a.test_ratio, not a.disable_augmentation, a.seed, epochs=a.epochs, batch=a.batch_size, rate=a.learning_rate, decay=a.weight_decay, patience=a.patience).report()
    elif a.part == "fit":
        found = pipelines.stored_pipeline(rows, classes, families.family_names([a.family])[0], setting_of(a.setting), a.store, a.name, size)
        out = spark.createDataFrame([(a.name, found.version, found.fresh)], "name string, version int, fitted boolean")
    else:
        out = parts.variance_report(rows)
    shown(out, a)


def shown(out: DataFrame, a: argparse.Namespace) -> None:
    if a.output:
        out.write.mode("overwrite").option("header", True).csv(a.output)
    else:
        out.show(a.rows, False)


if __name__ == "__main__":
    main()
