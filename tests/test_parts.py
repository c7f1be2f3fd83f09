import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenspark import cli
from eigenspark.plans import parts, pipelines
from eigenspark.sources import images


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = np.repeat(np.arange(3), 16)
    x = rng.normal(size=(48, 6)) * 0.3 + 3 * np.eye(6)[y]
    data = [(i, f"p{c}_i{i}.pgm", f"person_{c}", int(c), 2, 3, v.tolist(), 4, 3) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "row_id long, path string, name string, label int, height int, width int, features array<double>, raw_height int, raw_width int").persist()


def test_summary(rows):
    assert parts.summary(rows).first().asDict() == {"n_samples": 48, "n_classes": 3, "n_features": 6, "min_class_count": 16, "max_class_count": 16, "original_shape": "4 x 3", "processed_shape": "2 x 3"}


def test_comparison(rows):
    tuned = parts.comparison(rows, 3, ["nearest_class_mean", "knn"], components=(1, 2, 3), ks=(1, 3))
    assert tuned.count() == 5
    best = {r.model: r for r in parts.best_of(tuned).collect()}
    assert best["knn"].setting == "k=1" and best["nearest_class_mean"].validation_accuracy == 1


def test_nested_selection(rows):
    got = parts.nested_selection(rows, 3, ["linear_least_squares", "nearest_class_mean"], 2, 2, components=(2, 4))
    assert got.folds.count() == 4 and got.family in ("linear_least_squares", "nearest_class_mean") and got.model is not None
    assert got.model.transform(rows).where("label = predicted").count() > 45
    knn = parts.nested_selection(rows, 3, ["knn"], 2, 2)
    assert knn.model.transform(rows).where("label = predicted").count() > 45 and knn.setting in ({"k": 1}, {"k": 3}, {"k": 5})


def test_displayed(rows):
    first = parts.displayed(rows, 3).collect()
    assert [r.path for r in first] == sorted(r.path for r in rows.collect())[:3]
    row = rows.where(f"path = '{first[0].path}'").first()
    assert first[0].lines == [list(row.features[:3]), list(row.features[3:])]
    some = [{r.path for r in parts.displayed(rows, 5, seed).collect()} for seed in (1, 1, 2)]
    assert len(some[0]) == 5 and some[0] == some[1] != some[2]


def test_submission_finds_itself(rows):
    out = parts.submitted(rows, 3)
    assert out.count() == 48 and out.where("True_Label <> Predicted_Label").count() == 0


def test_variance(rows):
    got = parts.variance_report(rows).orderBy("component").collect()
    assert len(got) == 6 and got[-1].cumulative == pytest.approx(1) and 1 <= got[0].n_target <= 6
    assert parts.variance_report(rows, 2, 0.99999).first().n_target == 1


def test_options():
    a = cli.options().parse_args(["d", "x.zip", "--models", "knn", "--knn-neighbors", "1", "3"])
    assert a.models == ["knn"] and a.knn_neighbors == [1, 3] and a.outer_folds == 5


def test_submission_of_other_families(rows):
    for family, setting in (("linear_least_squares", "n_components=4"), ("svm", "n_components=4 reg_strength=1e-3 epochs=20 learning_rate=0.1")):
        out = parts.submitted(rows, 3, family, cli.setting_of(setting.split()))
        assert out.count() == 48 and out.where("True_Label = Predicted_Label").count() > 40


def test_command_line(spark, tmp_path, capsys):
    import zipfile

    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for p in (1, 2):
            for i in range(3):
                z.writestr(f"p{p}_i{i}.pgm", b"P5\n2 2\n255\n" + bytes([9 * p, i, 200 - 90 * p, 5]))
    common = [str(tmp_path / "s.zip"), "--cache", str(tmp_path / "cache"), "--quiet"]
    cli.main(["a", *common])
    assert "n_samples" in capsys.readouterr().out and len(list((tmp_path / "cache").iterdir())) == 1
    cli.main(["submit", *common, "--no-cache", "--family", "nearest_class_mean", "--setting", "n_components=1", "--output", str(tmp_path / "out")])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["Image_Path", "True_Label", "Predicted_Label"]
    kept = ["--store", str(tmp_path / "models"), "--family", "nearest_class_mean", "--setting", "n_components=1"]
    cli.main(["fit", *common, *kept])
    cli.main(["predict", *common, *kept])
    assert "predicted_name" in capsys.readouterr().out
    cli.main(["b", *common, "--models", "nearest_class_mean", "knn", "--component-grid", "1", "--validation-ratio", "0.4"])
    assert "validation_accuracy" in capsys.readouterr().out


def folder_of_images(top, seed, shift=0):
    rng = np.random.default_rng(seed)
    for c in range(3):
        (top / f"c{c}").mkdir(parents=True, exist_ok=True)
        for i in range(8):
            image = rng.integers(0, 60, (5, 4))
            image[c + shift] += 150
            (top / f"c{c}" / f"i{i}.pgm").write_bytes(b"P5\n4 5\n255\n" + image.astype(np.uint8).tobytes())
    return str(top)


@pytest.mark.parametrize(("family", "setting"), [("nearest_class_mean", {"n_components": 3}), ("svm", {"n_components": 4, "reg_strength": 1e-3, "epochs": 20, "learning_rate": 0.1}), ("knn", {"k": 3})])
def test_pipelines_are_stored(spark, tmp_path, family, setting):
    """Another session and a stream score alike; the same rows find the pipeline, other rows make a new version."""
    train, test = folder_of_images(tmp_path / "train", 1), folder_of_images(tmp_path / "test", 2)
    store = str(tmp_path / "store")
    rows = images.read_images(spark, train, (5, 4))
    one = pipelines.stored_pipeline(rows, 3, family, setting, store, "p", (5, 4))
    assert one.fresh and one.version == 1
    again = pipelines.stored_pipeline(images.read_images(spark, train, (5, 4)).repartition(5), 3, family, setting, store, "p", (5, 4))
    assert not again.fresh and again.version == 1
    other = pipelines.loaded_pipeline(spark.newSession(), store, "p")
    said = {r.path: r.predicted_name for r in one.images(spark, test).collect()}
    assert {r.path: r.predicted_name for r in other.images(spark.newSession(), test).collect()} == said
    assert sum(path.split("/")[-2] == name for path, name in said.items()) > 20
    path = next(iter(said))
    assert other.image(spark, path).first().predicted_name == said[path]
    if family == "knn":
        with pytest.raises(ValueError):
            other.stream(spark, test + "/c0")
    else:
        query = other.stream(spark, test + "/c0").writeStream.format("memory").queryName(f"named_{family}").start()
        query.processAllAvailable()
        query.stop()
        assert {r.path.replace("file:", ""): r.predicted_name for r in spark.table(f"named_{family}").collect()} == {p: n for p, n in said.items() if "/c0/" in p}
    assert one.submission(rows).where("True_Label = Predicted_Label").count() > 20
    folder_of_images(tmp_path / "train", 3, 1)  # the images are rewritten under the same names
    new = pipelines.stored_pipeline(images.read_images(spark, train, (5, 4)), 3, family, setting, store, "p", (5, 4))
    assert new.fresh and new.version == 2 and pipelines.loaded_pipeline(spark, store, "p", 1).version == 1
    changed = pipelines.stored_pipeline(images.read_images(spark, train, (5, 4)), 3, "linear_least_squares", {"n_components": 2}, store, "p", (5, 4))
    assert changed.fresh and changed.version == 3 and pipelines.loaded_pipeline(spark, store, "p").family == "linear_least_squares"
    with pytest.raises(FileNotFoundError):
        pipelines.loaded_pipeline(spark, store, "p", 9)


def test_network_of_images(spark, tmp_path, capsys):
    path = folder_of_images(tmp_path / "faces", 6)
    rows = images.read_images(spark, path, how="minmax").persist()
    got = parts.network(rows, 3, 0.2, 0.2, epochs=2, batch=8, rate=1e-2, widths=(4,), grid=2)
    report = got.report().collect()
    assert len(report) == 2 and sum(r.chosen for r in report) == 1 and 0 <= got.test_accuracy <= 1
    assert {r.split: (r.images, r.classes) for r in parts.split_report(got.split).collect()} == {"train": (12, 3), "val": (6, 3), "test": (6, 3)}
    cli.main(["network", path, "--no-cache", "--quiet", "--dry-run", "--val-ratio", "0.2"])
    assert "images" in capsys.readouterr().out
    cli.main(["network", path, "--no-cache", "--quiet", "--epochs", "1", "--batch-size", "8", "--image-size", "6", "6", "--disable-augmentation"])
    assert "test_accuracy" in capsys.readouterr().out
    with pytest.raises(ValueError):
        parts.network(rows.withColumn("height", F.col("row_id") % 2), 3)
