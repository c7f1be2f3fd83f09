import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenspark.functions import arrays as A
from eigenspark.sources import images


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "x array<float>").select(column(F.col("x")).alias("y")).first().y


def test_scaling(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    z = one(spark, x, A.zscore)
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    assert one(spark, [3.0, 3.0], A.zscore) == [0, 0]
    assert one(spark, x, A.minmax) == pytest.approx([0, 1 / 8, 3 / 8, 1])
    assert one(spark, [3.0, 3.0], A.minmax) == [0, 0]
    assert one(spark, [3.0, 3.0], lambda c: A.minmax(c, constant_to_zero=False)) == [3, 3]
    assert one(spark, x, A.symmetric) == pytest.approx([-1, -0.75, -0.25, 1])
    with pytest.raises(Exception, match="constant"):
        one(spark, [3.0, 3.0], A.symmetric)
    assert one(spark, x, lambda c: A.standardise(c, 1.0, 1e-9)) == [0, 1, 3, 8]


def test_resize_and_crop_like_numpy(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (7, 9))
    flat = image.ravel().astype(float).tolist()
    for size in ((7, 9), (3, 4), (14, 5)):
        assert one(spark, flat, lambda c, s=size: A.resize(c, 7, 9, *s)) == images.resized(image, size).ravel().tolist()
    bars = rng.integers(0, 255, (4, 6)).astype(float)
    for side in (0, 1):
        own = bars.copy()
        own[:, (slice(0, 2), slice(4, 6))[side]] = 7
        assert one(spark, own.ravel().tolist(), lambda c: A.crop_bar(c, 4, 6, 2)) == (own[:, 2:] if side == 0 else own[:, :4]).ravel().tolist()
    assert one(spark, [5.0] * 24, lambda c: A.crop_bar(c, 4, 6, 2)) == [5.0] * 16


def test_targets_and_scores(spark):
    row = spark.sql("select 1 as label, array(0.1, 0.7, 0.7) as s").select(A.one_hot(F.col("label"), 3).alias("h"), A.one_versus_rest(F.col("label"), 3).alias("o"), A.argmax(F.col("s")).alias("a"), A.softmax(F.col("s")).alias("p"), A.with_bias(F.col("s")).alias("b")).first()
    assert row.h == [0, 1, 0] and row.o == [-1, 1, -1] and row.a == 1 and sum(row.p) == pytest.approx(1) and list(map(float, row.b)) == [0.1, 0.7, 0.7, 1]
