"""k-means from all starts at once against Spark's, one start after the other."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from keepwell.operators import kmeans


def frame(spark, x):
    rows = [(i * 7919 + 1, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{kmeans.MARK} long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def cost(x, centers):
    return ((x[:, None] - np.array(centers)[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_cost(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.6, size=(300, 3)) for c in rng.normal(size=(7, 3)) * 3])
    df, columns = frame(spark, x), ["x0", "x1", "x2"]
    found = kmeans.fit(df, columns, 5, 10, 42)
    assert len(found) == 10 and all(abs(c - cost(x, m)) < 1e-6 * c for c, m in found)
    again = kmeans.fit(df.repartition(7), columns, 5, 10, 42)
    assert np.allclose([c for c, _ in found], [c for c, _ in again])
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    theirs = min(KMeans(k=5, seed=42 + i).fit(vectors).summary.trainingCost for i in range(10))
    assert min(c for c, _ in found) <= theirs * 1.001


def test_few_rows(spark):
    x = np.array([[0.0, 0.0]] * 50 + [[1.0, 1.0]] * 3)
    for c, centers in kmeans.fit(frame(spark, x), ["x0", "x1"], 5, 3, 1):
        assert c == 0 and len(centers) == 5 and {tuple(m) for m in centers} == {(0.0, 0.0), (1.0, 1.0)}
    with pytest.raises(ValueError):
        kmeans.fit(frame(spark, x).limit(0), ["x0", "x1"], 5, 3, 1)


def test_draws_follow_the_distance(spark):
    """The second centre is a row with a chance in proportion to its squared distance from the first."""
    x = np.array([[0.0]] * 1 + [[1.0]] * 1 + [[3.0]] * 1)
    df = frame(spark, x).withColumn("x1", F.lit(0.0))
    drawn = kmeans._next_centers(df, ["x0", "x1"], [np.array([[0.0, 0.0]])] * 2000, 1, 5)
    share = np.mean([d[0] == 3.0 for d in drawn])
    assert abs(share - 0.9) < 0.03 and not any(d[0] == 0.0 for d in drawn)


def test_nearest_centres_and_least_times():
    rng = np.random.default_rng(2)
    x, centers = rng.integers(0, 4, (2, 500)).astype(float), rng.integers(0, 4, (6, 2)).astype(float)
    far = ((x.T[:, None] - centers[None]) ** 2).sum(axis=2)
    near, best = kmeans._nearest(x, centers)
    assert np.array_equal(near, far.argmin(axis=1)) and np.array_equal(best, far.min(axis=1))
    time = rng.integers(1, 4, 500).astype(float)
    assert x[:, kmeans._first(time, x)].tolist() == x[:, np.lexsort((*x, time))[0]].tolist() and kmeans._first(np.full(500, np.inf), x) is None
