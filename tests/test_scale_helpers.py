"""Range-wise scans, exact quantiles and skewed joins against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepwell.functions.ordered import (
    RANGE, cut_points, hash_rank, running, with_range, with_tied_range)
from keepwell.functions.quantiles import exact_quantiles
from keepwell.functions.skew import hot_key_join


@pytest.mark.parametrize("finish_rows", [100_000, 50])
def test_exact_quantiles_match_pandas(spark, finish_rows):
    rng = np.random.default_rng(7)
    # A third of all rows share one value, another column is mostly ties.
    pdf = pd.DataFrame({"a": np.where(rng.random(30_000) < 0.34, 5.0, rng.normal(size=30_000)),
                        "b": rng.integers(0, 4, 30_000).astype(float),
                        "c": rng.normal(size=30_000)})
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, finish_rows=finish_rows)
    for c in pdf:
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist(), abs=1e-12)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_match_pandas(spark, descending):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.7, "hot", "cold"),
                        "x": rng.permutation(n).astype(float), "v": rng.integers(0, 9, n)})
    pdf["mark"] = np.where(rng.random(n) < 0.01, pdf["v"], np.nan)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "g string, x double, v long, mark double")
    ranged = with_range(df, "x", cut_points(df, ["x"])["x"])
    got = running(ranged, ["g"], ["x"], sums={"total": F.col("v")}, lasts={"seen": F.col("mark")},
                  descending=descending).toPandas().set_index("x").sort_index()
    want = pdf.sort_values("x", ascending=not descending)
    want["total"] = want.groupby("g")["v"].cumsum()
    want["seen"] = want.groupby("g")["mark"].ffill()
    want = want.set_index("x").sort_index()
    assert got["total"].tolist() == want["total"].tolist()
    assert got["seen"].fillna(-1).tolist() == want["seen"].fillna(-1).tolist()
    assert ranged.select(RANGE).distinct().count() > 4


def test_ranges_split_a_value_that_many_rows_share(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id") % 1000 * 1.0).alias("x"))
    ranged = with_tied_range(df, "x", "id")
    sizes = ranged.groupBy(RANGE).count().toPandas()["count"]
    assert sizes.max() < 20_000 / 10
    got = running(ranged, [], ["x", "id"], sums={"n": F.lit(1)}).orderBy("x", "id").toPandas()
    assert got["n"].tolist() == list(range(1, 20_001))


def test_hash_rank_numbers_every_row_once(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 2) \
        .withColumn("h", F.md5(F.col("id").cast("string")))
    got = hash_rank(df, ["g"], "h", "id").toPandas().sort_values(["g", "h"])
    for _, part in got.groupby("g"):
        assert part["rank"].tolist() == list(range(1, len(part) + 1))


def test_hot_key_join_equals_join(spark, monkeypatch):
    left = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("k"), "id")
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = hot_key_join(left, right, "k", 60_000)
    assert got.count() == 60_000
    assert got.where("v <> k * 2").count() == 0
