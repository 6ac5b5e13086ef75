"""Merged profile states against the state and the exact profile of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import profile_state as ps
from keepwell.operators import validate


def table(spark, n=4000):
    rng = np.random.default_rng(6)
    rows = [(f"c{i}", None if i % 50 == 0 else str(round(float(rng.gamma(2, 30)), 2)), float(rng.integers(0, 72)), 1e9 + float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "customerID string, TotalCharges string, tenure double, MonthlyCharges double")


def test_merged_is_the_whole(spark):
    df = table(spark)
    loads = [ps.profile_state(df.where(F.pmod(F.xxhash64("customerID"), F.lit(4)) == i), f"l{i}") for i in range(4)]
    states = loads[0].unionByName(loads[1]).unionByName(loads[2]).unionByName(loads[3]).unionByName(loads[1])
    got = {r["column_name"]: r for r in ps.describe_state(ps.merged_state(states)).collect()}
    whole = {r["column_name"]: r for r in ps.describe_state(ps.merged_state(ps.profile_state(df, "all"))).collect()}
    exact = {r["column_name"]: r for r in validate.describe_numeric(df).collect()}
    for c, r in got.items():
        assert (r["n_rows"], r["nulls"], r["numbers"], r["min"], r["max"]) == tuple(whole[c][k] for k in ("n_rows", "nulls", "numbers", "min", "max"))
        assert r["n_distinct"] == pytest.approx(whole[c]["n_distinct"], rel=0.01)
    assert got["customerID"]["mean"] is None and got["customerID"]["p50"] is None
    assert got["customerID"]["n_distinct"] == pytest.approx(4000, rel=4 * ps.DISTINCT_ERROR)
    for c, e in exact.items():
        # The deviation of values around a billion keeps its digits.
        assert got[c]["mean"] == pytest.approx(e["mean"], rel=1e-12) and got[c]["std"] == pytest.approx(e["std"], rel=1e-6)
        x = np.sort([float(r[0]) for r in df.select(F.col(c).cast("double")).where(f"{c} IS NOT NULL").collect()])
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            low, high = np.searchsorted(x, got[c][name], "left") / len(x), np.searchsorted(x, got[c][name], "right") / len(x)
            assert low - ps.RANK_ERROR <= p <= high + ps.RANK_ERROR


def test_outliers_by_sketches(spark):
    df = table(spark)
    bounds = ps.outlier_bounds(ps.merged_state(ps.profile_state(df, "all")))
    close = {r["column_name"]: r for r in validate.iqr_outliers(df, bounds).collect()}
    for r in validate.iqr_outliers(df).collect():
        if r["column_name"] in close and r["lower_bound"] is not None:
            width = r["upper_bound"] - r["lower_bound"]
            assert abs(close[r["column_name"]]["upper_bound"] - r["upper_bound"]) < 0.05 * width
            assert abs(close[r["column_name"]]["outlier_count"] - r["outlier_count"]) <= 40


def test_empty_load(spark):
    df = table(spark, 20)
    both = ps.profile_state(df.limit(0), "none").unionByName(ps.profile_state(df, "some"))
    got = {r["column_name"]: r for r in ps.describe_state(ps.merged_state(both)).collect()}
    assert got["tenure"]["n_rows"] == 20 and got["tenure"]["numbers"] == 20
    none = {r["column_name"]: r for r in ps.describe_state(ps.merged_state(ps.profile_state(df.limit(0), "none"))).collect()}
    assert none["tenure"]["mean"] is None and none["tenure"]["n_distinct"] == 0 and set(none) == set(df.columns)
    assert cfg.OUTLIER_COLUMNS
