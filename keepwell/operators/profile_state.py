"""Column profiles that can be merged: what a load adds is summed up once, as one row a column.

A state row holds counts, moments, extremes and two sketches: distinct values (HyperLogLog) and
quantiles (KLL).  States of loads are merged to that of all rows without reading the rows again.
Counts, extremes and moments of the merged state are exact; a number of distinct values is off by about
`DISTINCT_ERROR` of itself (one deviation), a quantile's rank by at most `RANK_ERROR` of the rows (99 in 100).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import any_of
from keepwell.operators.validate import number

#: log2 of the registers of a distinct sketch, and the size of a quantile sketch.
REGISTERS, QUANTILE_SIZE = 14, 800
DISTINCT_ERROR, RANK_ERROR = 1.04 / math.sqrt(1 << REGISTERS), 2.3 / QUANTILE_SIZE


def profile_state(df: DataFrame, load: str) -> DataFrame:
    """One row a column of a load: (load_id, column_name, dtype, n_rows, nulls, distinct, numbers, mean, m2, low, high, quantiles).

    One aggregation, combined on the map side; columns outside the numeric ones have no moments and quantiles.
    """
    numeric, parts = set(any_of(cfg.NUMERIC_COLUMNS, df.columns)), []
    for c, kind in df.dtypes:
        value = F.col(f"`{c}`")
        x = number(df, c) if c in numeric else F.lit(None).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("dtype"), F.count(F.lit(1)).alias("n_rows"), F.count_if(value.isNull()).alias("nulls"),
            F.hll_sketch_agg(value.cast("string"), F.lit(REGISTERS)).alias("distinct"),
            F.count(x).alias("numbers"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
            F.kll_sketch_agg_double(x, F.lit(QUANTILE_SIZE)).alias("quantiles")))
    return df.agg(F.array(*parts).alias("all")).select(F.lit(load).alias("load_id"), F.explode("all").alias("c")).select("load_id", "c.*")


def merged_state(states: DataFrame) -> DataFrame:
    """The state of all loads together, one row a column; a load that comes twice counts once."""
    once = states.dropDuplicates(["load_id", "column_name"])
    # A column has one row a load; moments are joined one load after the other, which keeps their digits.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def joined(a, b):
        n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2")))

    parts = F.sort_array(F.collect_list(F.struct("load_id", F.col("numbers").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))))
    grouped = once.groupBy("column_name").agg(
        F.min("dtype").alias("dtype"), F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct").alias("distinct"),
        parts.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    folded = grouped.withColumn("all", F.aggregate("parts", start, lambda a, b: joined(a, b)))
    return folded.select("column_name", "dtype", "n_rows", "nulls", "distinct", F.col("all.n").alias("numbers"),
                         F.when(F.col("all.n") > 0, F.col("all.mean")).alias("mean"), F.when(F.col("all.n") > 0, F.col("all.m2")).alias("m2"), "low", "high", "quantiles")


def describe_state(state: DataFrame) -> DataFrame:
    """(column_name, dtype, n_rows, nulls, n_distinct, numbers, mean, std, min, p25, p50, p75, max) of a merged state."""
    at = F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return state.withColumn("q", at).select(
        "column_name", "dtype", "n_rows", "nulls", F.hll_sketch_estimate("distinct").alias("n_distinct"), "numbers", "mean",
        F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1))).alias("std"), F.col("low").alias("min"),
        *[F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))], F.col("high").alias("max"))


def outlier_bounds(state: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Bounds for outliers by the sketched quartiles: two numbers a column come back."""
    out = {}
    for r in describe_state(state).where(F.col("column_name").isin(*cfg.OUTLIER_COLUMNS)).collect():
        spread = None if r["p25"] is None else cfg.IQR_MULTIPLIER * (r["p75"] - r["p25"])
        out[r["column_name"]] = (None, None) if spread is None else (r["p25"] - spread, r["p75"] + spread)
    return out
