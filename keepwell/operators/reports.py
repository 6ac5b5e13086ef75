"""Dashboard reports over the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import any_of

TOP_RISK_COLUMNS = [cfg.ID, "tenure", "MonthlyCharges", "churn_probability", "segment"]


def executive_kpis(df: DataFrame) -> DataFrame:
    """Churn rate, revenue at risk, high-risk rows and mean value in one aggregation.

    A missing column changes its figure only: no target means the mean
    probability (0 without one), no probability or value means 0.
    """
    have = set(df.columns)
    p, clv = F.col("churn_probability"), F.col("clv_estimate")
    zero = F.lit(0.0)
    if cfg.TARGET in have:
        rate = F.avg(F.when(F.col(cfg.TARGET) == "Yes", 1.0).otherwise(0.0))
    else:
        rate = F.avg(p) if "churn_probability" in have else zero
    both = {"churn_probability", "clv_estimate"} <= have
    return df.agg(
        (F.coalesce(F.sum(p * clv), zero) if both else F.max(zero)).alias("revenue_at_risk"),
        (F.count_if(p >= cfg.HIGH_RISK_THRESHOLD) if "churn_probability" in have
         else F.count_if(F.lit(False))).alias("high_risk_count"),
        (F.avg(clv) if "clv_estimate" in have else F.max(zero)).alias("avg_clv"),
        (rate if cfg.TARGET in have or "churn_probability" in have else F.max(zero))
        .alias("churn_rate"),
    ).select("churn_rate", F.coalesce("revenue_at_risk", zero).alias("revenue_at_risk"),
             "high_risk_count", "avg_clv")


def top_risk(df: DataFrame, n: int = 20) -> DataFrame:
    """The n rows of highest probability among the high-risk ones; the key breaks ties."""
    return df.where(F.col("churn_probability") >= cfg.HIGH_RISK_THRESHOLD) \
        .orderBy(F.desc("churn_probability"), cfg.ID).limit(n) \
        .select(*any_of(TOP_RISK_COLUMNS, df.columns))


def customer_lookup(df: DataFrame, wanted: str) -> DataFrame:
    """One customer's record without target and scores; the key test reaches the scan."""
    return df.where(F.col(cfg.ID) == wanted).orderBy(*df.columns).limit(1) \
        .drop("churn_probability", "segment", "cluster_id", cfg.TARGET)


def first_customers(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n ids in id order, to choose from."""
    return df.select(cfg.ID).where(F.col(cfg.ID).isNotNull()).orderBy(cfg.ID).limit(n)


def customers_lookup(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of many requested keys."""
    return df.join(wanted.select(cfg.ID), cfg.ID, "left_semi")


def segment_clv(df: DataFrame) -> DataFrame | None:
    """Summed value per segment; None when the table has no segments."""
    if "segment" not in df.columns or "clv_estimate" not in df.columns:
        return None
    return df.where(F.col("segment").isNotNull()).groupBy("segment") \
        .agg(F.coalesce(F.sum("clv_estimate"), F.lit(0.0)).alias("clv_estimate"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(column) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def tenure_charge_bins(df: DataFrame, months: int = 6, charge: float = 10.0) -> DataFrame:
    """Rows per tenure bin, charge bin and segment: a scatter plot that stays small."""
    return df.groupBy(
        (F.floor(F.col("tenure") / months) * months).cast("int").alias("tenure_from"),
        (F.floor(F.col("MonthlyCharges") / charge) * charge).alias("charges_from"),
        "segment").agg(F.count(F.lit(1)).alias("n"))
