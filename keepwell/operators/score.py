"""Churn probability, risk tier, retention action, shadow scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.config import Scorecard

#: A probability this close to a class bound is at it: sums of a few products are off by less, in either direction.
ROUNDING = 1e-12


def margin(card: Scorecard) -> Column:
    """Linear margin of a scorecard over engineered columns."""
    total = F.lit(card.intercept)
    for name, weight in card.weights.items():
        total = total + F.lit(weight) * (F.col(name) - F.lit(card.offsets.get(name, 0.0)))
    return total


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probability(card: Scorecard) -> Column:
    return logistic(margin(card))


def with_scorecard(df: DataFrame, card: Scorecard = cfg.CHAMPION,
                   out: str = "churn_probability") -> DataFrame:
    return df.withColumn(out, probability(card))


def with_model(matrix: DataFrame, model, out: str = "churn_probability") -> DataFrame:
    """Probability of class 1 by a fitted Spark ML classifier; other columns are kept."""
    scored = model.transform(matrix).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def risk_level(p: Column) -> Column:
    """Tier of a probability; bounds belong to the higher tier."""
    expr = F
    for name, bound in cfg.RISK_TIERS:
        expr = expr.when(p >= bound, name)
    return expr.otherwise(cfg.LOWEST_TIER)


def with_retention(df: DataFrame) -> DataFrame:
    """Tier, action, cost and expected saving of each scored row.

    The four strategies are a fixed lookup table, so the join broadcasts it.
    """
    spark = df.sparkSession
    actions = spark.createDataFrame(
        cfg.STRATEGIES,
        "risk_level string, retention_strategy string, retention_cost double, success_rate double")
    tiered = df.withColumn("risk_level", risk_level(F.col("churn_probability")))
    return tiered.join(F.broadcast(actions), "risk_level").withColumn(
        "expected_revenue_saved",
        F.col("churn_probability") * F.col("clv_estimate") * F.col("success_rate"))


def predict_batch(
    engineered: DataFrame,
    champion: Scorecard = cfg.CHAMPION,
    challenger: Scorecard | None = None,
) -> DataFrame:
    """Prediction records: one projection over the engineered rows, no shuffle."""
    scored = with_retention(with_scorecard(engineered, champion))
    columns = [
        F.col(cfg.ID), F.lit(champion.name).alias("served_by_model"), F.col("churn_probability"),
        F.col("risk_level"), F.col("retention_strategy"), F.col("retention_cost"),
        F.col("expected_revenue_saved"), F.col("clv_estimate").alias("clv"),
    ]
    if challenger is not None:
        columns.append(shadow(challenger.name, probability(challenger)))
    return scored.select(*columns)


def shadow(name: str, p: Column) -> Column:
    """The challenger's answer next to the champion's; its class bound is inclusive."""
    return F.struct(
        F.lit(name).alias("model_name"), p.alias("churn_probability"),
        challenger_class(p).alias("prediction")).alias("challenger_prediction")


def champion_class(p: Column) -> Column:
    """Most likely class: the bound itself is class 0."""
    return (p > 0.5 + ROUNDING).cast("int")


def challenger_class(p: Column) -> Column:
    """Class next to the champion's: the bound itself is class 1."""
    return (p >= 0.5 - ROUNDING).cast("int")


def shadow_scores(engineered: DataFrame) -> DataFrame:
    """Both models side by side."""
    both = with_scorecard(with_scorecard(engineered), cfg.CHALLENGER, "challenger_probability")
    return both.select(
        cfg.ID, "churn_probability", champion_class(F.col("churn_probability")).alias("prediction"),
        "challenger_probability",
        challenger_class(F.col("challenger_probability")).alias("challenger_prediction"))


def shadow_agreement(shadowed: DataFrame) -> DataFrame:
    """Rows, mean absolute difference and mean probabilities per pair of classes."""
    return shadowed.groupBy("prediction", "challenger_prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("churn_probability") - F.col("challenger_probability")))
        .alias("mean_abs_diff"),
        F.avg("churn_probability").alias("avg_champion"),
        F.avg("challenger_probability").alias("avg_challenger"))


def tier_report(scored: DataFrame) -> DataFrame:
    """Rows, mean probability, revenue at risk and mean value per tier."""
    return scored.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("churn_probability").alias("avg_probability"),
        F.sum(F.col("churn_probability") * F.col("clv_estimate")).alias("revenue_at_risk"),
        F.avg("clv_estimate").alias("avg_clv"))
