"""Frames many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import micro, model_label
from keepwell.operators.clean import fit_clean
from keepwell.operators.encode import Preprocessing
from keepwell.operators.features import engineer
from keepwell.operators.score import champion_class, with_scorecard
from keepwell.operators.segment import Segmentation
from keepwell.sources.scratch import materialize
from keepwell.sources.subscribers import subscribers, subscribers_with_copies


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers(spark, sf_dir)


def raw_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribers_with_copies(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_clean(raw(spark, sf_dir))[1]


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer(cleaned(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered rows with the champion scorecard's probability."""
    return with_scorecard(engineered(spark, sf_dir))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with the segment of the fixed centroids.

    Fitting the segments reads the scored rows twice and assigning them once
    more, so they are written once; each later pass reads only its columns.
    """
    df = materialize(scored(spark, sf_dir), "scored")
    return Segmentation.from_centroids(df, cfg.FIXED_CENTROIDS).assign(df)


def preprocessed(spark: SparkSession, sf_dir: str) -> tuple[Preprocessing, DataFrame]:
    """Fitted preparation and the engineered rows."""
    return Preprocessing.fit_engineered(raw(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, prediction and score of the champion scorecard on all labelled rows.

    Curves and rank statistics read these few columns more than once, so they
    are written.
    """
    df = scored(spark, sf_dir)
    return materialize(
        df.withColumn("label", model_label(df)).where("label is not null").select(
            cfg.ID, "label", champion_class(F.col("churn_probability")).alias("prediction"),
            micro(F.col("churn_probability")).alias("score")), "judged")
