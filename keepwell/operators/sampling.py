"""Deterministic split, folds and samples, all in the order of a key hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.ordered import hash_rank


def seeded_hash(key: str = cfg.ID, seed: int | str = cfg.SEED) -> Column:
    """md5 of key and seed: a random-looking order every engine can reproduce."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")))


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    hashed = df.where(F.col(label).isNotNull()).withColumn("_hash", seeded_hash(key, seed))
    return hash_rank(hashed, [label], "_hash", key, out="_rank")


def stratified_split(df: DataFrame, label: str = "label", key: str = cfg.ID,
                     test_size: float = cfg.TEST_SIZE, seed: int = cfg.SEED) -> DataFrame:
    """Adds is_test: the first ceil(test_size * n) rows of each class in hash order.

    Rows without a label cannot be split by class and take no part.
    The class sizes are a two-row lookup, so that join broadcasts them.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label) \
        .agg(F.ceil(F.lit(test_size) * F.count(F.lit(1))).alias("_n_test"))
    return _ranked(df, label, key, seed).join(F.broadcast(sizes), label) \
        .withColumn("is_test", (F.col("_rank") <= F.col("_n_test")).cast("int")) \
        .select(*df.columns, "is_test")


def stratified_folds(df: DataFrame, folds: int = cfg.CV_FOLDS, label: str = "label",
                     key: str = cfg.ID, seed: int = cfg.SEED) -> DataFrame:
    """Adds fold 0..folds-1, dealt round in hash order within each class."""
    return _ranked(df, label, key, seed) \
        .withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")) \
        .select(*df.columns, "fold")


def background_sample(df: DataFrame, n: int = cfg.BACKGROUND_ROWS, key: str = cfg.ID,
                      seed: int = cfg.SEED) -> DataFrame:
    """At most n rows, the first in hash order (per-task top n, then merged)."""
    return df.withColumn("_hash", seeded_hash(key, seed)).orderBy("_hash", key).limit(n) \
        .drop("_hash")
