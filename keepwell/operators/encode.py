"""Encoding, scaling, and the fitted preprocessing state."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import any_of, lookup, model_label, select_or_zero
from keepwell.operators.clean import clean, fit_clean
from keepwell.operators.features import engineer


def encode_binary(df: DataFrame) -> DataFrame:
    """Two-valued text as 0/1; an unknown value stays missing."""
    return df.withColumns({c: lookup(m, F.col(c)) for c, m in cfg.BINARY_MAPS.items()
                           if c in df.columns})


def fit_categories(df: DataFrame) -> dict[str, list[str]]:
    """Sorted distinct texts of each categorical column.

    One pass: every column's set is one partial aggregate.  Each text becomes a
    column of the model's matrix, so the sets are as small as that matrix is narrow.
    """
    names = any_of(cfg.ONE_HOT_COLUMNS, df.columns)
    if not names:
        return {}
    row = df.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in names]).first()
    return {c: sorted(row[c]) for c in names}


def dummy_names(categories: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(column, category, dummy name) of each one-hot column; the first category is left out."""
    return [(c, v, f"{c}_{v}") for c, values in categories.items() for v in values[1:]]


def encode_one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """0/1 column per category but the first; the categorical columns go."""
    dummies = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int").alias(name)
               for c, v, name in dummy_names(categories) if c in df.columns]
    gone = set(categories)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *dummies)


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregation.

    A column that is constant up to rounding gets deviation 1.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`").cast("double")
        aggs += [F.avg(col).alias(f"m{i}"), F.var_pop(col).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    eps = sys.float_info.epsilon
    state = {}
    for i, c in enumerate(columns):
        mean, var = row[f"m{i}"], row[f"v{i}"]
        if mean is None:
            state[c] = (0.0, 1.0)
            continue
        constant = var <= row["n"] * eps * var + (row["n"] * mean * eps) ** 2
        state[c] = (mean, 1.0 if constant else math.sqrt(var))
    return state


def scale(df: DataFrame, state: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation for each fitted column."""
    return df.select(*[
        ((F.col(f"`{c}`").cast("double") - F.lit(state[c][0])) / F.lit(state[c][1])).alias(c)
        if c in state else F.col(f"`{c}`") for c in df.columns])


@dataclass
class Preprocessing:
    """Fitted state of the whole preparation: medians, categories, feature list, scaling.

    `transform` is column expressions only (plus the key's deduplication), so
    it serves batch tables and stream micro-batches alike.
    """

    medians: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, raw: DataFrame, sequence: str | None = None) -> Preprocessing:
        return cls.fit_engineered(raw, sequence)[0]

    @classmethod
    def fit_engineered(cls, raw: DataFrame, sequence: str | None = None) \
            -> tuple[Preprocessing, DataFrame]:
        """Fitted state and the engineered rows it was fitted on.

        Deduplicated rows are written once; medians, categories, scaling and
        whatever the caller does next read only the columns they need.
        """
        medians, cleaned = fit_clean(raw, sequence)
        state = cls(medians=medians)
        engineered = engineer(cleaned)
        state.categories = fit_categories(engineered)
        encoded = state.encoded(engineered)
        skip = {cfg.ID, cfg.TARGET, sequence}
        state.features = [c for c in encoded.columns if c not in skip]
        state.scaling = fit_scale(encoded, state.features)
        return state, engineered

    def engineered(self, raw: DataFrame, sequence: str | None = None) -> DataFrame:
        return engineer(clean(raw, self.medians, sequence))

    def encoded(self, engineered: DataFrame) -> DataFrame:
        return encode_one_hot(encode_binary(engineered), self.categories)

    def matrix(self, engineered: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Key, label and the scaled features in fitted order, row by row."""
        encoded = self.encoded(engineered.withColumn("label", model_label(engineered)))
        aligned = select_or_zero(encoded, self.features, keep=(cfg.ID, "label", *keep))
        return scale(aligned, self.scaling)

    def transform(self, raw: DataFrame, sequence: str | None = None) -> DataFrame:
        return self.matrix(self.engineered(raw, sequence))

    # -- persistence: four small tables in one (kind, name, position, text, a, b) --
    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("median", c, i, None, v, None) for i, (c, v) in enumerate(self.medians.items())]
        rows += [("category", c, i, v, None, None) for c, vs in self.categories.items()
                 for i, v in enumerate(vs)]
        rows += [("feature", c, i, None, *self.scaling[c]) for i, c in enumerate(self.features)]
        spark.createDataFrame(
            rows, "kind string, name string, position int, text string, a double, b double"
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessing:
        state = cls()
        for r in spark.read.parquet(path).orderBy("position").collect():
            if r["kind"] == "median":
                state.medians[r["name"]] = r["a"]
            elif r["kind"] == "category":
                state.categories.setdefault(r["name"], []).append(r["text"])
            else:
                state.features.append(r["name"])
                state.scaling[r["name"]] = (r["a"], r["b"])
        order = {c: i for i, c in enumerate(cfg.ONE_HOT_COLUMNS)}
        state.categories = dict(sorted(state.categories.items(), key=lambda kv: order[kv[0]]))
        return state
