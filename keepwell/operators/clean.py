"""Cleaning: coercion, keep-first deduplication, median imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import BLANK_PATTERN, any_of, number
from keepwell.functions.quantiles import exact_quantiles
from keepwell.sources.scratch import materialize


def clean_total_charges(df: DataFrame) -> DataFrame:
    """TotalCharges as double: blank text and anything else unreadable become null."""
    if "TotalCharges" not in df.columns:
        return df
    if dict(df.dtypes)["TotalCharges"] == "string":
        df = df.withColumn(
            "TotalCharges",
            F.when(~F.col("TotalCharges").rlike(BLANK_PATTERN), F.col("TotalCharges")))
    return df.withColumn("TotalCharges", number(df, "TotalCharges"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Configured number columns as double; values that do not parse become null."""
    return df.withColumns({c: number(df, c) for c in any_of(cfg.NUMERIC_COLUMNS, df.columns)})


def fill_senior(df: DataFrame) -> DataFrame:
    """SeniorCitizen as 0/1 integer, missing as 0."""
    if "SeniorCitizen" not in df.columns:
        return df
    return df.withColumn(
        "SeniorCitizen", F.coalesce(F.col("SeniorCitizen"), F.lit(0)).cast("int"))


def keep_first(df: DataFrame, key: str = cfg.ID, sequence: str | None = None) -> DataFrame:
    """One row per key: the lowest `sequence`; rows without a key all stay.

    A minimum over a struct is combined on the map side, so a key with very
    many copies sends one row per map task.  Without a sequence column, and on
    ties, the smallest whole row wins, one with a target before one without, so
    the result does not depend on partitioning.  An anonymous record is nobody's
    copy: it gets a number of its own, which also spreads such rows evenly.
    """
    if key not in df.columns:
        return df
    rest = [c for c in df.columns if c not in (key, sequence)]
    lead = [F.col(sequence).alias("_order")] if sequence else []
    if cfg.TARGET in rest:
        lead.append(F.col(cfg.TARGET).isNull().alias("_untold"))
    picked = F.min(F.struct(*lead, *[F.col(f"`{c}`") for c in rest])).alias("_row")
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    one = df.withColumn("_alone", alone).groupBy(key, "_alone").agg(picked)
    return one.select(*[F.col(key) if c == key else F.col("_row._order" if c == sequence else f"_row.`{c}`")
                        .alias(c) for c in df.columns])


def prepare(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """Everything before imputation: coercion, SeniorCitizen, deduplication."""
    return keep_first(fill_senior(coerce_numeric(clean_total_charges(df))), sequence=sequence)


def medians_of(prepared: DataFrame) -> dict[str, float]:
    """Exact median of each number column of prepared rows."""
    columns = any_of(cfg.NUMERIC_COLUMNS, prepared.columns)
    return {c: v[0] for c, v in exact_quantiles(prepared, columns, [0.5]).items()}


def fit_medians(df: DataFrame, sequence: str | None = None) -> dict[str, float]:
    """Medians from raw rows.

    Only the key and the number columns are read and shuffled; the prepared
    numbers are written once, the rounds of the quantile search read them.
    """
    columns = any_of(cfg.NUMERIC_COLUMNS, df.columns)
    need = any_of([cfg.ID, *([sequence] if sequence else []), *columns], df.columns)
    return medians_of(materialize(prepare(df.select(*need), sequence).select(*columns), "numbers"))


def fit_clean(df: DataFrame, sequence: str | None = None) -> tuple[dict[str, float], DataFrame]:
    """Fitted medians and the cleaned rows; preparation runs once and is written."""
    prepared = materialize(prepare(df, sequence), "prepared")
    medians = medians_of(prepared)
    return medians, impute(prepared, medians)


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill missing numbers with the fitted medians."""
    fills = {c: F.coalesce(F.col(c), F.lit(m).cast(dict(df.dtypes)[c]))
             for c, m in medians.items() if c in df.columns and m is not None}
    return df.withColumns(fills) if fills else df


def clean(df: DataFrame, medians: dict[str, float], sequence: str | None = None) -> DataFrame:
    """Cleaned records under fitted medians."""
    return impute(prepare(df, sequence), medians)
