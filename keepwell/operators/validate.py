"""Profiling and validation of raw records; every report is a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import any_of, number, strip
from keepwell.functions.quantiles import exact_quantiles
from keepwell.sources.scratch import materialize

NUMERIC_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def semantic_type(name: str, kind: str) -> str:
    """Role of a column: by name first, then by its data type."""
    for role, names in (("id", [cfg.ID]), ("target", [cfg.TARGET]),
                        ("numeric", cfg.NUMERIC_COLUMNS), ("binary", cfg.BINARY_COLUMNS),
                        ("categorical", cfg.CATEGORICAL_COLUMNS)):
        if name in names:
            return role
    numeric = kind in NUMERIC_KINDS or kind.startswith("decimal")
    return "numeric" if numeric else "categorical"


def _long(df: DataFrame, columns: Sequence[str], carry: Sequence[Column] = ()) -> DataFrame:
    """(name, value as text) per column and row, with the carried columns."""
    items = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns])
    return df.select(*carry, F.explode(items).alias("_i")).select(
        "_i.*", *[F.col(c) for c in ("_seq",) if carry])


def profile_columns(df: DataFrame, order: str = cfg.ID, samples: int = 3,
                    approximate: bool = False) -> DataFrame:
    """One row per column: type, role, null count, distinct count, first values.

    Nulls are counted in one aggregation over the columns; only the distinct
    (column, value) pairs are shuffled.  The first values follow `order`; the rank limit is applied on the
    map side, so each task sends on at most `samples` rows a column.
    """
    kinds = dict(df.dtypes)
    long = _long(df, df.columns, [F.col(f"`{order}`").alias("_seq")])
    nulls = _per_column(df, {c: F.col(f"`{c}`").isNull() for c in df.columns}, "null_count") \
        .withColumnRenamed("column_name", "name")
    if approximate:
        one = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"c{i}")
                       for i, c in enumerate(df.columns)])
        distinct = one.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("unique_count"))
            for i, c in enumerate(df.columns)])).alias("r")).select("r.*")
    else:
        distinct = long.where("value is not null").select("name", "value").distinct() \
            .groupBy("name").agg(F.count(F.lit(1)).alias("unique_count"))
    counts = nulls.join(distinct, "name", "left")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("_seq", "value"))
    first = long.where("value is not null").withColumn("_rank", rank) \
        .where(F.col("_rank") <= samples) \
        .groupBy("name").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda x: x["value"])
            .alias("sample_values"))
    facts = df.sparkSession.createDataFrame(
        [(i, c, kinds[c], semantic_type(c, kinds[c])) for i, c in enumerate(df.columns)],
        "position int, name string, dtype string, semantic_type string")
    empty = F.array().cast("array<string>")
    return facts.join(counts, "name", "left").join(first, "name", "left").select(
        "position", "name", "dtype", "semantic_type",
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("sample_values", empty).alias("sample_values"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))


def _per_column(df: DataFrame, counts: dict[str, Column], value: str) -> DataFrame:
    """One aggregation over the table, turned into a row per column."""
    one = df.agg(*[F.sum(expr.cast("bigint")).alias(f"c{i}")
                   for i, expr in enumerate(counts.values())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias(value))
        for i, c in enumerate(counts)
    ])).alias("r")).select("r.*")


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls, NaN and blank texts per column, only columns that have some."""
    kinds = dict(df.dtypes)
    counts = {}
    for c in df.columns:
        col = F.col(f"`{c}`")
        gone = col.isNull()
        if kinds[c] == "string":
            gone = gone | F.coalesce(strip(col) == "", F.lit(False))
        elif kinds[c] in ("double", "float"):
            gone = gone | F.coalesce(F.isnan(col), F.lit(False))
        counts[c] = gone.cast("int")
    return _per_column(df, counts, "missing").where("missing > 0")


def duplicate_ids(df: DataFrame, key: str = cfg.ID) -> DataFrame:
    """Rows beyond the first of each key; null keys count as one key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def dtype_issues(df: DataFrame) -> DataFrame:
    """Number columns with values that do not parse, or that are missing altogether."""
    have = any_of(cfg.NUMERIC_COLUMNS, df.columns)
    bad = {c: (F.col(c).isNotNull() & number(df, c).isNull()).cast("int") for c in have}
    found = _per_column(df, bad, "invalid").where("invalid > 0").select(
        "column_name", "invalid",
        F.concat(F.lit("Non-numeric values found in "), "column_name", F.lit(": "),
                 F.col("invalid").cast("string")).alias("issue"))
    gone = [(c, None, f"Missing expected numeric column: {c}")
            for c in cfg.NUMERIC_COLUMNS if c not in have]
    if not gone:
        return found
    return found.unionByName(df.sparkSession.createDataFrame(
        gone, "column_name string, invalid bigint, issue string"))


def iqr_outliers(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Bounds q1 - 1.5 IQR and q3 + 1.5 IQR per column and the rows strictly outside.

    With `bounds`, such as `profile_state.outlier_bounds` has from sketches, only the count is made.

    The quartiles are exact and come back as two numbers per column; the count
    is one aggregation over the table with the bounds as literals.  The parsed
    numbers are written once for these passes.
    """
    have = any_of(cfg.OUTLIER_COLUMNS, df.columns)
    numbers = df.select(*[number(df, c).alias(c) for c in have])
    if bounds is None:
        numbers = materialize(numbers, "numbers")
    quartiles = exact_quantiles(numbers, have, [0.25, 0.75]) if bounds is None else {}
    bounds = {c: bounds.get(c, (None, None)) for c in have} if bounds is not None else {}
    for c in quartiles:
        q1, q3 = quartiles[c]
        spread = None if q1 is None else cfg.IQR_MULTIPLIER * (q3 - q1)
        bounds[c] = (None, None) if q1 is None else (q1 - spread, q3 + spread)
    one = numbers.agg(*[
        F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(c)
        for c, (lo, hi) in bounds.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(lo).cast("double").alias("lower_bound"),
                 F.lit(hi).cast("double").alias("upper_bound"), F.col(c).alias("outlier_count"))
        for c, (lo, hi) in bounds.items()])).alias("r")).select("r.*")


def target_distribution(df: DataFrame) -> DataFrame:
    return df.where(F.col(cfg.TARGET).isNotNull()).groupBy(cfg.TARGET) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), cfg.TARGET)


def critical_issues(df: DataFrame) -> DataFrame:
    """Issue texts: duplicate keys, and missing values in any column but TotalCharges."""
    duplicates = duplicate_ids(df).where("duplicate_ids > 0") \
        .select(F.lit("Duplicate customer IDs detected").alias("issue"))
    missing = missing_values(df).where("column_name <> 'TotalCharges'").select(
        F.concat(F.lit("Missing values in "), "column_name", F.lit(": "),
                 F.col("missing").cast("string")).alias("issue"))
    return duplicates.unionByName(missing)


def require_valid(df: DataFrame) -> None:
    """Raise when any critical issue exists (at most one row per column comes back)."""
    issues = [r["issue"] for r in critical_issues(df).collect()]
    if issues:
        raise ValueError(f"Critical validation failures: {issues}")


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max of each number column."""
    have = any_of(cfg.NUMERIC_COLUMNS, df.columns)
    numbers = materialize(df.select(*[number(df, c).alias(c) for c in have]), "numbers")
    quartiles = exact_quantiles(numbers, have, [0.25, 0.5, 0.75])
    aggs = []
    for c in have:
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"),
                 F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max")]
    return numbers.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"),
                 F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
                 F.col(f"{c}_min").alias("min"),
                 *[F.lit(v).cast("double").alias(q)
                   for q, v in zip(("p25", "p50", "p75"), quartiles[c])],
                 F.col(f"{c}_max").alias("max"))
        for c in have])).alias("r")).select("r.*")


def describe_text(df: DataFrame) -> DataFrame:
    """count, distinct values, most frequent value and its count of each text column.

    Equal counts: the lowest value is named.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    counted = _long(df, texts).where("value is not null").groupBy("name", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(F.col("name").alias("column_name")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("unique_count"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("top"),
        F.max("n").alias("freq"))


def validation_report(df: DataFrame) -> DataFrame:
    """(section, name, value): the whole report as one table.

    Rows and columns, missing values, duplicates, unreadable numbers, outliers and the target's distribution.
    """
    def rows(section: str, found: DataFrame, name: str, value: str) -> DataFrame:
        return found.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"),
                            F.col(value).cast("double").alias("value"))

    shape = table_shape(df).select(F.explode(F.map_from_arrays(
        F.array(F.lit("rows"), F.lit("columns")), F.array("row_count", "column_count"))).alias("name", "value"))
    parts = [
        rows("shape", shape, "name", "value"), rows("missing", missing_values(df), "column_name", "missing"),
        rows("duplicates", duplicate_ids(df).withColumn("name", F.lit("ids")), "name", "duplicate_ids"),
        rows("duplicates", duplicate_rows(df).withColumn("name", F.lit("rows")), "name", "duplicate_rows"),
        rows("dtype", dtype_issues(df), "column_name", "invalid"), rows("outliers", iqr_outliers(df), "column_name", "outlier_count")]
    if cfg.TARGET in df.columns:
        parts.append(rows("target", target_distribution(df), cfg.TARGET, "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contract_violations(df: DataFrame) -> DataFrame:
    """Each record with the names of the request rules it breaks (empty: accepted)."""
    required = [c for c in cfg.RAW_COLUMNS if c not in (cfg.ID, cfg.TARGET)]
    rules = [F.when(F.col(c).isNull(), f"{c} required") for c in required if c in df.columns]
    rules += [F.lit(f"{c} required") for c in required if c not in df.columns]
    for c in any_of(cfg.NUMERIC_COLUMNS, df.columns):
        value = number(df, c)
        rules.append(F.when(F.col(c).isNotNull() & value.isNull(), f"{c} not a number"))
        rules.append(F.when(value < 0, f"{c} below 0"))
        if c == "SeniorCitizen":
            rules.append(F.when(value > 1, f"{c} above 1"))
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def split_by_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) records."""
    checked = contract_violations(df)
    good = F.size("violations") == 0
    return checked.where(good).drop("violations"), checked.where(~good)
