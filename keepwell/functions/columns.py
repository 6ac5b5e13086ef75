"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BLANK_PATTERN = r"(?U)^\s*$"


def micro(col: Column) -> Column:
    """Six-decimal value by floor(x * 1e6 + 0.5) / 1e6, equal in every engine."""
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def flag(cond: Column) -> Column:
    """1 where true, 0 where false or unknown (a missing value never satisfies a test)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no plain number, and NaN, become null.

    The pattern guard keeps out spellings only some casts take ('1d', '1_000').
    """
    col = F.col(f"`{name}`")
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))
    if kind in ("double", "float"):
        return F.when(~F.isnan(col), col.cast("double"))
    return col.cast("double")


def strip(col: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def any_of(names: Sequence[str], available: Sequence[str]) -> list[str]:
    """The names that exist, in the order asked for."""
    have = set(available)
    return [n for n in names if n in have]


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup, null for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def select_or_zero(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly `keep` + `names`, in that order; a missing name becomes 0.0."""
    have = set(df.columns)
    cols = [F.col(f"`{n}`") if n in have else F.lit(0.0).alias(n) for n in names]
    return df.select(*any_of(keep, df.columns), *cols)


def model_label(df: DataFrame) -> Column:
    """Target as 1 / 0, null for anything else or when the column is absent."""
    if cfg.TARGET not in df.columns:
        return F.lit(None).cast("int")
    return F.when(F.col(cfg.TARGET) == "Yes", 1).when(F.col(cfg.TARGET) == "No", 0)
