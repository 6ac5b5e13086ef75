"""Masking of sensitive fields in records and in free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell import config as cfg


def _mask_field(text: Column, field: str) -> Column:
    """Masks one field's value where the text names the field at all."""
    quoted = rf"""('{field}'|"{field}")\s*:\s*('[^']*'|"[^"]*"|\d+\.?\d*)"""
    masked = F.regexp_replace(
        F.regexp_replace(text, quoted, f"$1: '{cfg.REDACTED}'"),
        rf"{field}=[^\s,}}]+", f"{field}={cfg.REDACTED}")
    return F.when(text.contains(field), masked).otherwise(text)


def _longest_first(fields: Sequence[str]) -> list[str]:
    return sorted(fields, key=lambda n: (-len(n), n))


def redact_text(text: Column, fields: Sequence[str] = cfg.SENSITIVE_FIELDS) -> Column:
    """Masks 'field': value, "field": value and field=value, longest names first.

    The one-element transform names the intermediate text, so that each step
    computes it once.  For a column of a table, `redact_log` is faster.
    """
    def named(value: Column, field: str) -> Column:
        return F.get(F.transform(F.array(value), lambda x: _mask_field(x, field)), F.lit(0))

    for f in _longest_first(fields):
        text = named(text, f)
    return text


def redact_log(lines: DataFrame, text: str = "msg",
               fields: Sequence[str] = cfg.SENSITIVE_FIELDS) -> DataFrame:
    """The same masking of a text column, one projection per field.

    A plain substring test precedes the substitutions, so the cost of a line
    follows the fields it names; all steps stay in generated code.
    """
    for f in _longest_first(fields):
        lines = lines.withColumn(text, _mask_field(F.col(text), f))
    return lines


def _redact(value: Column, kind: T.DataType, fields: Sequence[str]) -> Column:
    if isinstance(kind, T.StringType):
        return redact_text(value, fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redact(x, kind.elementType, fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) \
            and isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(
            k.isin(list(fields)), F.lit(cfg.REDACTED)).otherwise(redact_text(v, fields)))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[
            (F.lit(cfg.REDACTED) if f.name in fields
             else _redact(value[f.name], f.dataType, fields)).alias(f.name)
            for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def redact_record(df: DataFrame, fields: Sequence[str] = cfg.SENSITIVE_FIELDS) -> DataFrame:
    """Masks columns and nested fields by name, and text everywhere else."""
    return df.select(*[
        (F.lit(cfg.REDACTED) if f.name in fields
         else _redact(F.col(f"`{f.name}`"), f.dataType, fields)).alias(f.name)
        for f in df.schema.fields])
