"""Running totals and ranks over data too large for one task.

A window without a partition, or with one hot partition key, sorts everything
in a single task.  Here the order is cut into value ranges first: each range
is summarised (partial aggregation, one row per range), the summaries are
accumulated, and the exact running value is finished inside each range in
parallel.  The cut points only balance the work; any cut points give the same
result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def range_count(df: DataFrame) -> int:
    """Number of value ranges to work in: follows the session's shuffle width."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, columns: Sequence[str], n: int | None = None) -> dict[str, list]:
    """Approximate quantiles of each column, used as balanced cut points.

    One scan with partial aggregation; brings back at most `n` numbers a column.
    """
    n = n or range_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, max(1000, 10 * n)).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: sorted({float(x) for x in row[i]}) if row[i] else []
            for i, c in enumerate(columns)}


def with_range(df: DataFrame, column: str, cuts: Sequence[float], out: str = RANGE) -> DataFrame:
    """Add the range number of `column` (higher value, same or higher number)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = f"{out}_in"
    bucketed = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep") \
        .transform(df.withColumn(tmp, F.col(f"`{column}`").cast("double")))
    return bucketed.withColumn(out, F.col(out).cast("int")).drop(tmp)


def with_tied_range(df: DataFrame, column: str, tie: str, out: str = RANGE) -> DataFrame:
    """Range number over (column, tie), both numeric.

    A value of `column` that many rows share gets ranges of its own, cut along
    `tie`; without such values this is `with_range`.
    """
    n = range_count(df)
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(
        F.col(column).cast("double"), probs, max(1000, 10 * n))).first()[0] or []
    values = sorted(float(v) for v in found)
    hot = sorted({a for a, b in zip(values, values[1:]) if a == b})
    cuts = sorted({*values, *[math.nextafter(v, math.inf) for v in hot]})
    ranged = with_range(df, column, cuts, out)
    if not hot:
        return ranged
    shared = F.col(column).cast("double").isin(hot)
    inner = with_range(ranged, tie, cut_points(ranged.where(shared), [tie])[tie], "_inner")
    width = range_count(df) + 1
    return inner.withColumn(out, F.col(out).cast("bigint") * width + F.when(
        shared, F.col("_inner")).otherwise(0)).drop("_inner")


def hash_range(key: Column, ranges: int) -> Column:
    """Range number of an md5 text: as many leading hex digits as make that many ranges, even by construction."""
    return F.substring(key, 1, max(1, math.ceil(math.log(ranges, 16))))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    range_col: str = RANGE,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running values over `order` within `by`.

    `sums`  : name -> expression; running sum up to and including the row.
    `lasts` : name -> expression; latest non-null value up to and including the row.
    `range_col` must not decrease along `order` (or not increase when descending);
    `by` columns must not be null.

    Rows are partitioned by (by, range) for the summary, the join and the
    window alike, so a chain of these calls shuffles the rows once.
    """
    sums, lasts = sums or {}, lasts or {}
    direction = (lambda c: F.col(f"`{c}`").desc()) if descending else (lambda c: F.col(f"`{c}`"))
    src = df
    for name, expr in {**sums, **lasts}.items():
        src = src.withColumn(f"_v_{name}", expr)

    position = F.struct(*[F.col(f"`{c}`") for c in order])
    pick = F.min_by if descending else F.max_by
    totals = src.groupBy(*by, range_col).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
          for n in lasts],
    )
    before = Window.partitionBy(*by).orderBy(direction(range_col)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(f"`{b}`").alias(f"_b_{b}") for b in by], F.col(range_col).alias("_b_range"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_o_{n}") for n in lasts],
    )
    match = F.col(range_col) == F.col("_b_range")
    for b in by:
        match = match & (F.col(f"`{b}`") == F.col(f"`_b_{b}`"))
    inside = Window.partitionBy(*by, range_col).orderBy(*[direction(c) for c in order]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    joined = src.join(offsets, match, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n)
          for n in sums],
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_o_{n}")).alias(n)
          for n in lasts],
    )


def hash_rank(df: DataFrame, by: Sequence[str], key: str, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank within `by` in the order of an md5 text column, then `tie`."""
    ranged = df.withColumn(RANGE, hash_range(F.col(key), range_count(df)))
    return running(ranged, by, [key, tie], sums={out: F.lit(1).cast("bigint")}).drop(RANGE)
