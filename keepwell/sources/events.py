"""Record sets taken from the events table: training runs, log lines, client requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions.ordered import running, with_tied_range
from keepwell.sources.subscribers import table

MODEL_LINES = 20


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per training or rollback event of a model line, numbered in time order.

    `moment` is the event time as microseconds; its value range (RANGE) is kept,
    so that later scans along a line can work range by range as well.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    runs = ev.select(
        (F.col("user_id") % MODEL_LINES).alias("line"), "event_id",
        F.expr("unix_micros(cast(ts as timestamp))").alias("moment"),
        F.when(F.col("event_id") % 37 == 0, "rollback").otherwise("train").alias("kind"),
        (F.lit(0.80) + (F.col("event_id") * 7 % 41) / F.lit(1000.0)).alias("lr_auc"),
        (F.lit(0.60) + (F.col("event_id") * 13 % 31) / F.lit(100.0)).alias("lr_recall"),
        (F.lit(0.80) + (F.col("event_id") * 11 % 43) / F.lit(1000.0)).alias("gbt_auc"),
        (F.lit(0.60) + (F.col("event_id") * 17 % 29) / F.lit(100.0)).alias("gbt_recall"),
    )
    return running(with_tied_range(runs, "moment", "event_id"), ["line"], ["moment", "event_id"],
                   sums={"seq": F.lit(1).cast("bigint")})


LOG_TEXT = """concat('line user=', cast(user_id as string), ' customerID=CUST-',
  cast(user_id as string), ' MonthlyCharges=', cast(cast(value as decimal(12,2)) as string),
  ' {', chr(39), 'tenure', chr(39), ': ', cast(event_id % 72 as string),
  ', "PaymentMethod": "Mailed check", ', chr(39), 'note', chr(39), ': ', chr(39), 'ok',
  chr(39), '}')"""


def log_lines(events: DataFrame) -> DataFrame:
    """Application log lines, one per event (also for a stream of events)."""
    return events.select("event_id", "ts", F.expr(LOG_TEXT).alias("msg"))
