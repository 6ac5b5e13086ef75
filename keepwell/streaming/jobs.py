"""Scoring, redaction and quota counting of records as they arrive.

Every job reads a landing folder, writes parquet and keeps its progress in a
checkpoint folder.  Batches are written under their batch number, so a batch
that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keepwell import config as cfg
from keepwell.operators.clean import clean
from keepwell.operators.features import engineer
from keepwell.operators.redact import redact_log
from keepwell.operators.score import predict_batch
from keepwell.operators.validate import split_by_contract
from keepwell.sources.events import log_lines
from keepwell.sources.subscribers import RECORD_SCHEMA

WATERMARK = "10 minutes"


def read_records(spark: SparkSession, folder: str, schema: T.StructType = RECORD_SCHEMA,
                 files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def _quarantining(work: Callable[[DataFrame], DataFrame], quarantine: str) -> Callable:
    """`work` on the records that keep the request contract; the others are written aside, by batch."""
    def accepted(batch: DataFrame, number: int) -> DataFrame:
        good, bad = split_by_contract(batch)
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        return work(good)

    return accepted


def _per_batch(stream: DataFrame, work: Callable[..., DataFrame], out: str,
               checkpoint: str, mode: str = "append", numbered: bool = False) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        result = work(batch, number) if numbered else work(batch)
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scorecard_predictor(medians: dict[str, float], sequence: str | None = None) \
        -> Callable[[DataFrame], DataFrame]:
    """Prediction records of raw rows under fitted medians, both scorecards."""
    return lambda batch: predict_batch(
        engineer(clean(batch, medians, sequence)), challenger=cfg.CHALLENGER)


def score_stream(records: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str, event_time: str | None = None,
                 watermark: str = WATERMARK, quarantine: str | None = None) -> StreamingQuery:
    """Prediction records of each arriving batch, by any predictor of raw rows.

    Repeated ids are dropped within a batch; with an event-time column also
    across batches, as long as the watermark remembers them.  Anonymous records
    are all scored.  With a `quarantine` folder, records that break the request
    contract go there with their violations instead of being scored.
    """
    if event_time:
        timed = records.withWatermark(event_time, watermark)
        # An anonymous record is nobody's repetition: it gets a key of its own.
        records = timed.withColumn("_key", F.coalesce(F.col(cfg.ID), F.uuid())) \
            .dropDuplicatesWithinWatermark(["_key"]).drop(event_time, "_key")
    if quarantine:
        return _per_batch(records, _quarantining(predict, quarantine), out, checkpoint, numbered=True)
    return _per_batch(records, predict, out, checkpoint)


def redact_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Log lines with sensitive values masked; stateless, written as they come."""
    return redact_log(log_lines(events)).writeStream.outputMode("append").format("parquet") \
        .option("path", out).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def per_minute(events: DataFrame) -> DataFrame:
    """Requests per client and minute."""
    return events.groupBy("user_id", F.window("at", "1 minute").alias("w")) \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select("user_id", F.col("w.start").alias("minute"), "n")


def quota_breaches(events: DataFrame, limit: int) -> DataFrame:
    """Client minutes above the limit, over a whole table."""
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return per_minute(timed).where(F.col("n") > limit)


def quota_stream(events: DataFrame, out: str, checkpoint: str,
                 watermark: str = WATERMARK) -> StreamingQuery:
    """Running request counts per client and minute; rows past the watermark are dropped.

    `late_groups` tells how many; `spark.sql.streaming.numRecentProgressUpdates` bounds what it sees.

    Update mode: each batch writes the minutes it changed, the highest count
    of a minute is its latest.
    """
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("at")) \
        .withWatermark("at", watermark)
    return _per_batch(per_minute(timed), lambda b: b, out, checkpoint, mode="update")


def late_groups(query: StreamingQuery) -> int:
    """Groups (client and minute, per batch) that a finished stream dropped as later than its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def quota_breaches_of(counts: DataFrame, limit: int) -> DataFrame:
    """Breaches from the update-mode output of `quota_stream`."""
    return counts.groupBy("user_id", "minute").agg(F.max("n").alias("n")) \
        .where(F.col("n") > limit)
