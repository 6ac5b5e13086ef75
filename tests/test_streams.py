"""Stream results equal batch results; repeated ids across batches."""

from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import clean, features, score
from keepwell.sources import scratch, subscribers
from keepwell.streaming import jobs as streaming


def test_repeated_ids_within_and_across_batches(spark, sf_dir):
    raw = subscribers.subscribers(spark, sf_dir).withColumn(
        "arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    landing = scratch.scratch_path(spark, "landing")
    for _ in range(2):  # the same records arrive twice, in files of their own
        raw.coalesce(1).write.mode("append").parquet(landing)
    medians = clean.fit_medians(raw)
    out, progress = (scratch.scratch_path(spark, n) for n in ("out", "progress"))
    records = streaming.read_records(spark, landing, raw.schema, files_per_batch=1)
    streaming.score_stream(
        records, streaming.scorecard_predictor(medians), out, progress, event_time="arrived") \
        .awaitTermination()
    got = streaming.read_batches(spark, out)
    n = raw.count()
    assert got.count() == n and got.select(cfg.ID).distinct().count() == n
    batch = score.predict_batch(features.engineer(clean.clean(raw.drop("arrived"), medians)))
    both = got.join(batch.select(cfg.ID, F.col("churn_probability").alias("p")), cfg.ID)
    assert both.where("churn_probability = p").count() == n


def test_anonymous_records_are_nobodys_repetition(spark, sf_dir):
    raw = subscribers.subscribers(spark, sf_dir).limit(20).withColumns({
        cfg.ID: F.lit(None).cast("string"), "arrived": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    landing = scratch.scratch_path(spark, "landing")
    raw.coalesce(1).write.parquet(landing)
    out, progress = (scratch.scratch_path(spark, n) for n in ("out", "progress"))
    records = streaming.read_records(spark, landing, raw.schema)
    streaming.score_stream(records, streaming.scorecard_predictor(clean.fit_medians(raw)), out, progress,
                           event_time="arrived").awaitTermination()
    assert streaming.read_batches(spark, out).count() == 20


def test_quota_counts_build_up_over_batches(spark):
    landing = scratch.scratch_path(spark, "events")
    rows = [(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (2, "2024-01-01 00:00:20")]
    late = [(1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:01:20")]
    schema = "user_id long, ts string"
    for part in (rows, late):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")) \
            .coalesce(1).write.mode("append").parquet(landing)
    source = spark.read.parquet(landing)
    events = streaming.read_records(spark, landing, source.schema, files_per_batch=1)
    out, progress = (scratch.scratch_path(spark, n) for n in ("quota", "progress"))
    streaming.quota_stream(events, out, progress).awaitTermination()
    got = streaming.quota_breaches_of(streaming.read_batches(spark, out), 2).collect()
    want = streaming.quota_breaches(source, 2).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0]["n"] == 3


def test_late_requests_are_dropped_and_counted(spark):
    landing = scratch.scratch_path(spark, "events")
    files = [[(1, "2024-01-01 00:00:10")], [(1, "2024-01-01 05:00:00")], [(1, "2024-01-01 06:00:00")],
             [(1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:00:20"), (1, "2024-01-01 06:00:30")]]
    for part in files:
        spark.createDataFrame(part, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")) \
            .coalesce(1).write.mode("append").parquet(landing)
    events = streaming.read_records(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
    out, progress = (scratch.scratch_path(spark, n) for n in ("quota", "progress"))
    query = streaming.quota_stream(events, out, progress)
    query.awaitTermination()
    assert streaming.late_groups(query) == 2
    counts = streaming.read_batches(spark, out).groupBy("user_id", "minute").agg(F.max("n").alias("n")).collect()
    assert {(r["user_id"], r["minute"].hour, r["n"]) for r in counts} == {(1, 0, 1), (1, 5, 1), (1, 6, 2)}
