"""Reports, segments, redaction and published runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import redact, reports, segment
from keepwell.sources import scratch
from keepwell.sources.runs import RunStore

ROWS = [(60, 110.0, 5000.0, 8.0, .10), (55, 105.0, 4800.0, 7.5, .15), (8, 95.0, 900.0, 4.0, .80),
        (6, 100.0, 700.0, 3.5, .85), (10, 35.0, 400.0, 2.0, .70), (9, 30.0, 350.0, 1.5, .75),
        (3, 80.0, 250.0, 2.5, .65), (2, 75.0, 200.0, 2.0, .60), (30, 60.0, 2200.0, 5.0, .25),
        (28, 58.0, 2100.0, 4.8, .20)]
SCHEMA = "tenure int, MonthlyCharges double, clv_estimate double, engagement_score double, " \
         "churn_probability double"


def test_kpis(spark):
    df = spark.createDataFrame([(.8, 1000.0), (.3, 500.0), (.75, 800.0), (.1, 200.0)],
                               "churn_probability double, clv_estimate double")
    got = reports.executive_kpis(df).first()
    assert got["churn_rate"] == pytest.approx(.4875)
    assert got["revenue_at_risk"] == pytest.approx(1570)
    assert got["high_risk_count"] == 2 and got["avg_clv"] == 625
    bound = spark.createDataFrame([(.69,), (.7,), (.95,)], "churn_probability double")
    assert reports.executive_kpis(bound).first()["high_risk_count"] == 2


def test_kpis_of_raw_records(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,), ("No",)], "Churn string")
    got = reports.executive_kpis(df).first()
    assert tuple(got) == (0.25, 0.0, 0, 0.0)


def test_segment_value(spark):
    df = spark.createDataFrame([("A", 100.0), ("A", 200.0), ("B", 50.0), (None, 7.0), ("C", None)],
                               "segment string, clv_estimate double")
    got = {r["segment"]: r["clv_estimate"] for r in reports.segment_clv(df).collect()}
    assert got == {"A": 300.0, "B": 50.0, "C": 0.0}
    assert reports.segment_clv(df.drop("segment")) is None


def test_many_lookups(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias(cfg.ID), "id")
    wanted = spark.createDataFrame([("3",), ("7",), ("none",)], f"{cfg.ID} string")
    assert sorted(r["id"] for r in reports.customers_lookup(df, wanted).collect()) == [3, 7]


def test_segments_are_one_to_one(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    fitted = segment.Segmentation.fit(df, starts=5)
    assert sorted(fitted.mapping) == list(range(5))
    assert sorted(fitted.mapping.values()) == sorted(cfg.SEGMENT_LABELS)
    got = fitted.assign(df).collect()
    # Two clusters score alike for the first label (long tenure, low risk); the
    # lower cluster number wins.  The pairs stay together.
    loyal = {r["tenure"] for r in got if r["segment"] == "High Value Loyal"}
    assert loyal in ({60, 55}, {30, 28})
    at = {r["tenure"]: r["segment"] for r in got}
    assert all(at[a] == at[b] for a, b in ((60, 55), (8, 6), (10, 9), (3, 2), (30, 28)))


def test_segments_of_equal_rows(spark):
    df = spark.createDataFrame([(12, 50.0, 600.0, 3.0, .4)] * 50, SCHEMA)
    fitted = segment.Segmentation.fit(df, starts=2)
    assert sorted(fitted.mapping) == list(range(5))
    assert fitted.assign(df).select("segment").distinct().count() == 1


def test_segments_without_a_column_and_after_reload(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    fitted = segment.Segmentation.fit(df, starts=3)
    path = scratch.scratch_path(spark, "segments")
    fitted.save(spark, path)
    again = segment.Segmentation.load(spark, path)
    assert again == fitted
    assert again.assign(df.drop("engagement_score")).where("segment is null").count() == 0


def test_unknown_cluster_gets_the_fallback(spark):
    fitted = segment.Segmentation(
        {c: (0.0, 1.0) for c in cfg.SEGMENT_FEATURES}, [[0.0] * 5, [100.0] * 5], {0: "New At Risk"})
    got = fitted.assign(spark.createDataFrame(ROWS[:1], SCHEMA)).first()
    assert got["cluster_id"] == 1 and got["segment"] == "Stable Customers"


def test_redaction_literals(spark):
    df = spark.createDataFrame([("customerID=CUST-999 MonthlyCharges=70.0",),
                                ("{'tenure': 5, \"gender\": \"Male\", 'note': 'x'}",)],
                               "msg string")
    got = [r["msg"] for r in redact.redact_log(df).collect()]
    assert got == ["customerID=[REDACTED] MonthlyCharges=[REDACTED]",
                   "{'tenure': '[REDACTED]', \"gender\": '[REDACTED]', 'note': 'x'}"]


def test_both_redactions_equal_the_substitution_chain(spark):
    fields = sorted(cfg.SENSITIVE_FIELDS, key=lambda n: (-len(n), n))

    def chain(text):
        for f in fields:
            text = re.sub(rf"""('{f}'|"{f}")\s*:\s*('[^']*'|"[^"]*"|\d+\.?\d*)""",
                          r"\1: '[REDACTED]'", text)
            text = re.sub(rf"({f}=)([^\s,}}]+)", r"\1[REDACTED]", text)
        return text

    rnd = random.Random(5)
    parts = ["tenure", "gender", "MonthlyCharges", "'tenure'", '"gender"', "=", ":", " ", "'x'",
             '"y"', "3.5", ",", "}", "xtenure=", "Partner=", "note", "'Partner': "]
    lines = ["".join(rnd.choice(parts) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, msg string")
    want = [chain(t) for t in lines]
    logged = redact.redact_log(df).orderBy("i").collect()
    assert [r["msg"] for r in logged] == want
    named = df.withColumn("msg", redact.redact_text(F.col("msg"))).orderBy("i").collect()
    assert [r["msg"] for r in named] == want


def test_nested_records_are_masked(spark):
    df = spark.sql("""select named_struct('customerID', 'C1', 'n', 3, 'deep',
        array(named_struct('tenure', 4, 'text', 'tenure=9'))) as body,
        map('gender', 'Male', 'k', 'Partner=Yes') as m, 5 as tenure, 7 as kept""")
    got = redact.redact_record(df).first()
    assert got["body"]["customerID"] == "[REDACTED]" and got["body"]["n"] == 3
    assert got["body"]["deep"][0]["tenure"] == "[REDACTED]"
    assert got["body"]["deep"][0]["text"] == "tenure=[REDACTED]"
    assert got["m"] == {"gender": "[REDACTED]", "k": "Partner=[REDACTED]"}
    assert got["tenure"] == "[REDACTED]" and got["kept"] == 7


def test_failed_run_leaves_the_published_one(spark):
    store = RunStore(spark, scratch.scratch_path(spark, "runs"))
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.run("r1", lambda s, r: spark.range(3).write.parquet(s.path(r, "t")))

    def broken(s, r):
        spark.range(9).write.parquet(s.path(r, "t"))
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError):
        store.run("r2", broken)
    assert store.current() == "r1" and store.read("t").count() == 3
    from keepwell.sources.subscribers import path_exists
    assert not path_exists(spark, store.path("r2", "t"))
    store.run("r3", lambda s, r: spark.range(5).write.parquet(s.path(r, "t")))
    assert store.read("t").count() == 5 and store.published().count() == 2


def test_scratch_is_cleared_by_session(spark):
    from keepwell.sources.subscribers import path_exists
    df = scratch.materialize(spark.range(3), "t")
    folder = scratch._session_folder(spark)
    assert df.count() == 3 and path_exists(spark, folder)
    scratch.clear_scratch(spark)
    assert not path_exists(spark, folder)
