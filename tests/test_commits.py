"""Commits of writers at once: versions without gaps, nothing lost, nothing of failed writers."""

import threading

import pytest
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.plans import train_job as jobs
from keepwell.sources import scratch
from keepwell.sources.commits import CommitLog
from keepwell.sources.runs import RunStore


def at_once(*works):
    errors = []

    def guarded(work):
        try:
            work()
        except Exception as e:  # looked at below
            errors.append(e)
    threads = [threading.Thread(target=guarded, args=(w,)) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return errors


def test_counter(spark):
    """Every commit is made from the one before it: a counter that eight writers raise."""
    log = CommitLog(spark, scratch.scratch_path(spark, "log"))

    def newest(version):
        return log.read("version long, n long").where(F.col("version") == version).first()["n"] if version else 0

    def work():
        for _ in range(4):
            log.append(lambda v: {"n": newest(v) + 1})
    assert at_once(*[work] * 8) == []
    rows = sorted(map(tuple, log.read("version long, n long").collect()))
    assert rows == [(i, i) for i in range(1, 33)] and log.version() == 32
    assert not log.create(32, {"n": 0}) and log.create(33, {"n": 33})


def history(metrics):
    def job(store, run):
        last = jobs.latest_decision(store)
        spark = store.spark
        spark.createDataFrame([(run, m, cfg.PRIMARY_METRIC, v) for m, v in metrics.items()], "run_id string, model string, metric string, value double") \
            .coalesce(1).write.parquet(store.path(run, "training_runs"))
        roles = (last["new_champion"], last["challenger"]) if last else ("logistic_regression", "gbt")
        return {"entries": [{"seq": last["seq"] + 1 if last else 1, "action": "retain" if last else "initial", "previous_champion": last["new_champion"] if last else None,
                             "new_champion": roles[0], "challenger": roles[1], "run_id": run, "threshold": 0.005}]}
    return job


def test_runs_and_rollbacks_at_once(spark):
    store = RunStore(spark, scratch.scratch_path(spark, "store"))
    store.run("r0", history({"logistic_regression": 0.84, "gbt": 0.83}))
    names = []
    works = [lambda i=i: names.append(store.run(f"r{i}", history({"logistic_regression": 0.8, "gbt": 0.81}))) for i in (1, 2, 3)]
    works += [lambda: jobs.rollback(store)] * 2 + [lambda: jobs.set_promotion_threshold(store, 0.01)]
    assert at_once(*works) == []
    commits = store.commits().orderBy("version").collect()
    assert [r["version"] for r in commits] == list(range(1, 8))
    entries = jobs.promotion_history(store).orderBy("seq").collect()
    assert [r["seq"] for r in entries] == list(range(1, 7))
    # Each entry starts from the roles that the entry before it left.
    for before, now in zip(entries, entries[1:]):
        assert now["previous_champion"] == before["new_champion"]
        swapped = now["action"] == "manual_rollback"
        assert (now["new_champion"] != before["new_champion"]) == swapped
    assert {r["run_id"] for r in commits if r["run_id"]} == {"r0", *names} and len(names) == 3
    assert store.current() in names and jobs.promotion_threshold(store) == 0.01
    # What a run wrote before it met another commit is gone.
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{store.base}/runs")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    assert {f.getPath().getName() for f in found} == {"r0", *names}


def test_failed_writers(spark):
    store = RunStore(spark, scratch.scratch_path(spark, "store"))

    def broken(s, run):
        spark.range(3).write.parquet(s.path(run, "t"))
        raise RuntimeError("boom")
    errors = at_once(*[lambda i=i: store.run(f"bad{i}", broken) for i in range(2)],
                     lambda: store.run("good", lambda s, run: spark.range(5).write.parquet(s.path(run, "t"))))
    assert len(errors) == 2 and store.current() == "good" and store.read("t").count() == 5
    assert [r["version"] for r in store.commits().collect()] == [1]
    with pytest.raises(ValueError, match="Cannot rollback"):
        jobs.rollback(store)
    assert store.log.version() == 1
