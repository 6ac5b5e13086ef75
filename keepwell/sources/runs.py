"""Published runs: all outputs of a training run become visible together.

A run writes its tables under runs/<run_id>.  Publishing is a commit to the store's log; readers
follow its newest run.  A failed run never commits, so readers keep seeing the run before.
Several writers at once are kept apart by the log: a run that finds another commit made
since it started is done again from what that commit says, under a name of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.sources.commits import MOST_TRIES, CommitLog, Conflict

_HISTORY = [("seq", "bigint"), ("action", "string"), ("previous_champion", "string"), ("new_champion", "string"),
            ("challenger", "string"), ("champion_metric", "double"), ("challenger_metric", "double"), ("delta", "double"),
            ("decided_at", "timestamp"), ("run_id", "string"), ("threshold", "double"),
            ("new_champion_metrics", "map<string,double>"), ("challenger_metrics", "map<string,double>")]
HISTORY_SCHEMA = ", ".join(f"{n} {t}" for n, t in _HISTORY)
#: One commit: a published run, entries of the promotion history, a promotion threshold, or several of these.
COMMIT_SCHEMA = "version bigint, at timestamp, run_id string, threshold double, entries array<struct<" \
    + ", ".join(f"{n}: {t}" for n, t in _HISTORY) + ">>"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


class RunStore:
    """Runs below one base folder."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, run_id: str, name: str) -> str:
        return f"{self.base}/runs/{run_id}/{name}"

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.base}/log")

    def commits(self) -> DataFrame:
        return self.log.read(COMMIT_SCHEMA)

    def published(self) -> DataFrame:
        """(run_id, version, published_at) of all publications, newest last."""
        return self.commits().where("run_id IS NOT NULL").select(
            "run_id", "version", F.col("at").alias("published_at")).orderBy("version")

    def current(self) -> str | None:
        row = self.commits().where("run_id IS NOT NULL").orderBy(F.desc("version")).limit(1).collect()
        return row[0]["run_id"] if row else None

    def read(self, name: str) -> DataFrame:
        """A table of the published run."""
        run_id = self.current()
        if run_id is None:
            raise FileNotFoundError("nothing published yet")
        return self.spark.read.parquet(self.path(run_id, name))

    def publish(self, run_id: str) -> None:
        self.log.append(lambda _: {"run_id": run_id, "at": utc_now()})

    def discard(self, run_id: str) -> None:
        """Remove an unpublished run's own folder."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.base}/runs/{run_id}")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            fs.delete(target, True)

    def run(self, run_id: str, job: Callable[[RunStore, str], dict | None]) -> str:
        """Run a job that writes its tables, then publish; discard them when it fails.

        What the job returns goes into the commit.  Where another commit came between, the
        job runs again and reads the store anew; returns the name that was published.
        """
        for nth in range(1, MOST_TRIES + 1):
            own, version = run_id if nth == 1 else f"{run_id}-{nth}", self.log.version()
            try:
                commit = job(self, own) or {}
            except Exception:
                self.discard(own)
                raise
            if self.log.create(version + 1, {"run_id": own, "at": utc_now(), **commit}):
                return own
            self.discard(own)
        raise Conflict(f"run {run_id} met other commits {MOST_TRIES} times")
