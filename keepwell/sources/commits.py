"""A log of numbered commits: writers at once take turns, readers see whole commits only.

A commit is one JSON file named by its version.  A writer reads the newest version, prepares what
follows from it, and creates the next file only if nobody else has; where somebody has, it
reads again and prepares anew.  So versions have no gaps, every commit was made in the knowledge
of all before it, and a writer that fails leaves nothing that a reader sees.

The file's content is written aside first and then takes its name in one step that fails where the
name is taken: a hard link on a mounted folder, a rename in HDFS and stores that rename like it.  A store
without such a step (plain object stores) needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Attempts against other writers after which a commit is given up.
MOST_TRIES = 50


class Conflict(RuntimeError):
    """Other writers were faster every time."""


class CommitLog:
    """Commits in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _local(self) -> Path | None:
        url = urlparse(self.folder)
        return Path(unquote(url.path)) if url.scheme in ("", "file") and self._scheme() == "file" else None

    def _hadoop(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _scheme(self) -> str:
        return self._hadoop()[1].getUri().getScheme()

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        path, fs = self._hadoop()
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, schema: str) -> DataFrame:
        """All commits; no rows before the first one."""
        if not self.version():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/[0-9]*.json")

    def create(self, version: int, commit: dict) -> bool:
        """Whether this commit is now the one of its version."""
        name = f"{version:012d}.json"
        body = json.dumps({"version": version, **commit}, sort_keys=True) + "\n"
        if (folder := self._local()) is not None:
            folder.mkdir(parents=True, exist_ok=True)
            aside = folder / f"_{uuid.uuid4().hex}"
            aside.write_text(body)
            try:
                os.link(aside, folder / name)
            except FileExistsError:
                return False
            finally:
                aside.unlink()
            return True
        aside, fs = self._hadoop(f"_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(body.encode())
        out.close()
        target, _ = self._hadoop(name)
        if not fs.exists(target) and fs.rename(aside, target):
            return True
        fs.delete(aside, False)
        return False

    def append(self, make: Callable[[int], dict]) -> dict:
        """Commit what `make` prepares for the newest version, again for a newer one where another writer was faster."""
        for _ in range(MOST_TRIES):
            version = self.version()
            commit = make(version)
            if self.create(version + 1, commit):
                return {"version": version + 1, **commit}
        raise Conflict(f"{MOST_TRIES} commits to {self.folder} met others")
