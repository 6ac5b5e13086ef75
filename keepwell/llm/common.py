"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.sources.scratch import scratch_path

#: Rows and bytes of an Arrow batch that carries whole texts; Spark's own bounds are meant for short rows.
TEXT_ROWS, TEXT_BATCH_BYTES = 2000, 16 << 20
#: What `[\x20\x09-\x0D]` matches.
BLANKS = " \t\n\x0b\x0c\r"


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small enough for long texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def worker_state(owner: str) -> dict:
    """What `owner` keeps in this Python worker; functions sent by value have no lasting globals.

    Workers serve one operator after the other.  What another owner has kept is given up first, so that
    a worker never holds more than one operator's tables; operators without any call this for that.
    """
    state = vars(sys.modules.setdefault("_keepwell_worker", ModuleType("_keepwell_worker")))
    if owner not in state:
        for other in [k for k in state if not k.startswith("__")]:
            del state[other]
        spare()
        state[owner] = {}
    return state[owner]


def spare() -> None:
    """Hand memory that nothing uses back to the system: freed pages stay with a worker's allocators else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that hands spare memory back at its end: workers outlive their tasks, beside those of later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            spare()

    return tidied


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns of these names: what an operator adds replaces what was there."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def whole_rows(df: DataFrame, **columns: str) -> DataFrame:
    """Each row as the struct `row`, beside the named columns under the operator's own names.

    Whatever else the input calls its columns can't clash with what the operator adds.
    """
    return df.select(*[F.col(quoted(c)).alias(n) for n, c in columns.items()],
                     F.struct(*[quoted(c) for c in df.columns]).alias("row"))


def rows_back(df: DataFrame, source: DataFrame, **values: "F.Column") -> DataFrame:
    """The struct's columns again, those named in `values` replaced or added."""
    new = {n.lower(): v.alias(n) for n, v in values.items()}
    kept = [new.pop(c.lower()).alias(c) if c.lower() in new else F.col(f"row.{quoted(c)}")
            for c in source.columns]
    return df.select(*kept, *new.values())


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows with at most `most_bytes` of text, at least one row each."""
    array = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0).to_numpy(zero_copy_only=False))
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most_bytes:
            yield first, array.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += n
    if first < len(array):
        yield first, array.slice(first).to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the runs (starts, lengths) named by `which`, one run after the other."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts[which] - (ends - n), n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame written to the shared scratch folder and read back, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a saved frame that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
