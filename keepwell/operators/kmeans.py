"""k-means from several starts at once: every pass over the rows serves all starts.

First centres are drawn as k-means++ draws them: a row with a chance in proportion to its squared distance from
the centres so far.  Such a draw is a race: each row's time is exponential, at the rate of that distance, by
a hash of row, start and step, and the least time wins; so it is a minimum, which tasks take of
their own rows first.  Then a pass assigns the rows to the nearest centres of every start and adds up
sizes, sums and costs: one small row for each start and cluster leaves a task.  A start whose centres
hardly move any more rests; the last pass says what each start costs.

The same rows give the same centres however they are partitioned, but for the last bits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most, and the squared shift of all centres, in variances of a feature, at which a start rests.
MOST_PASSES, RESTS = 300, 1e-4
MARK = "_mark"


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """(features, rows): every step over them runs along the rows."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each row, added feature by feature; ties go to the lower number."""
    near, best = np.zeros(x.shape[1], np.int64), np.full(x.shape[1], np.inf)
    for c, center in enumerate(centers):
        far = np.zeros(x.shape[1])
        for column, at in zip(x, center):
            gap = column - at
            far += gap * gap
        np.copyto(near, c, where=far < best)
        np.minimum(best, far, out=best)
    return near, best


def _first(time: np.ndarray, x: np.ndarray) -> int | None:
    """The row of least time, of equal ones by their values; None where no time is finite."""
    least = np.fmin.reduce(time)
    if not np.isfinite(least):
        return None
    tied = np.flatnonzero(time == least)
    return int(tied[np.lexsort(x[:, tied])[0]])


def _uniform(marks: np.ndarray, start: int, step: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row."""
    x = marks.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + start * 8191 + step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _next_centers(rows: DataFrame, columns: Sequence[str], chosen: list[np.ndarray], step: int, seed: int) -> list[list[float] | None]:
    """The row that each start draws, None where all rows lie on its centres."""

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, list[float]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, marks = _matrix(batch, columns), batch.column(MARK).to_numpy()
            for s, centers in enumerate(chosen):
                rate = _nearest(x, centers)[1] if step else np.ones(len(marks))
                with np.errstate(divide="ignore"):
                    time = -np.log(_uniform(marks, s, step, seed)) / rate
                first = _first(time, x)
                if first is not None:
                    best[s] = min((float(time[first]), x[:, first].tolist()), best.get(s, (np.inf, [])))
        yield pa.RecordBatch.from_pydict({"s": pa.array(list(best), pa.int32()), "time": pa.array([t for t, _ in best.values()], pa.float64()),
                                          "x": pa.array([v for _, v in best.values()], pa.list_(pa.float64()))})

    won = {r["s"]: r["first"]["x"] for r in rows.mapInArrow(race, "s int, time double, x array<double>")
           .groupBy("s").agg(F.min(F.struct("time", "x")).alias("first")).collect()}
    return [won.get(s) for s in range(len(chosen))]


def _totals(rows: DataFrame, columns: Sequence[str], centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """{start: (sizes, sums, cost)} of an assignment to the nearest centres."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, columns)
            for s, own in centers.items():
                near, far = _nearest(x, own)
                sums = np.stack([np.bincount(near, w, len(own)) for w in (None, far, *x)], axis=1)
                total[s] = total.get(s, 0.0) + sums
        for s, sums in total.items():
            k = len(sums)
            yield pa.RecordBatch.from_pydict({"s": pa.array([s] * k, pa.int32()), "c": pa.array(range(k), pa.int32()),
                                              "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    width = len(columns) + 2
    found = rows.mapInArrow(assign, "s int, c int, sums array<double>").groupBy("s", "c").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
    out = {s: np.zeros((len(own), width)) for s, own in centers.items()}
    for r in found:
        out[r["s"]][r["c"]] = r["sums"]
    return {s: (v[:, 0], v[:, 2:], float(v[:, 1].sum())) for s, v in out.items()}


def fit(rows: DataFrame, columns: Sequence[str], k: int, starts: int, seed: int) -> list[tuple[float, list[list[float]]]]:
    """(cost, centres) of every start.  `rows` has the columns and MARK, a long that tells rows apart; it is read once a pass."""
    chosen: list[np.ndarray] = [np.zeros((0, len(columns)))] * starts
    for step in range(k):
        drawn = _next_centers(rows, columns, chosen, step, seed)
        if step == 0 and all(x is None for x in drawn):
            raise ValueError("no rows to fit")
        # Fewer different rows than clusters: the last centre stands twice, and its second cluster is empty.
        chosen = [np.vstack([c, x if x is not None else c[-1]]) for c, x in zip(chosen, drawn)]
    spread = rows.agg(*[F.var_pop(c) for c in columns]).first()
    limit = RESTS * float(np.mean([v or 0.0 for v in spread]))
    moving, done = dict(enumerate(chosen)), {}
    for _ in range(MOST_PASSES):
        further = {}
        for s, (sizes, sums, cost) in _totals(rows, columns, moving).items():
            own = moving[s]
            means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], own)
            done[s] = (cost, own.tolist())
            if ((means - own) ** 2).sum() > limit:
                further[s] = means
        moving = further
        if not moving:
            break
    return [done[s] for s in range(starts)]
