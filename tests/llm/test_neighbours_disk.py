"""The neighbour search writes little: floats stay floats, tables follow each other, only pairs of hot cells are copied."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import neighbours as nb


def written(monkeypatch):
    """Bytes that each saved frame takes in scratch when it is saved, and what has been removed again."""
    from pathlib import Path
    sizes, gone = {}, []
    save, drop = nb.saved, nb.discard

    def saving(df, name):
        out, path = save(df, name)
        sizes[path] = (name, sum(f.stat().st_size for f in Path(path.removeprefix("file://")).glob("*.parquet")))
        return out, path

    monkeypatch.setattr(nb, "saved", saving)
    monkeypatch.setattr(nb, "discard", lambda spark, path: gone.append(path) or drop(spark, path))
    return sizes, gone


@pytest.mark.parametrize("kind, most", [("float", 6), ("double", 12)])
def test_disk(spark, monkeypatch, kind, most):
    """All that stands at once is a small multiple of the vectors' bytes, and the same for floats and doubles."""
    rng = np.random.default_rng(5)
    rows = [(i, v.astype("<f4").tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    monkeypatch.setattr(nb, "CELL", 256)
    sizes, gone = written(monkeypatch)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nb.search(df, F.col("id") % 20 == 0, 5).collect()}
    assert len(got) == 1000
    x = np.array([v for _, v in rows])
    assert all(abs(s - x[q] @ x[i]) < 1e-9 for (q, _), (i, s) in got.items())
    by_name = {}
    for path, (name, size) in sizes.items():
        by_name.setdefault(name, []).append((size, path in gone))
    # Every table's cells and visits are removed before the next table's are written.
    assert len(by_name["ann-index"]) == nb.TABLES and all(g for n in ("ann-index", "ann-visits") for _, g in by_name[n])
    bytes_ = 4000 * 32 * 4
    assert by_name["ann-vectors"][0][0] + max(a[0] + b[0] for a, b in zip(by_name["ann-index"], by_name["ann-visits"])) < most * bytes_


def test_hot_cells(spark, monkeypatch):
    """A cell with many pairs of blocks gives what one with few gives."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, (np.ones(6) + rng.normal(size=6) * 0.05).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    found = lambda: sorted(map(tuple, nb.search(df, F.col("id") % 4 == 0, 6).collect()))
    want = found()
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "PAIRS", 3)
    got = found()
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
