"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import caps
from keepwell.llm.queries import op3_caps


def plain(rows):
    """[(id, n_links, component, kept)] by comparing all pairs; ids distinct."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = np.eye(len(rows), dtype=bool)
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y):
                linked[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    while True:
        new = np.where(linked, label[None, :], label.max()).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1) - 1, label)]


def test_recall():
    """Of pairs at exactly the least cosine, at least 99.8 % meet under some filter."""
    rng = np.random.default_rng(8)
    for vectors, length in ((50_000, 64), (100_000_000, 64), (10_000, 8), (10_000, 300)):
        x, z = rng.normal(size=(2, 1500, length))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = np.zeros(len(x), bool)
        size = caps.code_size(vectors, length)
        for t in range(caps.rotations(size[0])):
            code = caps.Codes.make(t, length, *size)
            met |= np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y))])
        assert met.mean() >= 0.998, (vectors, length, met.mean())


def clustered(rng, n, length, spread):
    centers = rng.normal(size=(max(1, n // 8), length))
    v = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, length)) * spread
    return v.astype(np.float32)


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(block)
    v = np.concatenate([clustered(rng, 300, 64, 0.15), clustered(rng, 60, 64, 0.3), 5 + rng.normal(size=(80, 64)) * 0.5])
    v = np.concatenate([v, v[:20], v[:20] * 3, rng.normal(size=(100, 64))]).astype(np.float32)
    ids = rng.permutation(len(v)) * 3 - 100
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op3_caps(spark, sf_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, -0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0]),
            (9, [2.0, 0.0]), (10, [1.0, -0.0]), (11, [-1.0, 0.0]), (12, [1.0]), (13, [5.0]), (14, [1.0, 0.0, 0.0]), (15, [1e300, 1e300]),
            (16, [1.0, 0.3]), (17, [1.0, 0.65])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "digest", "vec", "length")})
    want = plain([r for r in rows if r[0] != 15])
    got = sorted(map(tuple, caps.near_duplicates(df).collect()))
    assert [r for r in got if r[0] != 15] == sorted(want)
    more = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(map(str, map(tuple, caps.near_duplicates(more).collect()))) == sorted(map(str, [
        (1, 1, 1, True), (1, 1, 1, True), (1, 0, 1, True), (None, 0, None, True), (None, 0, None, True)]))
    assert caps.near_duplicates(df.limit(0)).count() == 0
