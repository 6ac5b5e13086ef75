"""Neighbour search: scores and order are exact, recall against brute force, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import neighbours as nb
from keepwell.llm.queries import op13_neighbours

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, asked=lambda i: i % 20 == 0):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if asked(q):
            best = out.setdefault(q, {})
            for i, w in ok:
                if i != q and len(w) == len(v):
                    s = float((np.array(v) * np.array(w)).sum())
                    best[i] = max(s, best.get(i, -math.inf))
    return {q: sorted(((-s, i) for i, s in b.items()))[:k] for q, b in out.items()}


def found(spark, rows, k, schema=SCHEMA):
    got = nb.search(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((-r.score, r.vec_id))
        assert r["rank"] == len(own) and r.vec_id != r.query_id
    for own in out.values():
        assert own == sorted(own) and len({i for _, i in own}) == len(own)
    return out


def recall(got, want):
    total = sum(map(len, want.values()))
    return sum(len({i for _, i in want[q]} & {i for _, i in got.get(q, [])}) for q in want) / total


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = plain(rows, 20), {}
    for r in op13_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("kind", ["clusters", "random", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24))
    if kind == "clusters":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] * 3 + x * 0.3
    if kind == "norms":
        x *= np.exp(rng.normal(size=(6000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = plain(rows, 10, lambda i: i % 600 == 0), found(spark, rows, 10)
    assert len(got) == 300 and all(len(v) == 10 for v in got.values())
    scores = {(q, i): s for q, own in plain(rows, 6000, lambda i: i % 600 == 0).items() for s, i in own}
    assert all(abs(scores[q, i] - s) < 1e-9 for q in want for s, i in got[q])
    assert recall({q: got[q] for q in want}, want) >= 0.9


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    assert found(spark, rows, 7) == plain(rows, 7)
    assert found(spark, rows[:5], 20) == plain(rows[:5], 20)
    assert found(spark, rows[:1], 20) == {} and found(spark, [], 20) == {}
    assert found(spark, rows[1:20], 20) == {}


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-3.0, 1.0]), (None, [9.0, 9.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [math.nan, 1.0]),
            (6, [math.inf, 1.0]), (7, [1.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (8, [1.0, 2.5]), (9, [2.0, 1.0]), (20, [1e150, -1e150]), (40, [5.0]), (10, [1.0, 2.0])]
    assert found(spark, rows, 3) == plain(rows, 3)
    extra = spark.createDataFrame([(i, [1.0, float(i)], 1, 2, 3, 4) for i in range(30)], SCHEMA + ", id long, cell long, length int, `a.b` int")
    assert nb.search(extra, F.col("id") % 20 == 0, 4).count() == 8


def test_one_group_of_copies(spark, monkeypatch):
    """Near and exact copies beyond a block's size, and one id on very many rows."""
    monkeypatch.setattr(nb, "BLOCK", 64)
    monkeypatch.setattr(nb, "CELL", 64)
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + (rng.normal(size=8) * 1e-3 if i % 2 else 0)).tolist()) for i in range(500)]
    rows += [(1000 + i, rng.normal(size=8).tolist()) for i in range(300)] + [(5, rng.normal(size=8).tolist()) for _ in range(200)]
    want = plain(rows, 10)
    got = found(spark, rows, 10)
    assert recall({q: v for q, v in got.items() if q < 500}, {q: v for q, v in want.items() if q < 500}) >= 0.95
    assert set(got) == set(want)


def test_visits_in_order():
    place = np.array([3.1, -0.4, 7.9])
    cells = list(nb.visited(place, 0.8, 0.95))
    assert cells[0] == (3, -1, 7) and len(set(cells)) == len(cells)

    def chance(cell):
        law = lambda z: 0.5 * (1 + math.erf(z * nb.WIDTH / (0.8 * math.sqrt(2))))
        return math.prod(law(c + 1 - a) - law(c - a) for c, a in zip(cell, place))
    chances = [chance(c) for c in cells]
    assert all(a >= b - 1e-12 for a, b in zip(chances, chances[1:]))
    assert sum(chances) >= 0.95 > sum(chances[:-1])
    everywhere = [(a, b, c) for a in range(-2, 9) for b in range(-6, 6) for c in range(2, 14)]
    assert not [c for c in everywhere if chance(c) > chances[-1] + 1e-12 and c not in set(cells)]


def test_large_values():
    unit, norms = nb.units(np.array([[1e200, 2e200], [3.0, 4.0], [1e-200, 0.0]]))
    assert np.allclose(np.linalg.norm(unit, axis=1), 1) and norms[1] == 5 and np.isfinite(norms).all()
