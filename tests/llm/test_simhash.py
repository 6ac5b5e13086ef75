"""SimHash components against brute force over all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keepwell.llm import simhash
from keepwell.llm.components import components
from keepwell.llm.queries import op4_simhash


def plain_fingerprint(text, k=4):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """{fp: least fp reachable}."""
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        if (new == label).all():
            return {int(x): int(u[i]) for x, i in zip(u, label)}
        label = new


def test_code():
    golay = simhash.Golay()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000)
    near = golay.near(words)
    codewords = np.array([w for w in range(0, 1 << 23, 1 << 11)])
    codewords = codewords ^ np.array([simhash.Golay._remainder(int(c)) for c in codewords])
    distance = np.bitwise_count(words[:, None] ^ codewords[None, :])
    for i in range(len(words)):
        assert set(near[i].tolist()) == set((codewords[distance[i] <= 4] >> 11).tolist())
        assert near[i][0] == codewords[distance[i].argmin()] >> 11


@pytest.mark.parametrize("errors", [1, 2, 3, 4])
def test_keys_meet(errors):
    rng = random.Random(errors)
    x = np.array([rng.getrandbits(64) for _ in range(3000)], dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.sample(range(64), errors):
            y[i] ^= np.uint64(1 << b)
    golay = simhash.Golay()
    of = lambda z: {(int(k), int(r)) for k, r in zip(*simhash.keys_of(golay, z))}
    assert {r for _, r in of(x) & of(y)} == set(range(len(x)))


@pytest.mark.parametrize("block", [2048, 8])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for _ in range(3):
        for x in fps[:60]:
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    center = fps[0]
    fps += [center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    want = plain_components(fps)
    classes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(fps)], "fp long")
    got = {r.node: r.component for r in components(simhash.links(classes)).collect()}
    groups = {}
    for x in set(fps):
        s = int(np.uint64(x).view(np.int64))
        groups.setdefault(got.get(s, s), set()).add(x)
    wanted = {}
    for x, c in want.items():
        wanted.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    label = plain_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    got = op4_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"{f:016x}", least[label[f]]) for i, f in fps.items())


def test_cases(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None), (4, ""), (9, " \t\n"), (3, "one"), (2, "ONE"), (7, "a b c"), (8, "a  b\nc"), (None, "one"),
            (None, "alone and without an id"), (11, words), (11, words), (12, words + " tail"), (20, "É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("id", F.lit(1))
    out = [tuple(r) for r in simhash.near_duplicates(df).select("id", "component_id").collect()]
    assert len(out) == len(rows)
    want = {5: 4, 4: 4, 9: 4, 3: 2, 2: 2, 7: 7, 8: 7, 11: 11, 12: 11, 20: 20}
    for i, c in out:
        assert c == (want[i] if i is not None else c)
    assert sorted((c is None, c) for i, c in out if i is None) == [(False, 2), (True, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.fingerprint("x" * 200_000, 4) == plain_fingerprint("x" * 200_000)
