"""Importance resampling against plain sums; the automaton against CRCs of strings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keepwell.llm import resampling as rs


def plain_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_features(text, words):
    own = plain_words(text)
    return [zlib.crc32(" ".join(own[i:i + k]).encode()) for k in range(1, words + 1) for i in range(len(own) - k + 1)]


def plain(docs, target, words=1, buckets=10_000, least=20, percent=10):
    s = Counter(c % buckets for _, t in docs for c in plain_features(t, words))
    t = Counter(c % buckets for x in target for c in plain_features(x, words))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        own = [gain[c % buckets] for c in plain_features(x, words)]
        weight, score = sum(own) // len(own) if own else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(plain_words(x)), len(own), weight, score, None])
    able = [r for r in out if r[1] >= least and r[0] is not None]
    for rank, r in enumerate(sorted(able, key=lambda r: (-r[4], r[0], -r[2]))[:len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(str, map(tuple, out)))


def check(spark, docs, target, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rs.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    names = {"least_words": "least"}
    assert sorted(map(str, map(tuple, got.collect()))) == plain(docs, target, **{names.get(k, k): v for k, v in options.items()})


@pytest.mark.parametrize("options", [{}, {"words": 3, "buckets": 50, "least_words": 5, "percent": 60}])
def test_random(spark, options):
    rng = random.Random(9)
    pool = ["The", "cat", "2nd", "à", "être", "日本", "x" * 100, "don't", "--", "A", "é.é"] + [f"w{i}" for i in range(300)]
    docs = [(i, rng.choice([" ", "  ", ", "]).join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    check(spark, docs, [t for _, t in docs[:7]] + [None, ""], **options)


def test_odd_rows(spark):
    same = "one two three " * 10
    rows = [(None, same), (None, None), (1, None), (2, ""), (3, same), (3, same), (3, same + "four"), (4, "word " * 700_000), (5, "y" * 2_500_000), (-6, same)]
    check(spark, rows, ["one word"], percent=50)
    check(spark, rows[:3], [])
    check(spark, [], ["one"])
    extra = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS raw", "3 AS weight", "4 AS rank", "5 AS _down", "6 AS `a.b`")
    assert rs.resample(extra, extra).count() == len(rows)


def test_composed_crcs():
    zeros, rng = rs.Zeros(), random.Random(1)
    for _ in range(100):
        a, b = rng.randbytes(rng.randrange(20)), rng.randbytes(rng.randrange(2000))
        assert zeros.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("most", [0, 300, rs.DICTIONARY_CHARS])
def test_any_dictionary(most, monkeypatch):
    """Its size, and where texts are cut, change no feature."""
    rng, reader, zeros = random.Random(2), rs.Reader(most), rs.Zeros()
    monkeypatch.setattr(rs.delimited, "__defaults__", (29,))
    for _ in range(300):
        text = "".join(rng.choice(["ab", "É", "à", " ", " ", ".", "z" * 70, "7"]) for _ in range(rng.randrange(80)))
        got = [c for run in rs.feature_crcs(reader, zeros, text.encode(), 3) for c in run.tolist()]
        assert sorted(got) == sorted(plain_features(text, 3))
    assert reader.chars <= most
