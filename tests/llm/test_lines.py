"""Line dedup against a plain reading of its rule."""

import random

import pytest
from pyspark.sql import functions as F

from keepwell.llm import lines
from keepwell.llm.common import BLANKS


def plain(rows, least_chars=20, least_docs=3):
    """{row number: (kept text, lines, dropped)} by brute force."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                docs.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(docs.get(key(x), ())) < least_docs or max(docs[key(x)]) == i]
        out.append((i, "\n".join(kept) if len(kept) < len(own) else t, len(own), len(own) - len(kept)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in lines.dedup_lines(df).collect()]
    order = lambda r: tuple((x is None, x) for x in r if x is None or True)
    assert sorted(got, key=lambda r: str(order(r))) == sorted(plain(rows), key=lambda r: str(order(r)))


COMMON = "this line is shared by many documents"


@pytest.mark.parametrize("shard_bits,filter_bytes", [(23, 128 << 20), (10, 256)])
def test_random_lines(spark, monkeypatch, shard_bits, filter_bytes):
    monkeypatch.setattr(lines, "SHARD_BITS", shard_bits)
    monkeypatch.setattr(lines, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(lines, "POSITIONS_HELD", 50)
    rng = random.Random(5)
    pool = [f"{rng.choice('abcdÀé')}{i} some words that make a line long" for i in range(150)] + ["short"] * 5
    edge = ["  ", "\t", " ", "\x0b", ""]
    rows = [(i, "\n".join(rng.choice(edge) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(edge)
                          for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    check(spark, rows)


def test_cases(spark):
    rows = [(1, COMMON), (2, COMMON.upper() + "  "), (3, "\t" + COMMON + "\nown"), (4, None), (5, ""), (6, "\n\n"),
            (None, COMMON), (7, "x" * 19), (8, "x" * 19), (9, "X" * 19), (10, "y" * 20), (11, "Y" * 20), (12, "y" * 20),
            (13, "é" * 20), (14, "É" * 20), (15, "é" * 20), (16, "z" * 300_000), (17, "z" * 300_000), (18, "z" * 300_000),
            (19, "only twice, though it is long"), (20, "only twice, though it is long"),
            (21, "repeated within one document\n" * 4)]
    check(spark, rows)
    # Rows of one id are one document.
    check(spark, [(1, COMMON), (1, COMMON), (2, COMMON)])
    check(spark, [(1, COMMON), (1, COMMON), (2, COMMON), (3, COMMON)])


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(i, COMMON, "a", i, i) for i in range(4)], "doc_id long, text string, `n_lines` string, id int, `row` int") \
        .withColumn("digests", F.lit(3)).withColumn("a.b", F.lit(1))
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "id", "row", "digests", "a.b", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == [
        (0, 1, 1, ""), (1, 1, 1, ""), (2, 1, 1, ""), (3, 1, 0, COMMON)]
