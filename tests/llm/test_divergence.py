"""The source audit against a plain count; odd rows; blocks of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from keepwell.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=2, top=50):
    docs = [(a or "", b or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t, a, b in rows]
    own, total, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for a, b, ts in docs:
        own[a, b].update(ts)
        total[a].update(ts)
        seen[a].update(set(ts))
    out = []
    for (a, b), counts in own.items():
        kept = [t for t, n in seen[a].items() if n >= least]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = shares(counts), shares(total[a])
        pairs = [(-sum(abs(p[t] - r[t]) for t in kept), y.encode(), y) for (x, y), c in own.items() if x == a and y != b for r in [shares(c)]]
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if counts[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(a, b, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def check(spark, rows, **options):
    got = dv.audit(spark.createDataFrame(rows, SCHEMA), least_documents=2, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, top=options.get("top_terms", 50))


@pytest.mark.parametrize("blocks", [{}, {"groups_a_block": 2, "terms_a_block": 3, "top_terms": 4}])
def test_random(spark, blocks):
    rng = random.Random(3)
    words = ["The", "the", "cat", "dög", "Ünder", "it's", "x1y", "日本", "ЖУК", "a", "b", "c"] + [f"w{chr(97 + i)}" for i in range(15)]
    rows = [(i, rng.choice(["", " - ", "\n"]).join([" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))] * rng.randrange(1, 3)),
             rng.choice(["en", "en", "en", "de"]), f"s{rng.randrange(9)}") for i in range(150)]
    check(spark, rows, **blocks)


def test_odd_rows(spark):
    long = "alpha beta " * 150_000
    rows = [(1, None, None, None), (1, None, None, None), (2, "one two", "en", "a"), (2, "one two", "en", "a"), (None, "one", "en", "b"), (3, "", "en", None),
            (4, long, "en", "b"), (5, long + "x" * 3_000_000 + " end", "en", "a"), (6, "only", "fr", "a"), (7, "solo", "fr", "b"), (8, "1 2 3", "xx", "a")]
    check(spark, rows, groups_a_block=1, terms_a_block=1)
    assert dv.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns(spark):
    rows = [(i, "red green blue", "en", "a" if i % 3 else "b") for i in range(9)]
    plainly = spark.createDataFrame(rows, SCHEMA)
    more = plainly.selectExpr("*", "text AS term", "source AS item", "1 AS n", "2 AS p", "3 AS value", "4 AS rank", "5 AS block", "6 AS g", "7 AS `a.b`")
    assert sorted(map(tuple, dv.audit(more).collect())) == sorted(map(tuple, dv.audit(plainly).collect()))


def test_pieces():
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice("ab é1. \n") for _ in range(rng.randrange(60))).encode()
        want = raw.translate(dv._LETTERS).split()
        assert [w for ws in dv.pieces(raw, dv._LETTERS, rng.randrange(1, 9)) for w in ws] == want
