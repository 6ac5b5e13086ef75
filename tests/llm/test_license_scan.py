"""Licence scan against a word-by-word reading of its rules."""

import random
import re

from pyspark.sql import functions as F

from keepwell.llm import license_scan as ls
from keepwell.llm.queries import op6_licenses


def plain(text):
    """(n_words, n_base, first, last, base labels, labels, score)."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in ls.PHRASES.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(own)] == own]
        places += at
        if at:
            base.add(label)
            score = 1.0
    for template, label in ls.TEMPLATES.items():
        own, met = template.split(), {}
        for i in range(len(words) - 1):
            for j in range(len(own) - 1):
                if words[i:i + 2] == own[j:j + 2]:
                    met.setdefault(i - j, []).append((i, j))
        runs, last = [], None
        for d in sorted(met):
            if last is None or d - last > ls.NEIGHBOURS:
                runs.append([])
            runs[-1] += met[d]
            last = d
        for run in runs:
            cover = len({j for _, j in run}) / (len(own) - 1)
            length = max(i for i, _ in run) + 2 - min(i for i, _ in run)
            if cover >= ls.LEAST_COVER and length <= ls.MOST_LENGTH * len(own):
                labels.add(label)
                score = max(score, cover)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), score)


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    got = ls.scan(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *plain(t))) for i, t in rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op6_licenses(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                                "base_labels": "string", "labels": "string", "score": "double"}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *plain(t))) for i, t in rows)


def test_cases(spark):
    rng = random.Random(2)
    words = sorted({w for t in [*ls.PHRASES, *ls.TEMPLATES] for w in t.split()}) + ["x", "é"]
    rows = [(1, None), (2, ""), (3, "CC"), (4, "CC BY"), (5, "cc-by cc by, CC  BY-NC 4.0"), (6, "İcc by Kcc by éall rights reserved"),
            (7, "All rights\nreserved; all rights reserved"), (8, "general public public license General Public License"),
            (None, "cc by"), (None, "cc by"), (None, None), (9, "Licensed under the well known Apache License, Version 2.0."),
            (9, "another text of this id: cc by"), (9, "another text of this id: cc by"), (10, "cc by " * 3000), (11, "y" * 200_000 + " cc by"),
            (12, "\U0001d4b3 cc by 日本語 cc by"), (13, "Licensed under the Apache License, Version 2.0. " * 3)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(40)]
    for i, t in enumerate(ls.TEMPLATES):
        own = t.split()
        rows.append((200 + i, t.upper()))
        for k in range(3):
            change = list(own)
            for _ in range(k + 1):
                at = rng.randrange(len(change))
                change[at:at + rng.randrange(2)] = rng.choice([[], ["extra"], ["two", "extra"]])
            rows.append((300 + 10 * i + k, "before " + " ".join(change) + " behind"))
    check(spark, rows)
    df = spark.createDataFrame(rows[:5], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "mark", "words", "score", "h", "n_words")})
    check(spark, rows[:5], df)
    assert ls.scan(df.limit(0)).count() == 0
