"""Template decontamination against a token-by-token reading of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from keepwell.llm import templates as tp
from keepwell.llm.queries import op10_templates

QUESTION = "A train leaves the station at 9 with Anna Smith and travels 60 km before Anna Smith eats 3 apples, then 60 km more. How far did it go?"
CHANGED = "A train leaves the station at 7 with Bob and travels 85 miles before Bob eats 12 apples, then 85 miles more. How far did it go?"
MUDDLED = "A train leaves the station at 7 with Bob and travels 85 miles before Eve eats 12 apples, then 14 cups more. How far did it go?"


def plain_tokens(text, names_open=False):
    """[(kind, value)] by the rules, one token at a time; a sentence's first word may be a name in the second reading."""
    out, opens, was_number = [], True, False
    for raw in (text or "").split():
        parts = tp.PART.findall(raw)
        for p in parts:
            low = p.lower()
            if p[0].isdigit() or low in tp.NUMBER_WORDS:
                kind = tp.NUMBER
            elif low in tp.UNITS and was_number:
                kind = tp.UNIT
            elif p[0].isupper() and not p.isupper() and (names_open or not opens):
                kind = tp.NAME
            else:
                kind = tp.WORD
            was_number = kind == tp.NUMBER
            if kind == tp.NAME and out and out[-1][0] == tp.NAME and not opens:
                out[-1] = (tp.NAME, out[-1][1] + (low,))
            else:
                out.append((kind, (low,)))
            opens = False
        if parts:
            opens = bool(tp.ENDS.search(raw))
    return out


def exact_tokens(text):
    return [p for raw in (text or "").split() for p in tp.EXACT.findall(raw.lower())]


def indexed_places(own):
    n = min(tp.WINDOW, len(own))
    return [] if n < tp.LEAST_WORDS else [p for p in range(len(own) - n + 1) if sum(k == tp.WORD for k, _ in own[p:p + n]) >= tp.LEAST_WORDS]


def covered_by(doc, own):
    """(share of the item's windows, changed slots) in one reading, None where the text has too few of them."""
    show = lambda ts: tuple((k, v if k == tp.WORD else None) for k, v in ts)
    n, places, met = min(tp.WINDOW, len(own)), indexed_places(own), {}
    for p in places:
        for a in range(len(doc) - n + 1):
            if show(doc[a:a + n]) == show(own[p:p + n]):
                met.setdefault(a - p, []).append((p, a))
    covered, changed = set(), 0
    for hits in met.values():
        pairs = {(own[p + j][1], doc[a + j][1]) for p, a in hits for j in range(n) if own[p + j][0] != tp.WORD}
        values = {x for x, _ in pairs}
        if sum(len([1 for x, _ in pairs if x == v]) == 1 for v in values) >= len(values) * tp.CONSISTENT:
            covered |= {p for p, _ in hits}
            changed = max(changed, sum(x != y for x, y in pairs))
    return (len(covered) / len(places), changed) if places and len(covered) >= tp.COVERAGE * len(places) else None


def plain_hits(text, items):
    """{item: (coverage, changed slots)} by comparing all windows: first words as words, as names, then exact tokens of items without a window."""
    readings, exact, out = [plain_tokens(text), plain_tokens(text, True)], exact_tokens(text), {}
    for i, t in items:
        own = [plain_tokens(t), plain_tokens(t, True)]
        same = [k for k, _ in own[0]] == [k for k, _ in own[1]]
        hit = covered_by(readings[0], own[0]) or (None if same else covered_by(readings[1], own[1]))
        if not hit and not indexed_places(own[0]) and (signs := exact_tokens(t)):
            vague = len(signs) < tp.LEAST_WORDS or not any(c.isalpha() for c in t)
            whole = [exact[a:a + len(signs)] == signs for a in range(len(exact) - len(signs) + 1)]
            hit = (1.0, 0) if any(whole) and (not vague or len(exact) == len(signs)) else None
        if hit:
            out[i] = hit
    return out


def compare(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = tp.judge_documents(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    want = []
    for i, t in docs:
        h = plain_hits(t, [(a, b) for a, b in items if a is not None and b is not None])
        want.append((i, bool(h), sorted(h), round(max([c for c, _ in h.values()], default=0.0), 9), max([n for _, n in h.values()], default=0)))
    flat = lambda rows: sorted(map(str, rows))
    assert flat((r.doc_id, r.contaminated, r["items"], round(r.coverage, 9), r.changed_slots) for r in got) == flat(want)
    return {r.doc_id: r for r in got}


def test_changed_values(spark):
    filler = "some ordinary words come before it and more of them "
    out = compare(spark, [(1, filler + QUESTION), (2, filler + CHANGED + " " + filler), (3, filler + MUDDLED), (4, filler * 5),
                          (5, QUESTION.upper()), (6, "x\n".join(QUESTION.split(",")))],
                  [(10, QUESTION), (11, QUESTION), (12, "How much is 2 plus 2 in all?")])
    assert out[1]["items"] == [10, 11] and out[1].changed_slots == 0
    assert out[2].contaminated and out[2].changed_slots >= 3
    assert not out[3].contaminated and not out[4].contaminated
    assert out[5].contaminated and out[6].contaminated


def test_random(spark):
    rng = random.Random(4)
    pool = ["Alice", "Bob", "Carol Ann", "7", "12", "3.5", "km", "hours", "the", "cat", "sat", "on", "a", "mat.", "Then", "ran", "five",
            "5kg", "$3", "(it)", "don't", "é", "--", "%"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    docs = []
    for i in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        words[len(words) // 2:len(words) // 2] = rng.choice(items)[1].split() if i % 2 else []
        docs.append((i, " ".join(words)))
    compare(spark, docs, items)


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r["items"] for r in op10_templates(spark, sf_dir).where("contaminated").collect()}
    squeeze = lambda t: " ".join(t.split())
    whole = {i for i, t in docs if any(squeeze(x) in squeeze(t or "") for _, x in items)}
    assert whole and whole <= set(got)
    for i, t in docs:
        want = sorted(plain_hits(t, items)) if i in got or i % 10 == 0 else []
        assert got.get(i, []) == want


@pytest.mark.parametrize("bits", [24, 4])
def test_cases(spark, monkeypatch, bits):
    monkeypatch.setattr(tp, "FIELD_BITS", bits)
    docs = [(1, None), (2, ""), (3, " \n"), (None, QUESTION), (None, "clean text without a question in it"), (4, QUESTION), (4, QUESTION),
            (4, "other text of the same id"), (5, "word " * 60_000), (6, "plain tiny item"), (7, "1 2 3 4 5 6 7 8 9")]
    items = [(1, QUESTION), (2, None), (3, ""), (4, "plain tiny item"), (5, "1 2 3 4 5 6"), (None, "other text of the same id"), (6, "two words")]
    out = compare(spark, docs, items)
    assert out[6]["items"] == [4] and not out[7].contaminated
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, items int, id int, `mark` int") \
        .withColumn("row", F.lit(1)).withColumn("_id", F.lit(0)).withColumn("key", F.lit("k")).withColumn("h", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit(1))
    kept = tp.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "4", "5", "7"])
    assert tp.judge_documents(df.limit(0), bench).count() == 0
    assert tp.drop_contaminated(df, bench.limit(0)).count() == len(docs)
