"""Surrogates: what is found, what it becomes, and that distinct entities stay distinct."""

import re

import pytest
from pyspark.sql import functions as F

from keepwell.llm import surrogate as sg
from keepwell.llm.queries import op8_surrogates

KEY = b"test"
FOUND = [
    ("mail ann.b@mail3.example.com now", [("email", "ann.b@mail3.example.com")]),
    ("the.65@mail7.example.com The of", [("email", "the.65@mail7.example.com")]),
    ("call +1 (068) 555-2123, or 206-555-0101.", [("phone", "+10685552123"), ("phone", "2065550101")]),
    ("card 5755695738806562 and 4111 1111 1111 1111", [("card", "5755695738806562"), ("card", "4111111111111111")]),
    ("ip 84.27.175.186, not 1.2.3.4.5 nor 300.1.1.1", [("ip", "84.27.175.186")]),
    ('token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" x', [("secret", "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587")]),
    ("5755695738806562 27.65.93.188 4111-1111-1111-1111 84.27.175.186", [
        ("card", "5755695738806562"), ("ip", "27.65.93.188"), ("card", "4111111111111111"), ("ip", "84.27.175.186")]),
    ("password=b7db7aa4a5fcc78305 enes, API_KEY: 'Zx81-q' pwd=none", [("secret", "b7db7aa4a5fcc78305"), ("secret", "Zx81-q")]),
    ("ssn 123-45-6789", [("ssn", "123456789")]),
    ("iban DE89 3704 0044 0532 0130 00 ok", [("iban", "DE89370400440532013000")]),
    ("Mr. John Smith met Mrs Smith and Dr. Emily Stone, also Мария Иванова", [
        ("given-m", "john"), ("family", "smith"), ("family", "smith"), ("given-f", "emily"), ("family", "stone"), ("given-f", "мария"), ("family", "иванова")]),
    ("Version 2.0 of CC BY-NC 4.0, 12 apples, 3 cups, in 2024-01-01 at 10:30", []),
    ("John went home. Herr came. a@b", []),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found(text, want):
    got = sg.entities(text)
    assert [(k, f) for _, _, k, f in got] == want
    assert all(sg.normal(k, text[a:b]) == f for a, b, k, f in got)


def test_formats():
    for text, want in FOUND:
        for a, b, kind, form in sg.entities(text):
            for attempt in (0, 1, 5):
                new = sg.surrogate(KEY, kind, form, attempt)
                out = sg.written(new, text[a:b], kind)
                assert new == sg.surrogate(KEY, kind, form, attempt) and new != form
                # The surrogate is an entity of the same type (names are by their context).
                shape = lambda x: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", x)))
                if kind in ("card", "ssn", "phone", "iban"):
                    assert shape(out) == shape(text[a:b]) and sg.normal(kind, out) == new
                if kind == "card":
                    assert sg.luhn(new) == sg.luhn(form) and new[0] == form[0]
                if kind == "email":
                    assert out.endswith(".com") and shape(out) == shape(text[a:b])
                if kind == "secret":
                    assert shape(new) == shape(form) if form == "Zx81-q" else re.fullmatch("[0-9a-f]+", new) and len(new) == len(form)
                if kind == "ip":
                    assert max(map(int, new.split("."))) < 255
                if kind == "given-f" and form == "emily":
                    assert new.endswith(sg.NAME_ENDS["f", sg.SCRIPTS[0]]) and out[0].isupper()
                if form == "мария":
                    assert re.fullmatch("[А-Я][а-я]+", out) and new.endswith(("а", "ина", "ия"))
    assert sg.surrogate(b"other", "card", "4111111111111111", 0) != sg.surrogate(KEY, "card", "4111111111111111", 0)
    assert sg.surrogate(KEY, "email", "a@x.org", 0).split("@")[1] == sg.surrogate(KEY, "email", "b@x.org", 0).split("@")[1]
    assert len(sg.surrogate(KEY, "ssn", "123", 40)) > 3


def mapping(before, after):
    """{entity: surrogate} over all texts, which must be a function and have no two entities on one surrogate."""
    out = {}
    for a, b in zip(before, after):
        olds = sg.entities(a)
        gaps, at, shift = [], 0, 0
        rest = b or ""
        for s, e, kind, form in olds:
            head = a[at:s]
            assert rest.startswith(head)
            rest = rest[len(head):]
            follows = a[e:olds[olds.index((s, e, kind, form)) + 1][0]] if (s, e, kind, form) != olds[-1] else a[e:]
            cut = rest.index(follows) if follows else len(rest)
            new, rest, at = rest[:cut], rest[cut:], e
            assert out.setdefault((kind, form), sg.normal(kind, new)) == sg.normal(kind, new)
    pools = {}
    for (kind, form), new in out.items():
        pool = "name" if kind == "family" or kind.startswith("given") else kind
        assert (pool, new) not in pools, (kind, form, new, pools[pool, new])
        pools[pool, new] = form
    real = {("name" if k == "family" or k.startswith("given") else k, f) for k, f in out}
    assert not real & set(pools)
    return out


@pytest.mark.parametrize("sent", [100_000, 0])
def test_collisions(spark, monkeypatch, sent):
    """Formats with hardly any room: every two-digit local part exists, so draws collide and are drawn again."""
    monkeypatch.setattr(sg, "SENT_ROWS", sent)
    texts = [f"write to {i:02d}@x.example.com, call +1 (206) 555-{i:04d}; 10.0.0.{i}" for i in range(90)] + ["write to 05@x.example.com only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in sg.replace_entities(df, KEY).collect()}
    got = mapping(texts, [rows[i].text for i in range(len(texts))])
    assert len(got) == 270 and rows[0].n_entities == 3 and rows[0].entity_types == "email,ip,phone"
    docs = sg._norm_columns(df, "doc_id", "text")
    assert sg.attempts(sg.occurrences(docs.select("id", "mark", "text")), KEY).count() > 10


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_surrogates(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    found = 0
    for i, t in docs.items():
        real = sg.entities(t)
        found += len(real)
        assert got[i].n_entities == len(real) and (real or got[i].text == t)
        assert not any(t[a:b] in got[i].text for a, b, _, _ in real)
    assert found
    assert mapping(list(docs.values()), [got[i].text for i in docs])


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "no data here"), (4, "a@b.example.com a@B.example.com"), (4, "a@b.example.com a@B.example.com"),
            (None, "c@d.example.com"), (5, "x" * 200_000 + " 1"), (6, "1" * 200_000), (7, "'" * 50_000 + "1"), (8, "a.b" * 60_000 + "@ 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("id", "mark", "row", "kind", "n", "n_entities", "later", "a.b")})
    out = sg.replace_entities(df, KEY)
    assert out.columns == [*df.columns, "entity_types"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == "no data here" and by[5].n_entities == 0 and by[8].n_entities == 0
    one, two = by[4].text.split()
    assert one.lower() == two.lower() != "a@b.example.com" and "c@d" not in by[None].text
    assert sg.replace_entities(df.limit(0), KEY).count() == 0


def test_whole_private_range(spark):
    """All addresses of 192.168/16 that can be drawn are entities: their surrogates leave the range, distinct, none of them real."""
    texts = [(a, " ".join(f"192.168.{a}.{b}" for b in range(1, 255))) for a in range(1, 255)]
    out = sg.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), key=b"k").collect()
    real = {x for _, t in texts for x in t.split()}
    drawn = [x for r in out for x in r.text.split()]
    assert len(drawn) == len(real) == 64_516 and len(set(drawn)) == len(drawn) and not set(drawn) & real
    assert all(x.startswith(("10.", "fd")) for x in drawn)


def test_addresses_never_run_out():
    forms = {sg.surrogate(b"k", "ip", "192.168.1.1", a) for a in range(60)}
    assert len(forms) >= 59 and {f.split(".")[0] for f in forms if "." in f} == {"192", "10"} and any(f.startswith("fd") for f in forms)
