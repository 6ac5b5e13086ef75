"""Later mentions of a person found in the same document."""

import pytest

from keepwell.llm import surrogate as sg

G, S = ("given-m", "john"), ("family", "smith")


@pytest.mark.parametrize("text,want", [
    ("Mr. John Smith came. John went home; Smith said so.", [G, S, G, S]),
    ("John was late. Dr. Smith's dog and SMITH, Smith-like, but smith or Smithson.", [S, S, S]),
    ("Mr. John Smith met Herr John. johnsmith John@x.example.com", [G, S, ("family", "john"), ("email", "john@x.example.com")]),
    ("Ask the Prof. The house is old. The end.", [("family", "the")]),
])
def test_mentions(text, want):
    assert [(k, f) for _, _, k, f in sg.entities(text)] == want


def test_no_name_stays(spark):
    text = "Mr. John Smith came. John went home, said Smith. John's hat was Smith's."
    df = spark.createDataFrame([(1, text), (2, "John went home")], "doc_id long, text string")
    got = {r.doc_id: r for r in sg.replace_entities(df, b"test").collect()}
    assert "John" not in got[1].text and "Smith" not in got[1].text and got[1].n_entities == 6
    words = got[1].text.replace(",", "").replace(".", "").split()
    assert words[1] == words[4] == words[9][:-2] and words[2] == words[8] == words[12][:-2]
    assert got[2].text == "John went home"
