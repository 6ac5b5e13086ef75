"""Repeated rows of one labelled document count once when the views are fitted."""

from keepwell.llm import quality


def test_repeated_document(spark, monkeypatch):
    rows = [(i, f"plain words of document number {i} in a row", "en", "a", None) for i in range(60)]
    rows += [(7, "oddword " + "! " * 10, "en", "b", None)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i != 7 and i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sizes, fit_views = [], quality._fit_views
    monkeypatch.setattr(quality, "_fit_views", lambda model, sets: (sizes.append(len(sets["text"])), fit_views(model, sets)))
    model = quality.fit(docs, labels)
    assert sizes and max(sizes) <= 60
    assert "oddword" not in model.marks_bad
    assert quality.score_documents(docs, labels).count() == len(rows)


def test_buckets_of_long_sources():
    """Sources that differ only behind many equal characters have buckets of their own."""
    found = {quality._bucket("https://example.com/" + "a" * 100 + f"/{i}", quality.SOURCE_BUCKETS) for i in range(500)}
    assert len(found) > 50 and min(found) > 0 and max(found) < quality.SOURCE_BUCKETS
    assert quality._bucket(None, quality.SOURCE_BUCKETS) == 0
