"""The classifier by its accuracy on labels it has not seen, and its defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import quality
from keepwell.llm.queries import op7_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED_ROWS", 2500)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = quality.labelled_sample(labels, 2500)
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").join(seen, F.col("doc_id") == seen.id, "left_anti") \
        .select("score", "kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    good, bad = [r for r in scored if r.good], [r for r in scored if not r.good]
    assert len(scored) > 1000
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.08
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= quality.KEEP_FROM) for r in scored)


def test_filter_agrees_with_scores(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = sorted(r.doc_id for r in op7_quality(spark, sf_dir).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want and 0 < len(want) < docs.count()
    assert kept.exceptAll(docs).count() == 0


def test_exchange_raises_no_doubt(spark, monkeypatch):
    """Views that are right on held-out labels pass rows on; a view that can't tell passes none."""
    scores, good = np.linspace(0, 1, 200), (np.linspace(0, 1, 200) > 0.5).astype(float)
    assert set(quality._sure(scores, good)) == {0.0, 1.0}
    assert quality._sure(np.full(200, 0.7), np.arange(200) % 2 == 0) == {}


def test_cases(spark):
    rows = [(1, None, "en", "a", 3), (2, "", None, None, None), (3, "x" * 200_000, "en", "b", 200_000), (3, "x y", "en", "b", 3),
            (None, "no id", "en", "a", 5), (4, "Good words in a row.", "zz", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("score", F.lit("own")).withColumn("content", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, none)
    assert out.columns == ["doc_id", "text_score", "page_score", "score", "kept"]
    assert [r.score for r in out.collect()] == [1.0] * len(rows)
    assert quality.keep_good(docs, none).count() == len(rows)
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 0), (3, 1, 0), (4, 1, None), (None, 0, 0), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    assert {r.id: r.good for r in quality.labelled_sample(labels, 10).collect()} == {1: 0.0, 3: 1.0, 4: 1.0, 99: 0.0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert quality.score_documents(docs, labels).count() == len(rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    slim = docs.select("doc_id", "text")
    assert quality.score_documents(slim, labels).count() == len(rows)
