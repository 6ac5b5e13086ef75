"""Each stage against brute force on what the stage before it kept; then the whole run."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp  # noqa: E402
from test_lines import plain as plain_lines  # noqa: E402
from test_shingles import plain_components  # noqa: E402
from test_templates import plain_hits  # noqa: E402

from keepwell.llm import quality  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality(spark, sf_dir, stages):
    scores = quality.score_documents(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r.doc_id for r in scores.where("kept").collect()) == sorted(i for i, _ in pairs(stages[1]))


def test_lines(stages):
    assert sorted(pairs(stages[2])) == sorted((i, t) for i, t, _, _ in plain_lines(pairs(stages[1])))


def test_near_duplicates(stages):
    docs = pairs(stages[2])
    least = plain_components(docs)
    assert sorted(pairs(stages[3])) == sorted((i, t) for i, t in docs if least[i] == i)


def test_benchmark(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(pairs(stages[4])) == sorted((i, t) for i, t in pairs(stages[3]) if not plain_hits(t, items))


def test_tokens_and_run(spark, sf_dir, stages):
    import hashlib
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(stages[4])}
    assert {r.doc_id: r.decoded_sha256 for r in stages[5].collect()} == want
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_rows(spark, sf_dir):
    """Nulls in any column, repeated rows and further columns pass every stage."""
    line = "a line that is long enough to be shared"
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, line, "en", "a", 39), (3, line, "en", "a", 39),
            (None, line, "en", "a", 39), (4, line, None, "a", 39), (5, line + "\nown words", "en", None, 48), (6, "x " * 50_000, "en", "a", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumns({c: F.lit(c) for c in ("row", "id", "key", "fp", "nth", "n_tokens", "items", "score", "digests", "mark", "a.b")})
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == docs.columns, name
            now = spark.createDataFrame(out.collect(), docs.schema)
        last = cp.STAGES[-1][1](spark, now, sf_dir)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == now.count()
    near = cp.one_of_each(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "3", "5", "6", "None", "None"]
    two = cp.one_of_each(spark, spark.createDataFrame([(1, "a b c d e f g"), (1, "t u v w x y z")], "doc_id long, text string"), sf_dir)
    assert two.count() == 2
