"""Token files against the tokenizers library, and their way back."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepwell.llm import token_files as tf
from keepwell.llm.queries import op5_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, end=0):
    """[(id, start, n, crc)] by one encode of each whole text."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op5_token_files(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs))


@pytest.mark.parametrize("part,cache,read", [(32 << 20, 600_000, 4 << 20), (200, 10, 3)])
def test_cases(spark, tmp_path, monkeypatch, part, cache, read):
    monkeypatch.setattr(tf, "PART_BYTES", part)
    monkeypatch.setattr(tf, "CACHE_PIECES", cache)
    monkeypatch.setattr(tf, "READ_IDS", read)
    rows = [(5, "five  spaces   here\n\n x"), (3, None), (3, ""), (9, "a" * 50_000), (7, "same"), (7, "same"), (7, "Other of the id"), (None, "no id"),
            (-4, "negative é 日本 \x1c\x85\xa0 z"), (2, "<|endoftext|> x<|endoftext|>"), (1 << 40, "it's 's  's"), (12, " lead and trail ")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, part string")
    files = tf.write_tokens(df, PATH, 0, str(tmp_path / "files"))
    assert len(files.parts) > (3 if part == 200 else 0)
    got = tf.read_documents(spark, files.folder).orderBy("start").collect()
    want = plain(rows)
    # The two texts of id 3 are both empty, so their order can't be told.
    assert [tuple(r) for r in got] == want
    again = tf.TokenFiles.open(files.folder)
    assert again.parts == files.parts and sum(p[1] for p in again.parts) == sum(r[2] for r in want)
    # Another writing of the same rows gives the same files.
    assert not [p for p in (tmp_path / "files").iterdir() if "attempt" in p.name]


def test_empty(spark, tmp_path):
    files = tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, 0, str(tmp_path / "none"))
    assert sum(p[1] for p in files.parts) == 0 and tf.read_documents(spark, files.folder).count() == 0
