"""BPE by recursive queries gives what the tiktoken library gives, and decodes to the text."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from keepwell.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "  ", "a  b", "a   b\n\n c", "\t\t x", "it's we'LL '  's", "x\x1cy \x1cz", "a\xa0 b　　c", "\x85 q",
       "a" * 5000, "=-" * 900, "é" * 700, "日本語 テキスト", "👩‍👩‍👧 ok", "१२३ ²³ Ⅷ", "᠎ ​ x", "end ", "end\n", "<|endoftext|>",
       "the the the", "the the the", "\x00\x01", "ﬁ ǅ ʰ", "a\r\nb\r\n  c", "   d"]


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        assert rows[i].token_ids == library.encode_ordinary(text or ""), repr(text)
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        want[r.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "WORDS_A_QUERY", 3)
    monkeypatch.setattr(bpe, "TOKENS_A_QUERY", 4)
    own = bpe.Codec(bpe.read_vocabulary(VOCABULARY), public_tokenizers.PATTERN)
    for texts in (["abcde fghij klmno pqrst", "uvwxyz", ""], ["abcde zzz qqq", None, "aaa bbb ccc ddd"]):
        flat, sizes = own.encode(texts)
        ends = np.cumsum(sizes)
        assert [flat[e - n:e].tolist() for e, n in zip(ends, sizes)] == [library.encode_ordinary(t or "") for t in texts]
        assert own.decode(flat, sizes) == [(t or "").encode() for t in texts]


def test_empty_nulls_and_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, token_id int")
    assert bpe.encode(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    again = bpe.encode(empty.withColumn("Token_IDs", F.lit(1)), VOCABULARY, public_tokenizers.PATTERN)
    assert again.columns == ["doc_id", "text", "token_id", "token_ids"]
    nulls = spark.createDataFrame([(None, None), (None, "x y")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.round_trip(nulls, VOCABULARY, public_tokenizers.PATTERN).collect()) == [0, 2]
