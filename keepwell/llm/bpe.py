"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark tasks.

Spark deals the documents out.  A task cuts its texts into words and hands the
distinct words that its worker doesn't remember to DuckDB, where a word is a
list of token rows linked by position.  A recursive query joins each row and its
successor with the merge table and contracts the leftmost pair of least rank in
each word, round by round, until no pair is left.  Decoding joins ids with the
vocabulary and aggregates the bytes in order of position.

Defined cases: a null text counts as empty and has no tokens; an empty table
gives an empty table; repeated rows are encoded row by row; other columns pass
through, and a new column replaces one of its name.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keepwell.llm.common import ragged, text_batches, text_slices, tidy, without, worker_state

#: Words whose tokens a Python worker remembers, some 45 bytes each; beyond that it starts anew.
CACHE_WORDS = 2_000_000
#: Words that one recursive query contracts.
WORDS_A_QUERY = 10_000
#: Text bytes that are encoded at a time.
TEXT_BYTES = 2 << 20
#: Token rows that one decoding query takes.
TOKENS_A_QUERY = 1 << 19

#: k: word << 32 | byte position, nk and ntok: key and token of the successor, r: rank of the
#: pair of both, best: least rank in the word.  A round contracts the word's leftmost pair of
#: rank `best`.  Where the merge table proves that the tokens so made can't form a pair of lower
#: rank (`sure`), the word's further pairs of this rank would be contracted next, so they go
#: in the same round: of pairs that overlap in a run, every other one.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT k, tok, nk, ntok, rank AS r, min(rank) OVER (PARTITION BY k >> 32) AS best
  FROM linked_words LEFT JOIN merges ON a = tok AND b = ntok
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT * FROM state WHERE best IS NOT NULL),
   found AS (
     SELECT k, nk, best, sure.rank IS NOT NULL AS sure,
            lag(nk) OVER (ORDER BY k) IS DISTINCT FROM k AS opens
     FROM live LEFT JOIN sure ON sure.rank = best WHERE r = best),
   runs AS (SELECT *, sum(opens::INT) OVER (ORDER BY k) AS run FROM found),
   pick AS MATERIALIZED (
     SELECT k, nk, best FROM (
       SELECT k, nk, best, sure, row_number() OVER (PARTITION BY k >> 32 ORDER BY k) AS nth,
              row_number() OVER (PARTITION BY run ORDER BY k) AS in_run FROM runs)
     WHERE nth = 1 OR (sure AND in_run % 2 = 1)),
   made AS (SELECT pick.k, pick.best, live.nk, live.ntok FROM live JOIN pick ON live.k = pick.nk),
   kept AS (
     SELECT live.k, coalesce(made.best, live.tok) AS tok,
            CASE WHEN made.k IS NULL THEN live.nk ELSE made.nk END AS nk,
            CASE WHEN made.k IS NULL THEN live.ntok ELSE made.ntok END AS ntok
     FROM live LEFT JOIN made USING (k) ANTI JOIN pick ON live.k = pick.nk),
   linked AS (
     SELECT kept.k, tok, kept.nk, coalesce(pick.best, ntok) AS ntok
     FROM kept LEFT JOIN pick ON pick.k = kept.nk),
   ranked AS MATERIALIZED (
     SELECT linked.*, rank AS r FROM linked LEFT JOIN merges ON a = tok AND b = ntok)
   SELECT ranked.*, least.best
   FROM ranked LEFT JOIN (SELECT k >> 32 AS w, min(r) AS best FROM ranked GROUP BY 1) least
     ON ranked.k >> 32 = least.w))
SELECT (k >> 32)::INT AS w, tok FROM state WHERE best IS NULL ORDER BY k
"""

LINK = """
SELECT k, tok, CASE WHEN lead(k >> 32) OVER o = k >> 32 THEN lead(k) OVER o END AS nk,
       CASE WHEN lead(k >> 32) OVER o = k >> 32 THEN lead(tok) OVER o END AS ntok
FROM byte_rows WINDOW o AS (ORDER BY k)
"""

#: Tokens x y make m.  A neighbour z of the pair could join m at a lower rank than m's own only
#: if y z (or z x) didn't rank lower still, as that pair would have gone first.
SURE = """
SELECT DISTINCT rank FROM merges WHERE rank NOT IN (
  SELECT m.rank FROM merges m JOIN merges n ON n.a = m.rank AND n.rank < m.rank
  LEFT JOIN merges o ON o.a = m.b AND o.b = n.b WHERE o.rank IS NULL OR o.rank >= m.rank
  UNION ALL
  SELECT m.rank FROM merges m JOIN merges n ON n.b = m.rank AND n.rank < m.rank
  LEFT JOIN merges o ON o.a = n.a AND o.b = m.a WHERE o.rank IS NULL OR o.rank >= m.rank)
"""

#: The inner order is the order of aggregation: the connection has one thread.
DECODE = """
SELECT doc, string_agg(chars, '') AS text FROM (
  SELECT doc, pos, chars FROM token_rows JOIN vocabulary USING (tok) ORDER BY pos)
GROUP BY doc
"""


def read_vocabulary(path: str, most_bytes: int = 64 << 20) -> bytes:
    """The rank file's bytes.  They go to every executor, so their number is checked."""
    size = os.path.getsize(path)
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes, more than {most_bytes}")
    with open(path, "rb") as f:
        return f.read()


def white_space(pattern: str) -> str:
    """The pattern with white space as Unicode has it; Python's \\s also takes U+001C to U+001F."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}") \
        .replace(r"\S", r"\P{White_Space}")


def _merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to put a token together from two others."""
    rows = [(ranks[t[:cut]], ranks[t[cut:]], r) for t, r in ranks.items()
            for cut in range(1, len(t)) if t[:cut] in ranks and t[cut:] in ranks]
    return pa.table({n: pa.array([x[i] for x in rows], pa.int32()) for i, n in enumerate(("a", "b", "rank"))})


class Memory:
    """Tokens of texts that were encoded before; `learn` appends those of new ones to `tokens` and `ends`."""

    def limit(self) -> int:
        return CACHE_WORDS

    def learn(self, pieces: list[bytes]) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        """Words are remembered by 128-bit hashes, sorted; `nth` is where their tokens are."""
        self.high = self.low = np.zeros(0, np.uint64)
        self.nth = np.zeros(0, np.int32)
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def known(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the words' tokens are, -1 for those not remembered."""
        if not len(self.high):
            return np.full(len(high), -1, np.int32)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.nth[at], np.int32(-1))

    def places(self, words: list[str]) -> np.ndarray:
        """Where the tokens of these distinct words are, after learning those that aren't remembered."""
        pieces = [w.encode() for w in words]
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in pieces]), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        high, low = hashes[:, 0], hashes[:, 1]
        found = self.known(high, low)
        new = np.flatnonzero(found < 0)
        if len(self.nth) + len(new) > self.limit():
            self.forget()
            found, new = np.full(len(words), -1, np.int32), np.arange(len(words))
        if len(new):
            found[new] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            self.learn([pieces[i] for i in new.tolist()])
            order = new[np.argsort(high[new], kind="stable")]
            at = np.searchsorted(self.high, high[order])
            self.high, self.low = np.insert(self.high, at, high[order]), np.insert(self.low, at, low[order])
            self.nth = np.insert(self.nth, at, found[order])
        return found


class Codec(Memory):
    """One worker's tables of a vocabulary, and the words it remembers."""

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        self.pattern = regex.compile(white_space(pattern))
        self.con = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '400MB'", "temp_directory = ''", "preserve_insertion_order = true",
                        "allocator_flush_threshold = '4MB'", "allocator_bulk_deallocation_flush_threshold = '4MB'"):
            self.run(f"SET {setting}")
        self.load("merges", _merge_rows(self.ranks))
        self.load("vocabulary", pa.table({
            "tok": pa.array(self.ranks.values(), pa.int32()),
            "chars": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self.run(f"CREATE TABLE sure AS {SURE}")
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.forget()

    def run(self, sql: str) -> list[tuple]:
        return self.con.execute(sql).fetchall()

    def load(self, name: str, rows: pa.Table, sql: str = "") -> None:
        self.con.register("arrow_rows", rows)
        self.run(f"CREATE OR REPLACE TABLE {name} AS {sql or 'SELECT * FROM arrow_rows'}")
        self.con.unregister("arrow_rows")

    def learn(self, pieces: list[bytes]) -> None:
        """Append the tokens of these words; a word that is a token is just that."""
        tokens, sizes = [self.tokens], [np.zeros(0, np.int64)]
        for first in range(0, len(pieces), WORDS_A_QUERY):
            part = pieces[first:first + WORDS_A_QUERY]
            whole = np.array([self.ranks.get(p, -1) for p in part], dtype=np.int32)
            rest = np.flatnonzero(whole < 0)
            flat, ends = self.contract([part[i] for i in rest.tolist()]) if len(rest) else (np.zeros(0, np.int32), [0])
            # Runs to take, in the words' order, from the contracted tokens with the whole ones behind them.
            starts, counts = len(flat) + np.arange(len(part), dtype=np.int64), np.ones(len(part), np.int64)
            starts[rest], counts[rest] = ends[:-1], np.diff(ends)
            tokens.append(np.concatenate([flat, whole])[ragged(starts, counts, np.arange(len(part)))])
            sizes.append(counts)
        self.tokens = np.concatenate(tokens).astype(np.int32)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Tokens of all pieces and where each piece's end."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        place = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = (np.repeat(np.arange(len(pieces), dtype=np.int64), sizes) << 32) + place
        self.load("byte_rows", pa.table({"k": keys, "tok": self.of_byte[flat]}))
        self.run(f"CREATE OR REPLACE TABLE linked_words AS {LINK}")
        out = self.con.sql(CONTRACT).to_arrow_table()
        w, tok = out["w"].to_numpy(), out["tok"].to_numpy()
        return tok, np.searchsorted(w, np.arange(len(pieces) + 1)).tolist()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's number of ids."""
        # Cut before a space that a visible character follows: a word always begins there.
        seen: dict[str, int] = {}
        order, counts = array("q"), []
        for text in texts:
            parts = cut_at_spaces(text or "")
            order.extend([seen.setdefault(p, len(seen)) for p in parts])
            counts.append(len(parts))
        own: dict[str, int] = {}
        spelled, per_part = array("q"), np.zeros(len(seen), np.int64)
        for i, p in enumerate(seen):
            found = self.pattern.findall(p)
            spelled.extend([own.setdefault(w, len(own)) for w in found])
            per_part[i] = len(found)
        words = self.places(list(own))[np.array(spelled, dtype=np.int64)] if own else np.zeros(0, np.int64)
        tokens, starts, sizes = self.tokens, self.ends[:-1], np.diff(self.ends)
        # Tokens of each distinct part, then of each text.
        part_tokens = tokens[ragged(starts, sizes, words)]
        word_ends = np.concatenate([[0], np.cumsum(sizes[words])])
        part_ends = word_ends[np.concatenate([[0], np.cumsum(per_part)]).astype(np.int64)]
        sequence = np.array(order, dtype=np.int64)
        ids = part_tokens[ragged(part_ends[:-1], np.diff(part_ends), sequence)]
        token_ends = np.concatenate([[0], np.cumsum(np.diff(part_ends)[sequence])])
        text_ends = token_ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(text_ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        out: list[bytes] = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            base = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, base + TOKENS_A_QUERY, side="right")))
            part = ids[base:int(ends[last - 1])]
            self.load("token_rows", pa.table({
                "doc": np.repeat(np.arange(first, last, dtype=np.int64), sizes[first:last]),
                "pos": np.arange(len(part), dtype=np.int64), "tok": part.astype(np.int32)}))
            if unknown := self.run("SELECT tok FROM token_rows ANTI JOIN vocabulary USING (tok) LIMIT 1"):
                raise ValueError(f"id {unknown[0][0]} is not in the vocabulary")
            for doc, text in self.run(DECODE):
                out[doc] = text.encode("latin-1")
            first = last
        return out


_GLUED = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?= \S)")


def cut_at_spaces(text: str) -> list[str]:
    """The text cut before each space with a visible character behind it."""
    if _GLUED.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


def codec(blob: bytes, pattern: str) -> Codec:
    """The worker's codec of this vocabulary."""
    state, key = worker_state("bpe"), (hashlib.sha256(blob).digest(), pattern)
    if key not in state:
        state[key] = Codec(blob, pattern)
    return state[key]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`df` with the array column `ids`: the tokens of each whole text, never null."""
    df = without(df, ids)
    spark = df.sparkSession
    text_batches(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text, TEXT_BYTES):
                flat, sizes = own.encode(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))],
                    [*part.schema.names, ids])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids",
           decoded: str = "decoded") -> DataFrame:
    """`df` with the binary column `decoded`; null ids count as none, an unknown id raises."""
    df = without(df, decoded)
    spark = df.sparkSession
    text_batches(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            lists = batch.column(ids)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.decode(flat, sizes), pa.binary())], [*batch.schema.names, decoded])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema, T.StructField(decoded, T.BinaryType())]))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of tokens, and digests of the ids and of the bytes they decode to.

    Ids are hashed as little-endian unsigned 32-bit integers.  Only the digests leave the task.
    """
    df = df.select(key, text)
    spark = df.sparkSession
    text_batches(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text, TEXT_BYTES):
                flat, sizes = own.encode(texts)
                ends = np.cumsum(sizes).tolist()
                raw = flat.astype("<u4").tobytes()
                starts = [0, *ends]
                yield pa.RecordBatch.from_arrays([
                    batch.column(key).slice(first, len(texts)), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(starts, ends)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(flat, sizes)])],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(tidy(run), T.StructType([
        df.schema[key], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
