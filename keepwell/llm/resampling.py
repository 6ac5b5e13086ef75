"""Documents drawn to look like a target text: hashed n-gram importance weights and a Gumbel draw.

Texts are read by an Aho-Corasick automaton whose entries are words between two delimiters.
A word's payload is its CRC-32 and its length; neighbouring words share a delimiter, so the
automaton emits the payloads of all words in order.  The CRC of a run of words follows from its
words' payloads alone (a CRC is linear: the CRC of a longer string is the first part's, moved over as
many zero bytes as follow, combined with the rest's), so no n-gram is ever built as a string.

A task's dictionary learns: words that it lacks show as gaps between matches, get their CRC by
reading them, and join it, until it holds `DICTIONARY_CHARS`; gaps are read in this way
ever after, so its size changes no result.  It is built anew when an eighth has been added.

Texts are read once: what stays of a document is its buckets with their counts, written to the
shared scratch folder.  From these come the corpus' counts (one number a bucket, so bounded by
`buckets`), the gains, and the weights.  Ranks are counted in value ranges, not in one task.

Defined cases: a null or empty text has no words and weight 0; rows of one id are documents of
their own and tie, the one with more features first; rows without an id count in the corpus and
have a weight, but neither score nor rank and no share in the number to draw; very long texts are
read piece by piece, words that no entry may hold as gaps; the new columns replace columns of their
names; an empty table gives an empty table, an empty target a table with weights of an empty target.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.ordered import running, with_tied_range
from keepwell.llm.common import quoted, saved, text_batches, worker_state

#: Words of a feature at most, and buckets that features are hashed to.
WORDS, BUCKETS = 1, 10_000
#: Words of a document that may be drawn, at least; documents of a hundred that are drawn; salt of the draw.
LEAST_WORDS, PERCENT, SALT = 20, 10, "2024"
#: Characters of a dictionary's entries, at most, and of one entry.
DICTIONARY_CHARS, ENTRY_CHARS = 1 << 19, 64
#: Bytes of text that the automaton reads at once.
PIECE = 1 << 20

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` stays, A-Z in lower case; all else parts words.
_TABLE = bytes((b | 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 32) for b in range(256))


class Zeros:
    """Moves CRC-32 values over zero bytes: one 32 x 32 bit matrix for every power of two of bytes."""

    def __init__(self) -> None:
        # Columns: what one zero bit makes of each bit of a CRC; squared thrice it is a byte.
        one = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)
        self.powers = [self._times(self._times(one, one), self._times(one, one))]
        self.powers[0] = self._times(self.powers[0], self.powers[0])

    @staticmethod
    def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint32)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Each CRC with `by` zero bytes after it."""
        out, bit = crc.copy(), 0
        while len(by) and int(by.max()) >> bit:
            if bit == len(self.powers):
                self.powers.append(self._times(self.powers[-1], self.powers[-1]))
            some = np.flatnonzero(by >> bit & 1)
            out[some] = self._times(self.powers[bit], out[some])
            bit += 1
        return out


class Reader:
    """Payloads of a text's words, from an automaton that grows with what it reads."""

    def __init__(self, most_chars: int = DICTIONARY_CHARS) -> None:
        self.most_chars, self.chars = most_chars, 0
        self.automaton, self.entries, self.new = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, {}
        self.crcs, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(CRCs, lengths in bytes) of the words of a delimited piece, a character a byte."""
        matches = itertools.chain.from_iterable(self.automaton.iter(text)) if self.entries else ()
        ends, found = np.fromiter(matches, np.int64).reshape(-1, 2).T
        # A match covers its word and both delimiters; words that no match covers have no entry.
        letters = np.frombuffer(text.encode("latin-1"), np.uint8) != 32
        edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        crcs, lacking = np.zeros(len(starts), np.uint32), np.ones(len(starts), bool)
        at = np.searchsorted(starts, ends - self.lengths[found])
        crcs[at], lacking[at] = self.crcs[found], False
        some = np.flatnonzero(lacking)
        crcs[some] = self._direct([text[i:i + n] for i, n in zip(starts[some].tolist(), lengths[some].tolist())])
        self._learn()
        return crcs, lengths

    def _direct(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint32)
        for i, w in enumerate(words):
            crc = self.new.get(w)
            if crc is None:
                crc = zlib.crc32(w.encode("latin-1"))
                if len(w) + 2 <= ENTRY_CHARS and self.chars + len(w) + 2 <= self.most_chars:
                    self.new[w] = crc
                    self.chars += len(w) + 2
            out[i] = crc
        return out

    def _learn(self) -> None:
        if len(self.new) <= max(64, self.entries // 8):
            return
        for n, w in enumerate(self.new, self.entries):
            self.automaton.add_word(f" {w} ", n)
        self.automaton.make_automaton()
        self.crcs = np.r_[self.crcs, np.array(list(self.new.values()), np.uint32)]
        self.lengths = np.r_[self.lengths, np.array([len(w) for w in self.new], np.int64)]
        self.entries += len(self.new)
        self.new = {}


def delimited(raw: bytes, most: int = PIECE) -> Iterator[str]:
    """A text in pieces that start and end with a delimiter; no word is cut."""
    first = 0
    while first < len(raw):
        part, last = bytearray(raw[first:first + most].translate(_TABLE)), first + most
        cut = part.rfind(b" ") if last < len(raw) else len(part)
        while cut < 0:
            more = raw[last:last + most].translate(_TABLE)
            cut = len(part) + more.find(b" ") if b" " in more else -1 if last + most < len(raw) else len(part) + len(more)
            part += more
            last += most
        yield " " + part[:cut].decode("latin-1") + " "
        first += cut + 1


def feature_crcs(reader: Reader, zeros: Zeros, raw: bytes, words: int) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to `words` consecutive words, joined by one blank: an array for each piece and run length."""
    tail = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for piece in delimited(raw):
        crcs, lengths = reader.read(piece)
        own = len(crcs)
        yield crcs
        # A run may start in the pieces before.
        crcs, lengths = np.r_[tail[0], crcs], np.r_[tail[1], lengths]
        total, n = crcs, len(crcs)
        for k in range(2, words + 1):
            if n < k:
                break
            # A blank after the run so far, then the next word.
            first = zeros.moved(total[:n - k + 1], np.ones(n - k + 1, np.int64)) ^ np.uint32(zlib.crc32(b" "))
            total = zeros.moved(first, lengths[k - 1:]) ^ crcs[k - 1:]
            yield total[max(0, n - own - k + 1):]
        if words > 1:
            tail = (crcs[-(words - 1):], lengths[-(words - 1):])


def features(rows: DataFrame, words: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, held, counts) of rows (id, raw): the buckets of a document's features and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("resampling")
        zeros, reader = state.setdefault("zeros", Zeros()), Reader()
        for batch in batches:
            n_words, n_features, held, counts = [], [], [], []
            for raw in batch.column("raw"):
                own, n, total = [], 0, np.zeros(0, np.int64)
                many = np.zeros(0, np.int64)

                def folded() -> tuple[np.ndarray, np.ndarray]:
                    some, inverse = np.unique(np.concatenate([total, *own]), return_inverse=True)
                    weights = np.concatenate([many, np.ones(sum(map(len, own)), np.int64)])
                    return some, np.bincount(inverse, weights, len(some)).astype(np.int64)

                body = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                for crcs in feature_crcs(reader, zeros, body, words):
                    own.append(crcs.astype(np.int64) % buckets)
                    if sum(map(len, own)) > PIECE:
                        total, many = folded()
                        own = []
                    n += len(crcs)
                total, many = folded()
                n_features.append(n)
                n_words.append(_word_count(n, words))
                held.append(total.astype("<u4").tobytes())
                counts.append(many.astype("<u8" if n >> 32 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                 pa.array(held, pa.binary()), pa.array(counts, pa.binary())], ["id", "n_words", "n_features", "held", "counts"])

    text_batches(rows.sparkSession)
    return rows.mapInArrow(run, "id long, n_words long, n_features long, held binary, counts binary")


def _word_count(n_features: int, words: int) -> int:
    """Words of a text that has so many runs of 1 to `words` words."""
    if n_features < words * (words + 1) // 2:
        return next(n for n in itertools.count() if n * (n + 1) // 2 >= n_features)
    return (n_features + words * (words - 1) // 2) // words


def _counts(held: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    which = np.frombuffer(held, "<u4").astype(np.int64)
    return which, np.frombuffer(counts, "<u8" if len(counts) == 2 * len(held) and len(held) else "<u4").astype(np.int64)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all documents: summed in tasks, then in Spark; `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held, counts in zip(batch.column("held").to_pylist(), batch.column("counts").to_pylist()):
                which, many = _counts(held, counts)
                total[which] += many
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in found.select("held", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(of_corpus: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    s, t, n = int(of_corpus.sum()), int(of_target.sum()), len(of_corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n))))
                     for a, b in zip(of_corpus.tolist(), of_target.tolist())], dtype=np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held, counts, n in zip(*[batch.column(c).to_pylist() for c in ("held", "counts", "n_features")]):
                which, many = _counts(held, counts)
                out.append(int(gain[which] @ many) // n if n else 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n_words", "n_features")], pa.array(out, pa.int64())],
                                             ["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", *, words: int = WORDS,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, salt: str = SALT) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; only drawn ones have a rank."""
    def raw(c: str) -> "F.Column":
        return F.col(quoted(c)).cast("binary").alias("raw")

    found, _ = saved(features(docs.select(F.col(quoted(key)).cast("long").alias("id"), raw(text)), words, buckets), "resampling-buckets")
    aim = features(target.select(F.lit(None).cast("long").alias("id"), raw(target_text)), words, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored, _ = saved(weighted(found, gain).withColumn("score", F.col("weight") + noise), "resampling-scores")

    open_to = scored.where((F.col("n_words") >= least_words) & F.col("id").isNotNull())
    drawn = open_to.count() * percent // 100
    # Highest score first, then the smaller id, then more features; equal rows may stand in either order.
    order = open_to.withColumns({"_down": -F.col("score"), "_fewer": -F.col("n_features")})
    ranked = running(with_tied_range(order, "_down", "id"), [], ["_down", "id", "_fewer"], sums={"rank": F.lit(1).cast("long")})
    others = scored.where((F.col("n_words") < least_words) | F.col("id").isNull()).withColumn("rank", F.lit(None).cast("long"))
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    both = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(columns).unionByName(others.select(columns))
    return both.withColumnRenamed("id", key)
