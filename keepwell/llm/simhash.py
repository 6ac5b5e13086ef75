"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the majority, bit by bit, of the hashes of its
word shingles.  Equal fingerprints are one class; only classes are compared.
Fingerprints link at `MOST_BITS` = 4 or fewer differing bits.

A fingerprint is three segments of 22, 21 and 21 bits, padded to the 23 bits of
the perfect binary Golay code.  Of 4 errors in three segments (pigeonhole), either
one segment has none, or two segments have exactly one each.  The first case is
found by the segment itself as key.  For the second, segments decode to codeword
indices: a segment's nearest codeword lies within 3 bits of it, so within 4 bits of
any segment one error away, and at most six codewords lie within 4 bits of a
segment.  A row with (nearest of one segment, each near of the other) and one with
(each near, nearest) therefore always share one of their keys, up to eleven for
each pair of segments.  Rows of one key are verified by their differing bits.

A key's rows are compared where they meet; a key with more than `BLOCK` rows is cut
into blocks, and pairs of blocks are dealt out.  Either way only a spanning forest of
the links leaves the task, never all pairs.

Defined cases: a null, empty or blank text has fingerprint zero and links like any
other; rows of one id or with equal texts are members like all others; a class
whose rows all lack an id has a null component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import saved, text_batches, tidy, worker_state
from keepwell.llm.components import components

#: Differing bits at which fingerprints still link.  The keys are made for just this number.
MOST_BITS = 4
SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23, 12, 7] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Members of a key that one task compares at once.
BLOCK = 2048


def shingle_hashes(text: str | None, words_a_shingle: int) -> list[int]:
    """Of the text's shingles in order, repeats included; bytes.lower() and split() are ASCII-only."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n < words_a_shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ends = (starts + sizes)[words_a_shingle - 1:].tolist()
    of = xxhash.xxh64_intdigest
    return [of(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)]


def fingerprint(text: str | None, words_a_shingle: int) -> int:
    """The text's SimHash over its shingles, repeats included."""
    hashes = shingle_hashes(text, words_a_shingle)
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[first:first + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words_a_shingle: int = 4) -> DataFrame:
    """(id, fp) of each row; fp holds the unsigned bits in a long."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            found = [fingerprint(t, words_a_shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")) \
        .mapInArrow(tidy(run), "id long, fp long")


class Golay:
    """Decoding tables of the 23-bit code, by syndrome."""

    def __init__(self):
        self.leader = np.zeros(1 << 11, np.int64)
        #: The words of weight 4 in cosets whose leader has weight 3, five each; else the leader again.
        self.fours = np.zeros((1 << 11, 5), np.int64)
        one = [1 << i for i in range(23)]
        self.of_bit = np.array([self._remainder(b) for b in one], np.int64)
        for weight in range(1, 4):
            for bits in combinations(range(23), weight):
                self.leader[np.bitwise_xor.reduce(self.of_bit[list(bits)])] = sum(one[i] for i in bits)
        fours = np.array(list(combinations(range(23), 4)))
        syndromes = np.bitwise_xor.reduce(self.of_bit[fours], axis=1)
        order = np.argsort(syndromes, kind="stable")
        words = (1 << fours).sum(axis=1)[order]
        self.fours[:] = self.leader[:, None]
        for s, group in zip(np.unique(syndromes), np.split(words, np.flatnonzero(np.diff(syndromes[order])) + 1)):
            self.fours[s] = group

    @staticmethod
    def _remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices within 4 bits of each word: the nearest, then the others or it again."""
        syndromes = np.zeros(len(words), np.int64)
        for i in range(23):
            syndromes ^= np.where(words >> i & 1, self.of_bit[i], 0)
        flips = np.concatenate([self.leader[syndromes][:, None], self.fours[syndromes]], axis=1)
        return (words[:, None] ^ flips) >> 11


def keys_of(golay: Golay, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fps) of all keys, each once for a fingerprint."""
    at = np.arange(len(fps))
    keys, rows = [], []
    parts = [((fps >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64) for first, n in SEGMENTS]
    for i, part in enumerate(parts):
        keys.append((i << 60) | part)
        rows.append(at)
    near = [golay.near(p) for p in parts]
    for nth, (i, j) in enumerate(combinations(range(3), 2)):
        tag = (3 + nth) << 60
        first = tag | (near[i][:, :1] << 12) | near[j]
        second = tag | (near[i] << 12) | near[j][:, :1]
        both = np.sort(np.concatenate([first, second], axis=1), axis=1)
        new = np.concatenate([np.ones((len(fps), 1), bool), np.diff(both, axis=1) != 0], axis=1)
        keys.append(both[new])
        rows.append(np.nonzero(new)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from members to the least member of their component within the group."""
    members = np.unique(members)
    linked = np.bitwise_count(members[:, None] ^ members[None, :]) <= MOST_BITS
    return _stars(members, linked)


def _stars(members: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(members)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(n))
    return members[moved], members[label[moved]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "key": pa.nulls(len(a), pa.int64()),
        "block": pa.nulls(len(a), pa.int32()), "members": pa.nulls(len(a), pa.binary())})


def links(classes: DataFrame) -> DataFrame:
    """(a, b) that connect the fingerprints `fp` of `classes` as their links do; not all links, but a forest of each key's."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            keys, rows = keys_of(golay, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of keys.  A key's members are held up to a block; a larger key leaves as blocks."""
        held, held_key, sent = np.zeros(0, np.uint64), None, 0

        def block(members: np.ndarray, nth: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "key": pa.array([held_key], pa.int64()),
                "block": pa.array([nth], pa.int32()), "members": pa.array([members.astype("<u8").tobytes()], pa.binary())})

        def close() -> Iterator[pa.RecordBatch]:
            if sent:
                yield block(held, sent)
            elif len(held) > 1:
                a, b = forest(held)
                if len(a):
                    yield _edges(a, b)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            # Keys that lie within the batch and have two members, the common case, all at once.
            inner = np.flatnonzero(sizes[1:-1] == 2) + 1
            x, y = fps[cuts[inner]], fps[cuts[inner] + 1]
            close_by = np.bitwise_count(x ^ y) <= MOST_BITS
            if close_by.any():
                yield _edges(np.maximum(x, y)[close_by], np.minimum(x, y)[close_by])
            # The first and last key may go on in another batch; larger keys go one by one.
            for i in sorted({0, len(sizes) - 1, *(np.flatnonzero(sizes > 2)).tolist()}):
                key, members = keys[cuts[i]], fps[cuts[i]:cuts[i + 1]]
                if key != held_key:
                    yield from close()
                    held, held_key, sent = members, key, 0
                else:
                    held = np.concatenate([held, members])
                while len(held) > BLOCK:
                    yield block(held[:BLOCK], sent)
                    held, sent = held[BLOCK:], sent + 1
        yield from close()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("members").to_pylist(), batch.column("others").to_pylist()):
                a, b = forest(np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    met, _ = saved(
        classes.select("fp").mapInArrow(tidy(emit), "key long, fp long").repartition("key").sortWithinPartitions("key")
        .mapInArrow(tidy(meet), "a long, b long, key long, block int, members binary"), "simhash-links")
    blocks = met.where("members IS NOT NULL").select("key", "block", "members")
    others = blocks.select("key", F.col("block").alias("other"), F.col("members").alias("others"))
    # Each pair of blocks is a task's unit of work; they are dealt out anew, however few keys have them.
    apart = blocks.join(others, "key").where("block <= other") \
        .select("key", "block", "other", "members", "others").repartition("key", "block", "other")
    return met.where("members IS NULL").select("a", "b").unionByName(
        apart.select("members", "others").mapInArrow(tidy(compare), "a long, b long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_a_shingle: int = 4) -> DataFrame:
    """(id, fp, component_id) of each row: component_id is the least id that links reach."""
    marked, _ = saved(fingerprints(df, key, text, words_a_shingle), "simhash-fingerprints")
    classes, _ = saved(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-classes")
    return resolved(marked, classes, links(classes))


def resolved(marked: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, fp, component_id) of the rows `marked` (id, fp), whose `classes` (fp, least_id) the links `found` (a, b) connect."""
    parts = components(found).withColumnRenamed("node", "fp")
    # The component's least fingerprint stands for it; classes without links stand for themselves.
    named = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written, so that the joins deal both sides out and can split a component or class of very many rows.
    least, _ = saved(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "simhash-components")
    ids, _ = saved(named.join(least, "component").select("fp", "component_id"), "simhash-resolved")
    return marked.join(ids, "fp").select("id", "fp", "component_id")


def unsigned_hex(column) -> "F.Column":
    """16 lowercase hexadecimal digits of a long's bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
