"""Line deduplication: lines that many documents share stay in one of them only.

Every line's key (the line without blanks at its ends, A-Z in lower case) sets
bits in two Bloom filters over the whole table: one for keys seen once, one for
keys seen again.  Tasks send only their set bits, as compressed gaps, to the
filters' shards, where "again" gathers what a task or two tasks have seen
twice.  A second pass keeps the keys that the second filter holds: the only
ones that can repeat.  Just these are shuffled, confirmed by digest, and
resolved to the document that keeps its lines.

The filters have a fixed number of bits for each line of the table.  Their
shards are read in slices of bounded size, one pass over the texts each, so that
memory doesn't grow with the table.

Defined cases: a null or empty text is one empty line and stays as it is; rows
that share a document id are one document; rows without an id keep all their
lines and count for nothing; an empty table gives an empty table; a document
keeps one empty text when all its lines go; the new columns replace columns of
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.common import BLANKS, quoted, rows_back, saved, text_batches, tidy, whole_rows, worker_state

#: Bits of each filter for a line of the table, and bits that a key sets.
BITS_A_LINE, PROBES = 8, 2
#: log2 of a shard's bits.
SHARD_BITS = 23
#: Bytes of the second filter that a task holds at a time.
FILTER_BYTES = 128 << 20
#: Bit positions that a task holds before it sends them off.
POSITIONS_HELD = 4 << 20


def line_keys(text: str | None, least_chars: int) -> set[bytes]:
    """Digests of the text's distinct keys with at least `least_chars` code points."""
    keys = {k for line in (text or "").split("\n") if len(k := line.strip(BLANKS)) >= least_chars}
    return {digest(k) for k in keys}


def digest(key: str) -> bytes:
    """128 bits of SHA-256 of a stripped line, A-Z in lower case (bytes.lower() touches only those)."""
    return hashlib.sha256(key.encode().lower()).digest()[:16]


def positions(digests: list[bytes], log2_bits: int) -> np.ndarray:
    """(keys, PROBES) bit positions; a key's bits lie in one shard."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, PROBES)
    within = words & np.uint64((1 << min(SHARD_BITS, log2_bits)) - 1)
    if log2_bits <= SHARD_BITS:
        return within.astype(np.int64)
    shard = words[:, :1] >> np.uint64(64 - (log2_bits - SHARD_BITS))
    return ((shard << np.uint64(SHARD_BITS)) | within).astype(np.int64)


def _gaps(sorted_positions: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(
        np.diff(sorted_positions, prepend=0).astype("<u4").tobytes())


def _from_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u4"), dtype=np.int64)


def _log2_bits(docs: DataFrame) -> int:
    """Bits of a filter for all lines of the table, as a power of two."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 1
    return max(16, int(lines * BITS_A_LINE - 1).bit_length())


def repeat_filter(docs: DataFrame, least_chars: int, log2_bits: int) -> DataFrame:
    """(shard, again): the set bits, as compressed gaps, of the filter of keys seen at least twice."""
    shards = 1 << max(0, log2_bits - SHARD_BITS)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        once, counts = np.unique(np.concatenate(held), return_counts=True)
        again = once[counts > 1]
        shard = once >> SHARD_BITS
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(once, [s << SHARD_BITS, (s + 1) << SHARD_BITS])
            c, d = np.searchsorted(again, [s << SHARD_BITS, (s + 1) << SHARD_BITS])
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s], pa.int32()),
                "once": pa.array([_gaps(once[a:b] - (s << SHARD_BITS))], pa.binary()),
                "again": pa.array([_gaps(again[c:d] - (s << SHARD_BITS))], pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("lines")
        held, n = [], 0
        for batch in batches:
            digests = [d for text in batch.column("text").to_pylist() for d in line_keys(text, least_chars)]
            if digests:
                held.append(positions(digests, log2_bits).ravel())
                n += held[-1].size
            if n > POSITIONS_HELD:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of shards, so one shard's two filters are held at a time."""
        now, bits = None, 1 << min(SHARD_BITS, log2_bits)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([now], pa.int32()),
                "again": pa.array([_gaps(np.flatnonzero(again))], pa.binary())})

        for batch in batches:
            for s, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if s != now:
                    if now is not None:
                        yield done()
                    now, once, again = s, np.zeros(bits, bool), np.zeros(bits, bool)
                seen = _from_gaps(a)
                again[seen[once[seen]]] = True
                again[_from_gaps(b)] = True
                once[seen] = True
        if now is not None:
            yield done()

    parts = docs.select("text").mapInArrow(build, "shard int, once binary, again binary")
    return parts.repartition(min(shards, 1000), "shard").sortWithinPartitions("shard") \
        .mapInArrow(merge, "shard int, again binary")


def suspects(docs: DataFrame, least_chars: int, filters: DataFrame, log2_bits: int) -> DataFrame:
    """(id, digest) of each document's distinct keys that the filter of repeats holds."""
    a_slice = max(1, FILTER_BYTES * 8 >> SHARD_BITS)
    shards = 1 << max(0, log2_bits - SHARD_BITS)
    out = None
    for first in range(0, shards, a_slice):
        last = min(first + a_slice, shards)
        held = {r.shard: r.again for r in filters.where(F.col("shard").between(first, last - 1)).toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def look(batches: Iterator[pa.RecordBatch], sent=sent, base=first << SHARD_BITS,
                 bits=(last - first) << SHARD_BITS) -> Iterator[pa.RecordBatch]:
            worker_state("lines")
            packed = np.zeros((bits >> SHARD_BITS, 1 << SHARD_BITS >> 3), np.uint8)
            for s, blob in sent.value.items():
                shard = np.zeros(1 << SHARD_BITS, bool)
                shard[_from_gaps(blob)] = True
                packed[s - (base >> SHARD_BITS)] = np.packbits(shard, bitorder="little")
            packed = packed.ravel()
            for batch in batches:
                ids, digests = [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    found = line_keys(text, least_chars)
                    ids.extend([i] * len(found))
                    digests.extend(found)
                if not digests:
                    continue
                at = positions(digests, log2_bits) - base
                inside = (at[:, 0] >= 0) & (at[:, 0] < bits)
                at[~inside] = 0
                hit = inside & ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                keep = np.flatnonzero(hit).tolist()
                if keep:
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array([ids[i] for i in keep], pa.int64()),
                        "digest": pa.array([digests[i] for i in keep], pa.binary())})

        part = docs.where("id IS NOT NULL").mapInArrow(look, "id long, digest binary")
        out = part if out is None else out.unionByName(part)
    return out


def dropped_lines(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(id, digests): per document, the keys whose lines it loses.  `docs` has id and text."""
    log2_bits = _log2_bits(docs)
    filters, _ = saved(repeat_filter(docs, least_chars, log2_bits), "line-filter")
    found, _ = saved(suspects(docs, least_chars, filters, log2_bits), "line-suspects")
    # Written, so that the join deals both sides out and can split a line that very many documents share.
    shared, _ = saved(found.groupBy("digest").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper"))
                      .where(F.col("docs") >= least_docs), "line-shared")
    return found.join(shared, "digest").where("id <> keeper") \
        .groupBy("id").agg(F.collect_set("digest").alias("digests"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text",
                least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """`df` with `text` less its dropped lines, and the columns n_lines (before) and n_dropped.

    A key of at least `least_chars` code points in at least `least_docs` documents
    keeps its lines only in the document of largest id that holds it.
    """
    text_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    gone = dropped_lines(docs, least_chars, least_docs)
    packed = whole_rows(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, drops = [], [], []
            for t, digests in zip(batch.column("text").to_pylist(), batch.column("digests").to_pylist()):
                own = (t or "").split("\n")
                lines.append(len(own))
                if digests:
                    lost = set(digests)
                    own = [x for x in own if len(k := x.strip(BLANKS)) < least_chars or digest(k) not in lost]
                    t = "\n".join(own)
                drops.append(lines[-1] - len(own))
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64())],
                ["row", "text", "lines", "drops"])

    # The text travels once: the struct's copy of it is blanked.
    slim = packed.withColumn("row", F.col("row").withField(quoted(text), F.lit(None).cast("string")))
    shape = T.StructType([slim.schema["row"], T.StructField("text", T.StringType()),
                          T.StructField("lines", T.LongType()), T.StructField("drops", T.LongType())])
    done = slim.join(gone, "id", "left").select("row", "text", "digests").mapInArrow(drop, shape)
    return rows_back(done, df, **{text: F.col("text"), "n_lines": F.col("lines"), "n_dropped": F.col("drops")})
