"""Token ids as flat binary files with 64-bit document offsets, memory-mapped for reading.

Documents are dealt out by ranges of their id and sorted, so that file after file the
tokens stand in ascending order of ids.  A task writes three files:

    part-000000.bin   ids, little-endian unsigned 16-bit (32-bit for larger vocabularies)
    part-000000.off   unsigned 64-bit offsets within the part, one more than documents
    part-000000.doc   signed 64-bit document ids; the least value stands for null

`manifest.json` lists the parts with their numbers of documents and tokens and with
their bases, the prefix sums over the parts before.  A document's global offset is its
part's base plus its offset there.  Tasks write under a name of their own attempt and
rename, so a repeated attempt replaces a whole file by an equal one.

Defined cases: a null text is empty and has the end id only; rows without an id come
first; rows of one id come in order of their texts; an empty table gives a manifest
without parts.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.bpe import Memory, cut_at_spaces
from keepwell.llm.common import quoted, ragged, text_batches, text_slices, worker_state
from keepwell.sources.scratch import scratch_path

#: Text bytes of a part, about.
PART_BYTES = 32 << 20
#: Pieces between spaces whose ids a Python worker remembers; beyond that it starts anew.
CACHE_PIECES = 2_000_000
#: Pieces that are encoded at a time.
PIECES_A_BATCH = 50_000
#: Text bytes that are encoded at a time, and ids that are read at a time.
TEXT_BYTES, READ_IDS = 8 << 20, 4 << 20
NO_ID = -(1 << 63)


class Encoder(Memory):
    """A worker's tokenizer.  Byte-level pre-tokenizing always cuts before a space with a visible
    character behind it, so texts are encoded by their distinct pieces between such cuts."""

    def __init__(self, blob: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = json.loads(blob)
        before = kind.get("pre_tokenizer") or {}
        self.by_pieces = (kind.get("normalizer") is None and before.get("type") == "ByteLevel"
                          and before.get("use_regex", True) and not before.get("add_prefix_space"))
        self.forget()

    def limit(self) -> int:
        return CACHE_PIECES

    def learn(self, pieces: list[bytes]) -> None:
        ids, sizes = array("i"), array("q")
        for first in range(0, len(pieces), PIECES_A_BATCH):
            part = [p.decode() for p in pieces[first:first + PIECES_A_BATCH]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                sizes.append(len(own))
        self.tokens = np.concatenate([self.tokens, np.array(ids, dtype=np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(sizes, dtype=np.int64))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's number of ids."""
        cut = cut_at_spaces if self.by_pieces else lambda t: [t]
        seen: dict[str, int] = {}
        order, counts = array("q"), []
        for t in texts:
            parts = cut(t or "")
            order.extend([seen.setdefault(p, len(seen)) for p in parts])
            counts.append(len(parts))
        which = self.places(list(seen))[np.array(order, dtype=np.int64)] if seen else np.zeros(0, np.int64)
        sizes = np.diff(self.ends)
        ids = self.tokens[ragged(self.ends[:-1], sizes, which)].astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(sizes[which])]).astype(np.int64)
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])


def encoder(blob: str) -> Encoder:
    state = worker_state("token_files")
    if blob not in state:
        state[blob] = Encoder(blob)
    return state[blob]


@dataclass
class TokenFiles:
    """A folder of token files; `parts` has (documents, tokens, first document, first token) of each."""

    folder: str
    dtype: str
    parts: list[tuple[int, int, int, int]]

    @classmethod
    def open(cls, folder: str) -> "TokenFiles":
        fs, path = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            kind = json.loads(f.read())
        return cls(folder, kind["dtype"], [tuple(p) for p in kind["parts"]])

    def read(self, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document ids, global starts and the last end, token ids) of runs of whole documents of a part."""
        documents, _, _, base = self.parts[part]
        name = f"part-{part:06d}"
        wide = np.dtype(self.dtype).itemsize
        with _mapped(self.folder, f"{name}.off") as off, _mapped(self.folder, f"{name}.doc") as doc, \
                _mapped(self.folder, f"{name}.bin") as tokens:
            offsets = np.frombuffer(off.read_buffer(), "<u8")
            ids = np.frombuffer(doc.read_buffer(), "<i8")
            first = 0
            while first < documents:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + np.uint64(READ_IDS), side="right")) - 1)
                a, b = int(offsets[first]), int(offsets[last])
                tokens.seek(a * wide)
                yield ids[first:last], offsets[first:last + 1] + np.uint64(base), \
                    np.frombuffer(tokens.read_buffer((b - a) * wide), self.dtype)
                first = last


def _mapped(folder: str, name: str) -> pa.NativeFile:
    """The file memory-mapped where the folder is mounted, else opened in its store."""
    fs, path = pafs.FileSystem.from_uri(folder)
    return pa.memory_map(f"{path}/{name}") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{path}/{name}")


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                 key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every text, append `end_id`, and write the files below `folder` (default: shared scratch)."""
    spark = df.sparkSession
    text_batches(spark)
    folder = _uri(folder or scratch_path(spark, "token-files"))
    if os.path.getsize(tokenizer) > 64 << 20:
        raise ValueError(f"{tokenizer} is too large to send to every task")
    with open(tokenizer, encoding="utf-8") as f:
        blob = f.read()
    from tokenizers import Tokenizer
    dtype = "<u2" if max(Tokenizer.from_str(blob).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(blob)
    docs = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(text)).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.repartitionByRange(-(-size // PART_BYTES) or 1, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = encoder(sent.value)
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/part-{task.partitionId():06d}"
        trial = f"{name}.attempt-{task.taskAttemptId()}"
        documents, total = 0, 0
        with fs.open_output_stream(f"{trial}.bin") as tokens, fs.open_output_stream(f"{trial}.off") as off, \
                fs.open_output_stream(f"{trial}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for first, texts in text_slices(batch, "text", TEXT_BYTES):
                    ids, sizes = own.encode(texts)
                    ends = np.cumsum(sizes)
                    tokens.write(np.insert(ids, ends, end_id).astype(dtype).tobytes())
                    off.write((total + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
                    keys = batch.column("id").slice(first, len(texts))
                    doc.write(pa.compute.fill_null(keys, NO_ID).to_numpy().astype("<i8").tobytes())
                    documents += len(texts)
                    total += len(ids) + len(texts)
        for end in ("bin", "off", "doc"):
            fs.move(f"{trial}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()),
                                          "documents": pa.array([documents], pa.int64()), "tokens": pa.array([total], pa.int64())})

    # One row a part; their bases are prefix sums.
    counts = sorted((r.part, r.documents, r.tokens) for r in dealt.mapInArrow(write, "part int, documents long, tokens long").collect())
    if [p for p, _, _ in counts] != list(range(len(counts))):
        raise RuntimeError("parts are missing")
    first_docs = accumulate((d for _, d, _ in counts), initial=0)
    first_tokens = accumulate((t for _, _, t in counts), initial=0)
    files = TokenFiles(folder, dtype, [(d, t, a, b) for (_, d, t), a, b in zip(counts, first_docs, first_tokens)])
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "parts": files.parts}).encode())
    return files


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone, a task for each part."""
    files = TokenFiles.open(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                for ids, starts, tokens in files.read(part):
                    at = (starts - starts[0]).astype(np.int64)
                    raw = tokens.astype("<u4").tobytes()
                    cuts = (4 * at).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, mask=ids == NO_ID, type=pa.int64()),
                        "start": pa.array(starts[:-1].astype(np.int64)), "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())})

    n = len(files.parts)
    return spark.range(0, n, 1, max(1, n)).select(F.col("id").cast("int").alias("part")) \
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
