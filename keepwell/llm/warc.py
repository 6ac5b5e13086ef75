"""ARC archives, their conversion to WARC, and reading both.

`write_arc` writes pages to legacy ARC files, `convert` turns ARC files into WARC files,
`read_warc` reads those back.  A file is a run of gzip members, one a record.

The converter takes each ARC file's version and field names from its first record,
splits header lines by them, and reads as many bytes as a line declares.  From these
it makes what WARC asks for: record identifiers derived from file and position (so a
repeated attempt gives the same), ISO timestamps, record types, and SHA-1 digests of
block and payload.  Of records with equal payloads (same digest and length) that with
the least page id is a response, the others are revisits of it.  Only digests, lengths
and positions are shuffled, never payloads; payloads of equal digest are pre-aggregated.

Defined cases: a null html is an empty payload; a null or blank url becomes
`urn:page:<id>`, white space and control characters of a url are percent-encoded; of
several records with the least page id the first in the archive is the response, and
rows without a page id come after all others; a page without records gives files
without any; an archive that ends within a record raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.common import quoted, saved, text_batches
from keepwell.sources.scratch import scratch_path

#: gzip level of archives.
LEVEL = 2
#: Fields of a header line, by ARC version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    """Header fields by name, and the block that the header's length declares."""

    version: int
    fields: dict[str, str]
    block: bytes


def sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def safe_url(url: str | None, page_id: int | None) -> str:
    if url is None or not url.strip():
        return f"urn:page:{'' if page_id is None else page_id}"
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def arc_bytes(version: int, url: str, date: str, kind: str, block: bytes, filename: str, offset: int) -> bytes:
    """One ARC record: header line, block, line feed."""
    middle = [] if version == 1 else ["200", "-", "-", str(offset), filename]
    line = " ".join([url, "0.0.0.0", date, kind, *middle, str(len(block))])
    return line.encode() + b"\n" + block + b"\n"


def arc_head(version: int, date: str, filename: str) -> bytes:
    """The record that opens an ARC file and tells its version and fields."""
    block = f"{version} 0 keepwell\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_bytes(version, f"filedesc://{filename}", date, "text/plain", block, filename, 0)


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def arc_records(stream: io.BufferedIOBase, name: str = "archive") -> Iterator[ArcRecord]:
    """All records; the first one's second line gives the version, its third the fields."""
    version, names = 1, FIELDS[1]
    while line := stream.readline():
        if not line.strip():
            continue
        first = line.startswith(b"filedesc://")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        length = text.rsplit(" ", 1)[-1]
        if not length.isdigit():
            raise ValueError(f"{name}: no length in header line {text[:200]!r}")
        block = stream.read(int(length))
        if len(block) < int(length):
            raise ValueError(f"{name}: the archive ends within a record of {length} bytes")
        if first:
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split()[0]) if head[0].split() and head[0].split()[0].isdigit() else 1
            names = tuple(head[1].split()) if len(head) > 1 and head[1].split() else FIELDS.get(version, FIELDS[1])
            yield ArcRecord(version, {"URL": text.split(" ")[0], "Archive-date": _dated(text)}, block)
            continue
        # A legacy url may hold spaces: the other fields are counted from the right.
        parts = text.rsplit(" ", len(names) - 1)
        yield ArcRecord(version, dict(zip(names, parts)), block)


def _dated(line: str) -> str:
    return next((x for x in line.split(" ") if x.isdigit() and len(x) in (8, 12, 14)), "")


def iso_date(date: str) -> str:
    """YYYYMMDD, YYYYMMDDhhmm or YYYYMMDDhhmmss as a WARC date; the epoch if it is none of these."""
    if not (date.isdigit() and len(date) in (8, 12, 14)):
        return "1970-01-01T00:00:00Z"
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """(head, payload, page id) of an HTTP response; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, None
    head, _, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
    return head + b"\r\n\r\n", payload, int(found[1]) if found else None


def record_id(file: int, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}/{nth}')}>"


def warc_bytes(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + sha1(block)), ("Content-Length", len(block))])
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream: io.BufferedIOBase, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of all records."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: expected a WARC version, found {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{name}: the archive ends within a record of {length} bytes")
        yield headers, block


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _reading(folder: str, name: str) -> io.BufferedReader:
    fs, path = pafs.FileSystem.from_uri(folder)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)), 1 << 18)


class _Writing:
    """A file under a name of the task attempt's own, renamed when whole."""

    def __init__(self, folder: str, name: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.trial = f"{path}/{name}", f"{path}/{name}.attempt-{TaskContext.get().taskAttemptId()}"
        self.out, self.size = self.fs.open_output_stream(self.trial, compression=None, buffer_size=1 << 20), 0

    def write(self, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        self.size += len(member)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.trial, self.path)


def write_arc(df: DataFrame, folder: str, version: int = 2, date: str = "20260101000000",
              key: str = "page_id", url: str = "url", html: str = "html") -> int:
    """Write the pages of each partition to `part-000000.arc.gz` and so on; returns the number of files."""
    text_batches(df.sparkSession)
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        name = f"part-{n:06d}.arc.gz"
        out = _Writing(folder, name)
        out.write(arc_head(version, date, name))
        for batch in batches:
            for i, u, h in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "html")]):
                block = http_block((h or "").encode(), i)
                out.write(arc_bytes(version, safe_url(u, i), date, "text/html", block, name, out.size))
        out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([n], pa.int32())})

    pages = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(url)).alias("url"), F.col(quoted(html)).alias("html"))
    files = sorted(r.file for r in pages.mapInArrow(write, "file int").collect())
    if files != list(range(len(files))):
        raise RuntimeError("files are missing")
    return len(files)


def _files(spark: SparkSession, n: int) -> DataFrame:
    """(file) of each file, a task for each."""
    return spark.range(0, n, 1, max(1, n)).select(F.col("id").cast("int").alias("file"))


def payloads(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """(file, nth, page_id, payload_bytes, digest) of each record of the ARC files but their heads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with _reading(folder, name := f"part-{file:06d}.arc.gz") as f:
                    for nth, record in enumerate(arc_records(f, name)):
                        if not record.fields["URL"].startswith("filedesc://"):
                            _, payload, page = split_http(record.block)
                            rows.append((file, nth, page, len(payload), sha1(payload)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return _files(spark, files).mapInArrow(read, "file int, nth int, page_id long, payload_bytes long, digest string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("file", pa.int32()), ("nth", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def convert(spark: SparkSession, arc_folder: str, files: int, warc_folder: str, least_bytes: int = 0) -> int:
    """Write `part-000000.warc.gz` for each ARC file; returns the number of records.

    Payloads of fewer than `least_bytes` bytes are responses, however often they occur.
    """
    arc_folder, warc_folder = _uri(arc_folder), _uri(warc_folder)
    found, _ = saved(payloads(spark, arc_folder, files), "arc-records")
    place = F.struct(F.col("page_id").isNull().alias("anonymous"), "page_id", "file", "nth")
    # Written, so that the join deals both sides out and can split the records of a digest that very many share.
    firsts, _ = saved(found.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes")
                      .agg(F.min(place).alias("first")), "arc-firsts")
    known = found.join(firsts, ["digest", "payload_bytes"], "left").select(
        "file", "nth", F.when((F.col("first.file") != F.col("file")) | (F.col("first.nth") != F.col("nth")), F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, records = None, None, None
        for batch in batches:
            for file, nth, first in zip(*[batch.column(c).to_pylist() for c in ("file", "nth", "first")]):
                if file != now:
                    if out:
                        out.close()
                    now, out = file, _Writing(warc_folder, f"part-{file:06d}.warc.gz")
                    name = f"part-{file:06d}.arc.gz"
                    records = enumerate(arc_records(_reading(arc_folder, name), name))
                at, record = next(records)
                while at < nth:
                    out.write(warc_head(file, at, record))
                    at, record = next(records)
                out.write(warc_record(file, nth, record, first))
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([] if now is None else [now], pa.int32())})

    known.repartition(max(1, files), "file").sortWithinPartitions("file", "nth").mapInArrow(write, "file int").count()
    return found.count()


def warc_head(file: int, nth: int, record: ArcRecord) -> bytes:
    return warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, nth)),
                       ("WARC-Date", iso_date(record.fields.get("Archive-date", ""))), ("WARC-Filename", f"part-{file:06d}.warc.gz"),
                       ("Content-Type", "application/warc-fields")],
                      f"software: keepwell\r\nformat: WARC File Format 1.0\r\nisPartOf: ARC version {record.version}\r\n".encode())


def warc_record(file: int, nth: int, record: ArcRecord, first: dict | None) -> bytes:
    """A response, or a revisit of `first`; a block without an HTTP head is a resource."""
    head, payload, page = split_http(record.block)
    kind = "resource" if not head else "response" if first is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, nth)), ("WARC-Date", iso_date(record.fields.get("Archive-date", ""))),
               ("WARC-Target-URI", record.fields["URL"]), ("WARC-IP-Address", record.fields.get("IP-address", "0.0.0.0")),
               ("WARC-Payload-Digest", "sha1:" + sha1(payload)), ("Payload-Length", len(payload)),
               ("Content-Type", "application/http; msgtype=response" if head else record.fields.get("Content-type", "application/octet-stream"))]
    if page is not None:
        headers.append(("Page-Id", page))
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["file"], first["nth"]))]
        if first["page_id"] is not None:
            headers.append(("Refers-To-Page-Id", first["page_id"]))
    return warc_bytes(headers, head if kind == "revisit" else record.block)


def read_warc(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record but the files' own.

    Digests of blocks and of payloads that the archive holds are computed again and must agree.
    """
    folder = _uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                name, rows = f"part-{file:06d}.warc.gz", []
                fs, path = pafs.FileSystem.from_uri(folder)
                if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
                    continue  # an ARC file without records has no WARC file
                with _reading(folder, name) as f:
                    for h, block in warc_records(f, name):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        whole = h["warc-block-digest"] == "sha1:" + sha1(block)
                        payload = block if kind == "resource" else split_http(block)[1]
                        if not whole or kind != "revisit" and (sha1(payload) != digest or len(payload) != int(h["payload-length"])):
                            raise ValueError(f"{name}: digest of {h['warc-record-id']} differs")
                        page, refers = h.get("page-id"), h.get("refers-to-page-id")
                        rows.append((None if page is None else int(page), int(h["payload-length"]), digest, kind,
                                     None if refers is None else int(refers)))
                        if len(rows) == 5000:
                            yield _pages(rows)
                            rows = []
                yield _pages(rows)

    return _files(spark, files).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def archive(df: DataFrame, folder: str | None = None, version: int = 2, least_bytes: int = 0) -> tuple[str, int]:
    """Pages as ARC files, converted to WARC files: (folder of the WARC files, number of files)."""
    folder = folder or scratch_path(df.sparkSession, "archives")
    files = write_arc(df, f"{folder}/arc", version)
    convert(df.sparkSession, f"{folder}/arc", files, f"{folder}/warc", least_bytes)
    return f"{folder}/warc", files
