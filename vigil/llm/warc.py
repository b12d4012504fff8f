"""Legacy archive converter: ARC files to WARC files, and readers of both.

ARC files of version 1 (five header fields) and 2 (ten) are parsed by the header lines their version block announces
and by declared lengths, never by looking for a marker in the content. Each record becomes a WARC/1.1 record whose
identifier is derived from the archive's name and the record's offset (a second run gives the same), with an
ISO timestamp, a type and SHA-1 digests of block and payload. Records with equal payloads are settled with DataFrame
operations on digests: one stays a response, the others become revisit records that name it and carry only the HTTP
head. A group's rows are counted before they are shuffled, and payloads move once, by their digest.

Archives are gzip files of one member per record, written by tasks into the shared folder and moved to the task's
place when complete, so a task that runs again leaves no second copy of its records. They are cut at ``FILE_BYTES`` of records, so that reading one as a whole is bounded by that and the longest record.

Defined cases: null html is an empty payload; a null or odd URL is percent-encoded, a missing one is
``about:blank``; a null page_id is kept (no id line) and is the smallest; of records that repeat both payload and
page_id one is the response; an empty table gives no archive and no rows. Of foreign archives, also uncompressed ones,
records that can't be read (no length, a cut block, other fields than declared, an odd date) are left out, ``arc_rejects``
lists them, and the other members of the file are converted; URLs may hold blanks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import Workspace

FILE_BYTES = 16 << 20
CRAWLED = "20240601000000"  # pages carry no fetch time
ID_LINE = "X-Page-Id"
_ARCS = "*.{arc,arc.gz}"
# Fixed values of the ARC format: the URL-record definition of each version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    """The URL as a header field: without spaces, controls or characters beyond ASCII."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "about:blank"


# ------------------------------------------------------------------------------------------- files
def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Archives:
    """Writes records of one task as gzip members, a new file for each FILE_BYTES.

    Files are written to a hidden folder that becomes the task's folder in one move at the end. The rows of a
    partition are the same in every attempt, so the first complete folder stays.
    """

    def __init__(self, folder: str, task: int, suffix: str, opening: Callable[[str], bytes], file_bytes: int):
        self.fs, self.root = _file_system(folder)
        self.own, self.final = f"{self.root}/_{uuid.uuid4().hex}", f"{self.root}/task-{task:05d}"
        self.task, self.suffix, self.opening, self.file_bytes = task, suffix, opening, file_bytes
        self.count, self.buffer, self.size, self.name = 0, None, 0, ""

    def add(self, record: bytes) -> None:
        if self.buffer is None:
            self.name, self.buffer, self.size = f"part-{self.task:05d}-{self.count:05d}{self.suffix}", io.BytesIO(), 0
            self._member(self.opening(self.name))
        self._member(record)
        if self.size >= self.file_bytes:
            self._flush()

    def _member(self, record: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.buffer.write(pack.compress(record) + pack.flush())
        self.size += len(record)

    def _flush(self) -> None:
        if self.buffer is not None:
            self.fs.create_dir(self.own, recursive=True)
            with self.fs.open_output_stream(f"{self.own}/{self.name}", compression=None) as out:
                out.write(self.buffer.getbuffer())
            self.count, self.buffer = self.count + 1, None

    def commit(self) -> None:
        from pyarrow.fs import FileType

        self._flush()
        if self.count:
            try:
                if self.fs.get_file_info(self.final).type == FileType.NotFound:
                    self.fs.move(self.own, self.final)
                    return
            except OSError:  # another attempt moved its folder there meanwhile
                if self.fs.get_file_info(self.final).type == FileType.NotFound:
                    raise
            self.fs.delete_dir(self.own)


_FEED = 1 << 14  # bytes unpacked at once; what lies behind a member is copied, so not the whole file


def _members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member; a file that isn't gzip is one piece."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        unpack, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and fed < len(content):
                parts.append(unpack.decompress(view[fed:fed + _FEED]))
                fed += _FEED
        except zlib.error as exc:
            raise Damaged(at, "not a whole gzip member") from exc
        if not unpack.eof:
            raise Damaged(at, "not a whole gzip member")
        yield at, b"".join(parts)
        at = min(fed, len(content)) - len(unpack.unused_data)


class Damaged(ValueError):
    """What can't be read, and from which offset on."""

    def __init__(self, offset: int, reason: str):
        super().__init__(reason)
        self.offset, self.reason = offset, reason


def _write(rows: DataFrame, folder: str, suffix: str, opening: Callable[[str], bytes], record: Callable[[dict], bytes],
           file_bytes: int) -> None:
    """Run a job that writes each row as a record."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n = _Archives(folder, TaskContext.get().partitionId(), suffix, opening, file_bytes), 0
        for batch in batches:
            for row in batch.to_pylist():
                out.add(record(row))
                n += 1
        out.commit()
        yield pa.RecordBatch.from_pydict({"records": [n]}, schema=pa.schema([("records", pa.int64())]))

    rows.mapInArrow(task, "records long").agg(F.sum("records")).collect()


def _read(ws: Workspace, folder: str, names: str) -> DataFrame | None:
    """Archives of a folder as (name, content) rows, None if it holds none."""
    fs, root = _file_system(folder)
    from pyarrow.fs import FileType

    if fs.get_file_info(root).type == FileType.NotFound:
        return None
    files = ws.spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


# --------------------------------------------------------------------------------------------- ARC
def arc_opening(version: int) -> Callable[[str], bytes]:
    def make(name: str) -> bytes:
        text = f"{version} 0 vigil\n{' '.join(ARC_FIELDS[version])}\n".encode() + b"\n"
        fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CRAWLED, "Content-type": "text/plain",
                  "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(text))}
        return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + text

    return make


def arc_record(version: int) -> Callable[[dict], bytes]:
    def make(row: dict) -> bytes:
        payload = (row["html"] or "").encode()
        id_line = "" if row["page_id"] is None else f"{ID_LINE}: {row['page_id']}\r\n"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{id_line}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        fields = {"URL": arc_url(row["url"]), "IP-address": "0.0.0.0", "Archive-date": CRAWLED, "Content-type": "text/html",
                  "Result-code": "200", "Checksum": base32_sha1(block), "Location": "-", "Offset": "0", "Filename": "-",
                  "Archive-length": str(len(block))}
        return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"

    return make


def write_arc(pages: DataFrame, folder: str, version: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Legacy input: pages as ARC files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _write(rows, folder, ".arc.gz", arc_opening(version), arc_record(version), file_bytes)


def parse_arc(name: str, content: bytes, rejects: list[tuple[int, str]] | None = None) -> Iterator[dict]:
    """Records of one ARC file, by the fields its version block declares and by declared lengths.

    Header lines are cut from the right, as a URL may hold blanks. With ``rejects``, what can't be read is noted there as
    (offset, reason) and reading goes on with the next gzip member; without, it is an error.
    """
    fields: list[str] = []
    members = _members(content)
    while True:
        offset = at = 0
        try:
            offset, member = next(members)
            while at < len(member):
                if member[at:at + 1] in (b"\n", b"\r"):  # the separator before a header
                    at += 1
                    continue
                head, block, behind = _arc_record_at(name, offset, member, at, fields)
                if head is None:
                    fields = block
                else:
                    yield {"name": name, "offset": offset + at, "url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"],
                           "mime": head["Content-type"], "block": block}
                at = behind
        except StopIteration:
            return
        except ValueError as exc:
            if rejects is None:
                raise
            rejects.append((exc.offset, exc.reason) if isinstance(exc, Damaged) else (offset + at, str(exc)))
            if isinstance(exc, Damaged):  # where the next member starts is not known
                return


def _arc_record_at(name: str, offset: int, member: bytes, at: int, fields: list[str]):
    """(header fields, block, where the record ends); of a version block (None, the fields it declares, its end)."""
    end = member.find(b"\n", at)
    if end < 0:
        raise ValueError(f"{name}: a header at {offset} has no end")
    line = member[at:end].decode("utf-8", "replace").rstrip("\r")
    described = line.startswith("filedesc://")
    if not described and not fields:
        raise ValueError(f"{name}: a record at {offset} before any version block")
    parts = line.split(" ") if described else line.rsplit(" ", len(fields) - 1)
    if not parts[-1].isascii() or not parts[-1].isdigit():
        raise ValueError(f"{name}: a record at {offset} declares no length")
    length = int(parts[-1])
    block = member[end + 1:end + 1 + length]
    if len(block) < length:
        raise ValueError(f"{name}: a record at {offset} declares {length} bytes and has {len(block)}")
    if described:
        lines = block.split(b"\n", 2)
        declared = lines[1].decode("utf-8", "replace").split(" ") if len(lines) > 1 else []
        if not {"URL", "IP-address", "Archive-date", "Content-type"} <= set(declared):
            raise ValueError(f"{name}: a version block at {offset} declares no record fields")
        return None, declared, end + 1 + length
    if len(parts) != len(fields):
        raise ValueError(f"{name}: a record at {offset} has {len(parts)} of {len(fields)} fields")
    head = dict(zip(fields, parts))
    iso_date(head["Archive-date"])
    return head, block, end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found.group(1).decode("utf-8", "replace") if found else None


# ------------------------------------------------------------------------------------- conversion
def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name}#{offset}')}>"


def iso_date(arc_date: str) -> str:
    """A 14-digit ARC date (or a shorter one, down to the year) as a WARC timestamp."""
    digits = (arc_date + "00000101000000"[len(arc_date):])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


_RECORDS = """name string, offset long, record_id string, url string, ip string, date string, page_id long, head binary, payload binary,
              payload_sha1 string, payload_sha256 binary, payload_bytes long"""
_ARROW = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()),
                    ("date", pa.string()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()),
                    ("payload_sha1", pa.string()), ("payload_sha256", pa.binary()), ("payload_bytes", pa.int64())])


def _arc_rows(with_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                rows, size = [], 0
                for r in parse_arc(name, content, rejects=[]):
                    head, payload = split_http(r["block"])
                    page = http_field(head, ID_LINE)
                    rows.append({"name": name, "offset": r["offset"], "record_id": record_id(name, r["offset"]), "url": r["url"], "ip": r["ip"],
                                 "date": iso_date(r["date"]), "page_id": None if page is None else int(page),
                                 "head": head if with_payload else b"", "payload": payload if with_payload else b"",
                                 "payload_sha1": base32_sha1(payload), "payload_sha256": hashlib.sha256(payload).digest(),
                                 "payload_bytes": len(payload)})
                    size += len(r["block"])
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return task


def arc_rejects(ws: Workspace, folder: str) -> DataFrame:
    """(name, offset, reason) of what conversion leaves out of the ARC files of a folder."""
    schema = "name string, offset long, reason string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                rejects: list[tuple[int, str]] = []
                for _ in parse_arc(name, content, rejects):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rejects), pa.string()), pa.array([r[0] for r in rejects], pa.int64()),
                                                  pa.array([r[1] for r in rejects], pa.string())], names=["name", "offset", "reason"])

    arcs = _read(ws, folder, _ARCS)
    return arcs.mapInArrow(task, schema) if arcs is not None else ws.spark.createDataFrame([], schema)


def _warc_head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def warc_opening(name: str) -> bytes:
    block = b"software: vigil\r\nformat: WARC File Format 1.1\r\n"
    return _warc_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", iso_date(CRAWLED)),
                       ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def warc_record(row: dict) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` (an identifier) makes it a revisit."""
    head, payload, revisit = row["head"], row["payload"], row["refers_to"]
    block = head if revisit else head + payload
    kind = "revisit" if revisit else "response" if head else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]),
              ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", f"sha1:{row['payload_sha1']}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", revisit)]
    fields += [("Content-Type", "application/http; msgtype=response" if head else "text/html"), ("Content-Length", str(len(block)))]
    return _warc_head(fields) + block + b"\r\n\r\n"


def convert(ws: Workspace, arc_folder: str, warc_folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> bool:
    """Convert all ARC files of a folder. Payloads of fewer than ``least_bytes`` are never revisits. False if there are none."""
    arcs = _read(ws, arc_folder, _ARCS)
    if arcs is None:
        return False
    kinds = arcs.mapInArrow(_arc_rows(False), _RECORDS).select("record_id", "page_id", "payload_sha256", "payload_bytes")
    repeated = (kinds.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_sha256").alias("same"))
                .agg(F.max(F.struct("page_id", "record_id")).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeated = ws.store(repeated.select("same", F.col("stays.record_id").alias("response_id")), "repeated")
    rows = arcs.mapInArrow(_arc_rows(True), _RECORDS)
    settled = rows.join(repeated, (F.col("payload_sha256") == F.col("same")) & (F.col("payload_bytes") >= least_bytes), "left")
    settled = settled.withColumn("refers_to", F.when(F.col("response_id") != F.col("record_id"), F.col("response_id")))
    _write(settled.select("record_id", "url", "ip", "date", "head", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                          "payload_sha1", "refers_to"), warc_folder, ".warc.gz", warc_opening, warc_record, file_bytes)
    return True


# -------------------------------------------------------------------------------------------- WARC
def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by declared lengths."""
    for _, member in _members(content):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            length = int(fields["Content-Length"])
            block = member[end + 4:end + 4 + length]
            if len(block) < length:
                raise ValueError(f"a record declares {length} bytes and has {len(block)}")
            yield fields, block
            at = end + 4 + length + 4


def _warc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["record_id", "record_type", "url", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "intact"]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for fields, block in parse_warc(content):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block)
                page, digest = http_field(head, ID_LINE), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http_field(head, "Content-Length") or 0) if kind == "revisit" else len(payload)
                intact = fields["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (kind == "revisit" or base32_sha1(payload) == digest)
                rows.append((fields["WARC-Record-ID"], kind, fields["WARC-Target-URI"], None if page is None else int(page), size, digest,
                             fields.get("WARC-Refers-To"), intact))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64"})


_READ = """record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string,
           intact boolean"""


def read_warc(ws: Workspace, folder: str) -> DataFrame:
    """Records of all WARC files of a folder, with the page_id that a revisit refers to."""
    files = _read(ws, folder, "*.warc.gz")
    if files is None:
        return ws.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in re.split(r",\s*", _READ.strip()))],
                                        F.lit(None).cast("long").alias("refers_to"))
    records = ws.store(files.mapInPandas(_warc_rows, _READ), "records")
    named = records.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("__id")).distinct()
    responses = (records.where("record_type <> 'revisit'").select(F.col("record_id").alias("__rid"), F.col("page_id").alias("refers_to"))
                 .join(named, F.col("__rid") == F.col("__id"), "left_semi"))
    return records.join(responses, F.col("refers_to_id") == F.col("__rid"), "left").drop("__rid")
