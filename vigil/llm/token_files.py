"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding, with control bytes apart from the data.

Ids are counted over all documents; an id is written as its rank, the most frequent one as 0. A rank takes 0, 1, 2 or 4
data bytes (little-endian) by a two-bit code; the codes of four ranks make one control byte, padded with zeros at the
end of a document, so that a document's bytes can be copied as they are. Reading looks the four lengths up in a table
by control byte; sums of lengths give all offsets at once.

A folder holds ``ranks.vtr`` (the id of each rank, 32-bit) and files ``part-<part>-<n>.vtk`` in ascending order:

* header, little-endian 64-bit: magic, documents, ids, control bytes, data bytes, CRC-32 of what follows;
* per document: its id (0 for null), 1 for null, number of ids (each 64-bit); then all control bytes; then all data bytes.

Documents are in ascending order of ``doc_id``, nulls first. Ranges are cut by (id, text hash, place), so one id that
holds a third of the rows spans several files. A text is encoded once, where it is read; its ids are stored, and its coded
bytes are shuffled once. Files come from tasks by way of a hidden folder that is moved when complete, so a task that runs again leaves no
second copy.

Defined cases: null and empty texts hold the end id only; a null ``doc_id`` is kept; rows that share an id or are equal
follow one another in the order of their texts' hashes; further columns are not read; an empty table gives a folder
without part files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.encoding import IdEncoder, gathered, per_process, slices
from vigil.llm.shared import Workspace, body, row_key

FILE_BYTES = 16 << 20
_BYTES_PER_ID = 2  # about what an id takes
CUT_BYTES = 4 << 20  # of texts or ids that are in pieces at a time
_MAGIC = int.from_bytes(b"VIGILTK1", "little")
_HEADER = "<6Q"
_HEADER_BYTES = struct.calcsize(_HEADER)
_BYTES = np.array([0, 1, 2, 4], np.int64)  # of a code
_LENGTHS = _BYTES[np.stack([(np.arange(256) >> shift) & 3 for shift in (0, 2, 4, 6)], 1)]  # four lengths of a control byte


# ------------------------------------------------------------------------------------------ coding
def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ``ranks`` holds the documents one after the other."""
    quads = -(-counts // 4)
    padded = np.zeros(int(quads.sum()) * 4, np.uint32)
    padded[gathered((np.cumsum(quads) - quads) * 4, counts)] = ranks
    codes = (padded > 0).astype(np.uint8) + (padded > 0xFF) + (padded > 0xFFFF)
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    lengths = _BYTES[codes]
    data = padded.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()
    control_ends = np.cumsum(quads)
    data_ends = np.concatenate(([0], np.cumsum(lengths)))[control_ends * 4]
    cut = lambda whole, ends: [whole[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
    return cut(control, control_ends), cut(data, data_ends)


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents of ``counts`` ids, one after the other."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    starts = np.cumsum(lengths) - lengths
    quads = -(-counts // 4)
    kept = gathered((np.cumsum(quads) - quads) * 4, counts)  # without padding
    lengths, starts = lengths[kept], starts[kept]
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    ranks = np.zeros(len(kept), np.uint32)
    for k in range(4):
        at = lengths > k
        ranks[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def to_file(rows: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A file of (doc_id, number of ids, control bytes, data bytes) rows."""
    index = np.array([(d or 0, d is None, n) for d, n, _, _ in rows], "<i8").reshape(-1, 3)
    control, data = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
    content = index.tobytes() + control + data
    return struct.pack(_HEADER, _MAGIC, len(rows), int(index[:, 2].sum()), len(control), len(data), zlib.crc32(content)) + content


def from_file(content: bytes, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, is null, number of ids, ranks) of the documents of a file, about ``most`` ids or one document at a time.

    An error before the first of them if a byte of the file is not as written.
    """
    if len(content) < _HEADER_BYTES:
        raise ValueError("not a whole token file")
    magic, documents, ids, n_control, n_data, crc = struct.unpack_from(_HEADER, content)
    at = _HEADER_BYTES + documents * 24
    view = memoryview(content)
    if magic != _MAGIC or len(content) != at + n_control + n_data or zlib.crc32(view[_HEADER_BYTES:]) != crc:
        raise ValueError("not a whole token file")
    index = np.frombuffer(content, "<i8", documents * 3, _HEADER_BYTES).reshape(-1, 3)
    quads = -(-index[:, 2] // 4)
    if int(index[:, 2].sum()) != ids or int(quads.sum()) != n_control:
        raise ValueError("a token file whose index differs from its header")
    control, data = view[at:at + n_control], view[at + n_control:]
    for a, b in _runs(index[:, 2], most):
        used = int(quads[a:b].sum())
        size = int(_LENGTHS.sum(1)[np.frombuffer(control[:used], np.uint8)].sum())
        yield index[a:b, 0], index[a:b, 1] == 1, index[a:b, 2], decode(control[:used], data[:size], index[a:b, 2])
        control, data = control[used:], data[size:]


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum, or of one."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0) > 0) + 1
    edges = [0, *[int(c) for c in cuts if c < len(sizes)], len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


# ------------------------------------------------------------------------------------------- files
def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _TaskFolder:
    """Files of one task, visible all at once."""

    def __init__(self, folder: str, task: int):
        self.fs, self.root = _file_system(folder)
        self.own, self.final, self.any = f"{self.root}/_{uuid.uuid4().hex}", f"{self.root}/task-{task:05d}", False

    def write(self, name: str, content: bytes) -> None:
        self.fs.create_dir(self.own, recursive=True)
        with self.fs.open_output_stream(f"{self.own}/{name}", compression=None) as out:
            out.write(content)
        self.any = True

    def commit(self) -> None:
        from pyarrow.fs import FileType

        if not self.any:
            return
        try:
            if self.fs.get_file_info(self.final).type == FileType.NotFound:
                self.fs.move(self.own, self.final)
                return
        except OSError:  # another attempt was first
            if self.fs.get_file_info(self.final).type == FileType.NotFound:
                raise
        self.fs.delete_dir(self.own)


# -------------------------------------------------------------------------------------------- jobs
_ORDER = ["doc_id", "key", "place"]


def token_ids(docs: DataFrame, ws: Workspace, path: str, end_id: int) -> DataFrame:
    """Stored: doc_id, key, place, ids (binary, 32-bit each; ``end_id`` last). Texts are read and encoded here, once."""
    # rows that are equal in id and text are told apart by their place, so that they too are dealt out
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), place.alias("place"), body().alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(("ids", path), lambda: IdEncoder(path))
        for batch in (part for whole in batches for part in slices(whole, 3, CUT_BYTES)):
            ids, counts = coder.encode(batch.column(3))
            ends = np.cumsum(counts + 1)
            whole = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
            whole[gathered(ends - counts - 1, counts)] = ids
            blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], blobs], names=[*_ORDER, "ids"])

    return ws.store(keyed.mapInArrow(task, "doc_id long, key long, place long, ids binary"), f"ids-{uuid.uuid4().hex}", compression="zstd")


def rank_ids(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """The id of each rank, by descending frequency over all documents, and the number of all ids. As many rows as the vocabulary has ids."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0, CUT_BYTES)):
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(totals))
            found[:len(totals)] += totals
            totals = found
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"id": seen.astype(np.int64), "n": totals[seen].astype(np.int64)})

    per_id = encoded.select("ids").mapInArrow(task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = per_id.orderBy(F.desc("n"), "id").collect()
    return np.array([r.id for r in found], np.uint32), sum(r.n for r in found)


def _ranges(encoded: DataFrame, parts: int) -> list[tuple]:
    """The first (doc_id, key, place) of each of ``parts`` ranges but the first."""
    firsts = (encoded.select(*_ORDER).repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in _ORDER]).groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), *_ORDER)).alias("first")).collect())
    return sorted((r.first.known, r.first.doc_id or 0, r.first.key, r.first.place) for r in firsts)[1:]


def write(docs: DataFrame, ws: Workspace, folder: str, path: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all ``docs``, by the tokenizers file at ``path`` and with ``end_id`` after each document, to a new folder."""
    encoded = token_ids(docs, ws, path, end_id)
    by_rank, total_ids = rank_ids(encoded)
    bounds = _ranges(encoded, max(1, -(-total_ids * _BYTES_PER_ID // file_bytes)))  # a range is about a file
    space, root = _file_system(folder)
    space.create_dir(root, recursive=True)
    with space.open_output_stream(f"{root}/ranks.vtr", compression=None) as out:
        out.write(by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in (part for whole in batches for part in slices(whole, 3, CUT_BYTES)):
            doc_ids, keys, places, blobs = (batch.column(k).to_pylist() for k in range(4))
            counts = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            control, data = encode(rank_of[np.frombuffer(b"".join(blobs), "<u4")], counts)
            parts = [bisect_right(bounds, (d is not None, d or 0, k, p)) for d, k, p in zip(doc_ids, keys, places)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *batch.columns[:3], pa.array(counts, pa.int64()), pa.array(control, pa.binary()),
                                              pa.array(data, pa.binary())], names=["part", *_ORDER, "n", "control", "data"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, part, number, rows, size, total = _TaskFolder(folder, TaskContext.get().partitionId()), -1, 0, [], 0, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 4, 5, 6)]
            for p, doc_id, n, control, data in zip(*columns):
                if rows and (p != part or size >= file_bytes):
                    out.write(f"part-{part:08d}-{number:08d}.vtk", to_file(rows))
                    number, rows, size = number + 1 if p == part else 0, [], 0
                elif p != part:
                    number = 0
                part = p
                rows.append((doc_id, n, control, data))
                size += len(control) + len(data) + 24
                total += n
        if rows:
            out.write(f"part-{part:08d}-{number:08d}.vtk", to_file(rows))
        out.commit()
        yield pa.RecordBatch.from_pydict({"ids": [total]}, schema=pa.schema([("ids", pa.int64())]))

    rows = encoded.mapInArrow(coded, "part long, doc_id long, key long, place long, n long, control binary, data binary")
    ranged = rows.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", *[F.col(c).asc_nulls_first() for c in _ORDER])
    ranged.mapInArrow(files, "ids long").agg(F.sum("ids")).collect()


_READ = "name string, doc_id long, first long, n_tokens long, ids_crc32 long, ids array<int>"


def read(ws: Workspace, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a folder: name of its file, doc_id, first (ids before it in the file), n_tokens, ids_crc32, ids (if wanted)."""
    ranks = ws.spark.read.format("binaryFile").load(f"{folder}/ranks.vtr").select("content").head()  # none where it is empty
    by_rank = np.frombuffer(bytes(ranks[0]) if ranks else b"", "<u4")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, before = batch.column("name")[k].as_py(), 0
                for doc_ids, missing, counts, ranks in from_file(batch.column("content")[k].as_py()):
                    ids, ends = by_rank[ranks].astype("<u4"), np.cumsum(counts)
                    raw = memoryview(ids.tobytes())
                    sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))) if with_ids \
                        else pa.nulls(len(ends), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(ends), pa.string()), pa.array(doc_ids, pa.int64(), mask=missing), pa.array(ends - counts + before, pa.int64()),
                         pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), lists], names=["name", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])
                    before += int(counts.sum())

    found = ws.spark.read.format("binaryFile").option("pathGlobFilter", "*.vtk").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(task, _READ)


def positions(ws: Workspace, folder: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The ids of earlier files are summed over one row per file.
    """
    from pyspark.sql import Window

    rows = ws.store(read(ws, folder, with_ids=False).drop("ids"), f"positions-{uuid.uuid4().hex}")
    sums = rows.groupBy("name").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("name", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "name").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
