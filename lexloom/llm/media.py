"""Media columns: texts stored as images in archives, read back by a Spark data source.

*Writing.*  Each text becomes a payload (UTF-8, filled with bytes 255 to a positive multiple of
``ROW`` samples), each payload an 8-bit grey PNG of ``ROW`` samples a line, and each task packs
its images as members of ZIP archives in the shared folder.  Archives have new names for every
task attempt; a table written by Spark lists those of successful attempts, so an archive left
by a lost executor is never read.  An attempt that fails removes its own archives.

*Reading.*  ``MediaArchiveSource`` plans byte-range partitions over the listed archives: a
partition reads an archive's directory and takes the members whose offset lies in its range.
Members stream out in Arrow batches of bounded size.  A member that can't be read is tried
again on its own, by its offset, with the archive opened anew; only then does the task fail.

A text's own length is measured on the samples read back: byte 255 occurs in no UTF-8 text, so
what stands before the filling is the text.

Null texts count as empty.  Very long texts are stored whole, as one image.  Repeated rows are
members of their own, null ids too; there are no ties.  Other columns are ignored and an empty
table gives an empty result.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import materialize, new_path
from .wordtools import chunks

ROW = 576
#: Size at which a task starts another archive, and bytes of archive planned for one partition.
ARCHIVE_BYTES = 128 << 20
PART_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3

_PNG = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- stored form


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\xff")


def own_bytes(payload: bytes) -> bytes:
    """A payload without its filling."""
    return payload.rstrip(b"\xff")


def arrow_uri(uri: str) -> str:
    """A place of Spark's as Arrow writes it: the names that Hadoop has for S3 mean S3."""
    scheme, _, rest = uri.partition("://")
    return f"s3://{rest}" if scheme in ("s3a", "s3n") else uri


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(uri))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """8-bit grey image, ``ROW`` samples a line, lossless."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image made by ``png``; every chunk's checksum is verified."""
    if image[:8] != _PNG:
        raise ValueError("not an image")
    at, body, width = 8, [], 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if binascii.crc32(kind + data) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, a 16-level histogram (per mille) and a 64-bit mean hash of the samples."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) // np.maximum(1, np.diff(np.append(np.arange(64) * len(x) // 64, len(x))))
    bits = int("".join("1" if c > cells.mean() else "0" for c in cells), 2)
    return f"mean={x.mean():.3f};std={x.std():.3f};hist={','.join(map(str, levels))};hash={bits:016x}"


# ---------------------------------------------------------------- writing


def _archives(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write archives; one row for each finished one."""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    names: list[str] = []
    complete = False

    def finished(name, archive, sink, members):
        archive.close()
        size = sink.tell()
        sink.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([members], pa.int64())], ["path", "size", "members"])

    archive = None
    members = 0
    try:
        for batch in batches:
            for part in chunks(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if archive is None:
                        name = f"{uuid.uuid4().hex}.zip"
                        names.append(name)
                        sink = system.open_output_stream(f"{base}/{name}")
                        archive, members = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, strict_timestamps=False), 0
                    archive.writestr(zipfile.ZipInfo(f"{members}.{'' if doc is None else doc}.png"), png(payload_of(text)))
                    members += 1
                    if sink.tell() >= ARCHIVE_BYTES:
                        yield finished(name, archive, sink, members)
                        archive = None
        if archive is not None:
            yield finished(name, archive, sink, members)
        complete = True
    finally:
        if not complete:  # another attempt writes its own
            for name in names:
                try:
                    system.delete_file(f"{base}/{name}")
                except OSError:
                    pass


def write_archives(docs: DataFrame) -> DataFrame:
    """Store every text as a member of an archive; ``(path, size, members)`` of the archives."""
    folder = new_path(docs.sparkSession, "media")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(lambda batches: _archives(batches, folder), "path string, size long, members long"), "archives")


# ---------------------------------------------------------------- reading


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options["path"]
        self.part_bytes = int(options.get("partbytes", options.get("partBytes", PART_BYTES)))

    def partitions(self) -> list[_Range]:
        system, base = file_system(self.table)
        out = []
        for info in system.get_file_info(fs.FileSelector(base)):
            if info.is_file and info.base_name.startswith("part-") and info.extension == "parquet":
                listed = pq.read_table(info.path, filesystem=system, columns=["path", "size"])
                for path, size in zip(listed.column("path").to_pylist(), listed.column("size").to_pylist(), strict=True):
                    count = max(1, -(-size // self.part_bytes))
                    out += [_Range(path, size * i // count, size * (i + 1) // count) for i in range(count)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with _Archive(part.path) as archive:
            held, size = [], 0
            for member in archive.directory():
                if part.start <= member.header_offset < part.end:
                    held.append((part.path, member.filename, member.header_offset, archive.member(member)))
                    size += len(held[-1][3])
                    if size >= BATCH_BYTES:
                        yield _member_batch(held)
                        held, size = [], 0
            if held:
                yield _member_batch(held)


_MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("image", pa.binary())])


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEMBERS)], schema=_MEMBERS)


class _Archive:
    """An open archive; reads that fail are tried again with the file opened anew."""

    def __init__(self, uri: str):
        self.system, self.path = file_system(uri)
        self.file = None

    def __enter__(self):
        return self

    def __exit__(self, *error):
        if self.file is not None:
            self.file.close()

    def _retried(self, read):
        for again in range(TRIES):
            try:
                if self.file is None:
                    self.file = self.system.open_input_file(self.path)
                return read(self.file)
            except (OSError, ValueError, zipfile.BadZipFile, zlib.error):
                self.file = None
                if again + 1 == TRIES:
                    raise
                time.sleep(0.2 * (again + 1))

    def directory(self) -> list[zipfile.ZipInfo]:
        return self._retried(lambda f: zipfile.ZipFile(f).infolist())

    def member(self, info: zipfile.ZipInfo) -> bytes:
        """Bytes of one member, found by its offset and checked against the directory."""

        def read(f):
            head = f.read_at(30, info.header_offset)
            name, extra = struct.unpack("<HH", head[26:30])
            body = f.read_at(info.compress_size, info.header_offset + 30 + name + extra)
            if head[:4] != b"PK\x03\x04" or len(body) != info.compress_size or binascii.crc32(body) != info.CRC:
                raise ValueError(f"member at {info.header_offset} of {self.path} can't be read")
            return body

        return self._retried(read)


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(table)``: members of the archives that a table lists."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, image binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_archives(archives: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    spark = archives.sparkSession
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").option("partBytes", str(part_bytes)).load(archives._lexloom_path)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for member, image in zip(batch.column("member").to_pylist(), batch.column("image").to_pylist(), strict=True):
            doc = member.split(".")[1]
            x = samples(image)
            rows.append((int(doc) if doc else None, len(own_bytes(x)), len(x), hashlib.sha256(x).hexdigest(), binascii.crc32(x[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(x)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def describe(members: DataFrame) -> DataFrame:
    """Digests and features of stored members, from the bytes read back."""
    return members.select("member", "image").mapInArrow(
        _described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def payloads(members: DataFrame) -> DataFrame:
    """``(doc_id, payload binary)``: the stored texts' own bytes, without the filling."""

    def run(batches):
        for batch in batches:
            out = [(m.split("."), samples(i)) for m, i in zip(batch.column("member").to_pylist(), batch.column("image").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(m[1]) if m[1] else None for m, _ in out], pa.int64()), pa.array([own_bytes(x) for _, x in out], pa.binary())], ["doc_id", "payload"])

    return members.select("member", "image").mapInArrow(run, "doc_id long, payload binary")
