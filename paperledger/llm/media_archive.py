"""Media columns: archives of media files, and a Spark data source that reads their members.

An archive is a zip file of stored (not compressed again) members, so a member is a byte range and
the zip directory at the end tells where it lies. The data source plans partitions as ranges of
archive bytes from names and sizes alone; each task reads the directory of its archive, takes the
members whose local header begins in its range, reads them in batches of bounded size through Arrow,
checks every member's crc32, and retries a member by its offset without repeating the others.

The media form here is a grey-scale PNG of width 64 with one byte a pixel. It holds a payload of any
positive multiple of 64 bytes without loss.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import ship_package
from . import bytesops as B
from .common import ddl
from .token_planes import open_output, put

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of media in one archive, bytes of archive in one partition, bytes of payload in one batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 4 << 20
ATTEMPTS = 4

ARCHIVES = pa.schema([("archive", pa.string()), ("size", pa.int64()), ("members", pa.int64())])
MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("attempts", pa.int32()), ("content", pa.binary())])


def padded(body: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return body + bytes(-len(body) % WIDTH if body else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey-scale PNG of 8-bit samples, one row for each 64 bytes."""
    rows = len(payload) // WIDTH
    if not rows or rows * WIDTH != len(payload):
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a PNG of to_png."""
    if png[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, rows = 8, [], 0
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour, interlace) != (WIDTH, 8, 0, 0):
                raise ValueError("not the form that to_png writes")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, edges and the histogram of the samples in 16 levels, in whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    edges = int((np.diff(x.astype(np.int16)) != 0).sum())
    return f"{int(x.mean() * 1000)}:{int(x.std() * 1000)}:{edges}:" + ".".join(map(str, levels.tolist()))


def _archive(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def _write(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, row, size = TaskContext.get().partitionId(), 0, 0, 0
        members: list[tuple[str, bytes]] = []

        def flush() -> pa.RecordBatch:
            body = _archive(members)
            name = put(root, f"media-{task:06d}-{number:04d}.zip", body)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, len(body), len(members)), ARCHIVES.types, strict=True)], schema=ARCHIVES)

        for batch in B.slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                body = (text.as_py() or "").encode()
                png = to_png(padded(body))
                members.append((f"{'null' if doc is None else doc}_{len(body)}_{row}.png", png))
                row, size = row + 1, size + len(png)
                if size >= archive_bytes:
                    yield flush()
                    members, number, size = [], number + 1, 0
        if members:
            yield flush()

    return run


def write_archives(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores every text's padded UTF-8 bytes as a PNG member of the zip archives under ``root``,
    with a Parquet list of them beside; returns that list: archive, size, members.

    Member names are id_bytes_row.png, id "null" where there is none. Null texts count as empty, of
    which the payload is 64 bytes 0. Each input row is a member, whether or not it repeats another.
    An empty table gives an empty list. No shuffle. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = f"{root.rstrip('/')}/archives"
    docs.mapInArrow(_write(root, archive_bytes), ddl(ARCHIVES)).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def directory(file, size: int) -> list[tuple[int, str, int, int]]:
    """Offset of the local header, name, size and crc32 of each member, from the zip directory."""

    class Window(io.RawIOBase):
        """The file as zipfile wants it."""

        def seekable(self) -> bool:
            return True

        def readable(self) -> bool:
            return True

        def seek(self, to: int, whence: int = 0) -> int:
            file.seek(to if whence == 0 else size + to if whence == 2 else file.tell() + to)
            return file.tell()

        def tell(self) -> int:
            return file.tell()

        def read(self, n: int = -1) -> bytes:
            return file.read(size - file.tell() if n is None or n < 0 else n)

    with zipfile.ZipFile(Window()) as z:
        return sorted((i.header_offset, i.filename, i.file_size, i.CRC) for i in z.infolist())


def read_member(open_file: Callable, path: str, at: int, size: int, crc: int, file=None, attempts: int = ATTEMPTS, wait: float = 0.2) -> tuple[bytes, int, object]:
    """Bytes of a stored member whose local header is at ``at``; how many attempts it took; the open
    file. A failed or damaged read is repeated from the same offset with the file opened anew."""
    for attempt in range(1, attempts + 1):
        try:
            file = file or open_file(path)
            file.seek(at)
            head = file.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member begins here")
            name, extra = struct.unpack_from("<HH", head, 26)
            file.seek(at + 30 + name + extra)
            body = file.read(size)
            if len(body) != size or zlib.crc32(body) != crc:
                raise OSError("the member is damaged")
            return bytes(body), attempt, file
        except OSError:
            if attempt == attempts:
                raise
            file = None
            time.sleep(wait * attempt)
    raise AssertionError


class Range(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int) -> None:
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self) -> list[Range]:
        """Ranges of bytes from the archives' names and sizes; no directory is read here."""
        import pyarrow.fs

        fs, base = open_output(self.root)
        found = sorted((i.base_name, i.size) for i in fs.get_file_info(pyarrow.fs.FileSelector(base)) if i.base_name.endswith(".zip") and not i.base_name.startswith("."))
        return [Range(name, size, a, min(a + self.range_bytes, size)) for name, size in found for a in range(0, size, self.range_bytes)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, base = open_output(self.root)
        path = f"{base}/{part.archive}"
        with fs.open_input_file(path) as f:
            members = [m for m in directory(f, part.size) if part.start <= m[0] < part.end]
        rows: list[tuple] = []
        size, file = 0, None
        for at, name, n, crc in members:
            body, attempts, file = read_member(fs.open_input_file, path, at, n, crc, file)
            rows.append((part.archive, name, at, attempts, body))
            size += n
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MEMBERS.types, strict=True)], schema=MEMBERS)


class ArchiveSource(DataSource):
    """Format "media_archive": option path, and rangeBytes and batchBytes if not the defaults."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return ddl(MEMBERS)

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archive, name, at (offset), attempts and content of every member under ``root``."""
    ship_package(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", root).option("rangeBytes", str(range_bytes)).load()


FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
            png = content.as_py()
            payload = from_png(png)
            doc, n, _ = name.split("_")
            rows.append((None if doc == "null" else int(doc), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FEATURES.types, strict=True)], schema=FEATURES)


def media_features(members: DataFrame) -> DataFrame:
    """Decodes members (name, content) and computes their digests and feature."""
    ship_package(members.sparkSession)
    return members.select("name", "content").mapInArrow(_features, ddl(FEATURES))


