"""Media columns: payloads in archives on shared storage, read back by a Spark data source.

Writing: each task packs its payloads as 8-bit grey PNG images into one ZIP archive, under a name of its own,
and renames it to its partition's name when complete. A task that runs again writes the same members,
so the folder's archives are always whole and none counts twice.

Reading: the data source ``media_archive`` lists archives (not members), cuts each into byte ranges and
makes a Spark partition of every range. A task reads the archive's own directory, takes the members whose header
lies in its range, and streams them in Arrow batches. A member that fails is opened anew at its
offset, by itself, up to ``retries`` times; one that keeps failing gives a row with ``error`` set. So does, once, an archive whose directory
cannot be read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from depframe.session import discard, materialise, scratch_path

WIDTH = 64
#: Fixed value. First bytes of a PNG file.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
BATCH_BYTES = 8 << 20
#: What a damaged or unreachable archive raises; pyarrow's own errors are among the first two.
FAULTS = (OSError, ValueError, zlib.error, zipfile.BadZipFile, struct.error)
SCHEMA = "member string, offset long, key long, n_bytes long, width int, height int, media binary, payload binary, feature string, error string"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, 64 samples wide, whose samples in order are ``payload``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _png_chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that ``to_png`` made, as rows. ValueError if it is damaged."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        part = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body.append(part)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, exact first and second moments, and a 64-bit gradient hash of an 8 by 9 reduction."""
    x = samples.astype(np.int64)
    rows = np.linspace(0, len(x), 9).astype(int)
    total = np.zeros((len(x) + 1, WIDTH + 1), np.int64)
    total[1:, 1:] = x.cumsum(0).cumsum(1)
    cols = np.linspace(0, WIDTH, 10).astype(int)
    box = total[rows][:, cols]
    cells = box[1:, 1:] - box[:-1, 1:] - box[1:, :-1] + box[:-1, :-1]
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    left, right = cells[:, :-1] * area[:, 1:], cells[:, 1:] * area[:, :-1]
    bits = "".join("1" if b else "0" for b in (left > right).ravel())
    return f"{x.shape[1]}x{x.shape[0]};sum={x.sum()};squares={(x * x).sum()};dhash={int(bits, 2):016x}"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        with ExitStack() as opened:
            archive = None
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if archive is None:  # a task without rows writes no archive
                        store, path = fs.FileSystem.from_uri(folder)
                        own = f"{path}/_{uuid.uuid4().hex}"
                        archive = opened.enter_context(zipfile.ZipFile(_Sink(opened.enter_context(store.open_output_stream(own))), "w", zipfile.ZIP_STORED))
                    data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                    info = zipfile.ZipInfo(f"{n}.png")
                    info.comment = json.dumps({"key": key, "n": len(data)}).encode()
                    media = to_png(padded(data))
                    archive.writestr(info, media)
                    n, size = n + 1, size + len(media)
        if n:
            store.move(own, f"{path}/part-{part:06d}.zip")
            yield pa.RecordBatch.from_pylist([{"archive": f"part-{part:06d}.zip", "members": n, "media_bytes": size}])

    return run


class _Sink:
    """What zipfile needs of a stream that can only be written on."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        return self.out.write(data)

    def flush(self) -> None:
        self.out.flush()


def write_archives(df: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """Store each row's payload; returns the folder. Null texts count as empty; a null key stays null."""
    folder = scratch_path(df.sparkSession, "media")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    rows = df.select(F.col(key).cast("long"), F.col(text).cast("string"))
    discard(materialise(rows.mapInArrow(_write(folder), "archive string, members long, media_bytes long"), "manifest"))
    return folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.step = int(options.get("range_bytes", 32 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, path = fs.FileSystem.from_uri(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".zip")]
        return [ByteRange(f.path, a, a + self.step) for f in files for a in range(0, f.size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        with ExitStack() as opened:
            archive, error = self.opened(store, partition.archive, opened)
            if archive is None:
                if partition.start == 0:  # one row tells of the archive
                    yield _batch([{"member": partition.archive, "offset": 0, "error": error}])
                return
            rows, size = [], 0
            for info in sorted(archive.infolist(), key=lambda i: i.header_offset):
                if partition.start <= info.header_offset < partition.end:
                    row = self.member(store, partition.archive, archive, info)
                    rows.append(row)
                    size += len(row["media"] or b"") + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    def opened(self, store: fs.FileSystem, path: str, stack: ExitStack) -> tuple[zipfile.ZipFile | None, str]:
        """The archive with its directory read, tried anew like a member; or none and the last error."""
        error = ""
        for _ in range(self.retries + 1):
            try:
                return stack.enter_context(zipfile.ZipFile(stack.enter_context(store.open_input_file(path)))), ""
            except FAULTS as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def member(self, store: fs.FileSystem, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> dict:
        """One member's row. After a failure the archive is opened anew and read at this member's offset only."""
        told = json.loads(info.comment or b"{}")
        row = {"member": info.filename, "offset": info.header_offset, "key": told.get("key"), "n_bytes": told.get("n")}
        error = ""
        for attempt in range(self.retries + 1):
            try:
                if attempt == 0:
                    media = archive.read(info)
                else:
                    with store.open_input_file(path) as again, zipfile.ZipFile(again) as fresh:
                        media = fresh.read(info)
                samples = from_png(media)
                return row | {"width": samples.shape[1], "height": samples.shape[0], "media": media, "payload": samples.tobytes(), "feature": feature(samples), "error": None}
            except FAULTS as e:
                error = f"{type(e).__name__}: {e}"
        return row | {"width": None, "height": None, "media": None, "payload": None, "feature": None, "error": error}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.strip().split(" ") for f in SCHEMA.split(","))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


class MediaArchiveSource(DataSource):
    """Options: path (folder of archives), range_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, n_bytes and what was read back: media, payload, width, height, feature, error.

    An empty table, and one of empty partitions alone, gives no rows. Other columns of ``df`` are not stored.
    """
    return read_archives(df.sparkSession, write_archives(df, key, text))
