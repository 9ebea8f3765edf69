"""Media columns: archives of images, read by a custom Spark data source.

``store`` writes one ZIP archive per task into the shared folder; each row's
payload becomes one member, a lossless 8-bit grey PNG of 576 samples a line.  A
manifest, written as a table, names the archives of the tasks that succeeded,
so what a lost or repeated task left behind is never read.

``MediaArchives`` is the data source ``media_archives``: it plans byte ranges
over the archives from their sizes alone.  A task reads its archive's central
directory, takes the members whose header starts in its range, and streams them
in Arrow batches of bounded size.  A member that can't be read or whose CRC is
wrong is read again by its offset, with a fresh handle, while the others go on
untouched.

Archives are opened with ``pyarrow.fs``, so the shared folder can be any store
it knows (local, HDFS, object stores).

Defined results: a null text is an empty one.  Every payload has at least one
line of 576 samples.  Repeated rows give repeated members; a null key stays
null; a key is at most 20,000 bytes as text, which its member's name can hold.  Only the key and the text are read, so clashing names do no harm.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braidwork.shared import Written, bounded_batches, fresh_path

LINE = 576
PAD = b"\xff"  # never part of UTF-8
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The local header of a ZIP member without its name and extra field.
ZIP_HEADER = struct.Struct("<4s5H3I2H")
BATCH_BYTES = 8 << 20
EPOCH = (1980, 1, 1, 0, 0, 0)


def member_name(n: int, key: str | None) -> str:
    """A member's name: its number, and its key in printable ASCII."""
    return f"{n}/{'' if key is None else 'k' + quote(key, safe='')}.png"


def key_of(name: str) -> str | None:
    found = name.partition("/")[2].removesuffix(".png")
    return unquote(found[1:]) if found else None


def payload_of(text: str | None) -> bytes:
    """UTF-8 padded to a positive multiple of a line."""
    data = (text or "").encode()
    return data + PAD * ((-len(data)) % LINE if data else LINE)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A grey 8-bit PNG whose samples are the payload."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)  # filter type 0 before every line
    raw[:, 1:] = lines
    header = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, pixels, shape = 8, [], (0, 0)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            pixels.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(pixels)), np.uint8).reshape(shape)
    if raw[:, 0].any():
        raise ValueError("filtered lines are not read")
    return raw[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and the shares of eight equal ranges of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    level = np.arange(256)
    mean = float(share @ level)
    seen = share[share > 0]
    parts = [mean, float(share @ (level - mean) ** 2) ** 0.5, float(-(seen * np.log2(seen)).sum()), *share.reshape(8, 32).sum(axis=1).tolist()]
    return ",".join(f"{x:.4f}" for x in parts)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[str, str]:
    """Write the archives; (folder, path of the manifest)."""
    folder = folder or fresh_path(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        archive, name, n = None, f"media-{uuid.uuid4().hex}.zip", 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if archive is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                for k, t in zip(batch.column(0), batch.column(1), strict=True):
                    member = zipfile.ZipInfo(member_name(n, k.as_py()), EPOCH)
                    archive.writestr(member, encode_png(payload_of(t.as_py())))
                    n += 1
        finally:
            if archive is not None:
                archive.close()
                stream.close()
        if archive is not None:
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([fs.get_file_info(f"{base}/{name}").size], pa.int64()), "members": pa.array([n], pa.int64())})

    done = bounded_batches(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).mapInArrow(write, "archive string, bytes bigint, members bigint")
    return folder, Written(done, "manifest").path


class Range(InputPartition):
    """Members of an archive whose header starts at a byte from start on and before end."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


def read_member(opened: Callable[[], io.IOBase], info: zipfile.ZipInfo, tries: int = 4, wait: float = 0.2) -> bytes:
    """A stored member's bytes, read by offset and held against its CRC; other members are not touched."""
    for k in range(tries):
        try:
            with opened() as f:
                f.seek(info.header_offset)
                head = ZIP_HEADER.unpack(f.read(ZIP_HEADER.size))
                if head[0] != b"PK\x03\x04":
                    raise OSError("no member starts here")
                f.seek(info.header_offset + ZIP_HEADER.size + head[9] + head[10])
                data = f.read(info.compress_size)
            if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise OSError("the member is cut short or damaged")
            return data
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options["manifest"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))

    def partitions(self) -> list[Range]:
        fs, path = pafs.FileSystem.from_uri(self.manifest)
        rows = ds.dataset(path, filesystem=fs, format="parquet").to_table().to_pylist()
        return [Range(r["archive"], at, at + self.range_bytes) for r in sorted(rows, key=lambda r: r["archive"]) for at in range(0, r["bytes"], self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = pafs.FileSystem.from_uri(self.folder)
        opened = lambda: fs.open_input_file(f"{base}/{partition.archive}")
        with opened() as f, zipfile.ZipFile(f) as directory:
            members = [m for m in directory.infolist() if partition.start <= m.header_offset < partition.end]
        keys: list[str | None] = []
        media: list[bytes] = []
        held = 0
        for m in members:
            keys.append(key_of(m.filename))
            media.append(read_member(opened, m))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield self.batch(keys, media)
                keys, media, held = [], [], 0
        if keys:
            yield self.batch(keys, media)

    @staticmethod
    def batch(keys: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary())], names=["key", "media"])


class MediaArchives(DataSource):
    """format("media_archives"); options path (folder), manifest, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key string, media binary"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


MEASURES = T.StructType([T.StructField(n, k) for n, k in (("key", T.StringType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = media.as_py()
            payload = decode_png(media)
            rows.append((key, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, MEASURES, strict=True)], names=MEASURES.names)


def read_archives(spark, folder: str, manifest: str, range_bytes: int = 16 << 20) -> DataFrame:
    """(key, media) of every member."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("manifest", manifest).option("range_bytes", range_bytes).load(folder)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = 16 << 20) -> DataFrame:
    """Store every text as media, read it back and measure it; one row per row of docs."""
    read = read_archives(docs.sparkSession, *store(docs, key, text), range_bytes)
    return read.mapInArrow(_measure, MEASURES).withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
