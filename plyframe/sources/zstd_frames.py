"""Zstandard archives of many frames as a data source: one task a group of frames.

Spark's text source reads a ``.zst`` file in one task.  An archive written as a
sequence of independent frames (as parallel and seekable compressors do) can be
read from any frame on.  This source finds the frames without decompressing
anything - from the seek table at the file's end where there is one, else from
block header to block header - and deals them out by their compressed bytes.

Records are parted by a separator, as with the text source's ``lineSep``; frames
may be cut anywhere.  A record belongs to the task in whose frames its separator
starts: a task skips to the first one and reads on into later frames until its
last record is whole, so no game is lost, doubled or cut.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Magic numbers of the Zstandard and seekable formats.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = 0x184D2A50  # and the fifteen after it
SEEK_TABLE = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
#: Compressed bytes a task reads, about; bytes decompressed at once; text a written frame holds.
PARTITION_BYTES = 64 << 20
CHUNK = 1 << 20
FRAME_BYTES = 8 << 20
RECORDS_AT_ONCE = 1000
#: Frames behind its own that a task knows from the start.
AFTER = 8
SCHEMA = "file string, record_id long, value string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as tasks open it (Hadoop's short ``file:/x`` as well)."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def archive_files(path: str) -> list[str]:
    """The file, or the ``.zst`` files of the folder, in name order."""
    fs, where = file_system(path)
    if fs.get_file_info(where).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
    names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".zst")
                   and not any(p.startswith(("_", ".")) for p in f.path[len(where):].split("/")))
    return [path.rstrip("/") + n[len(where.rstrip("/")):] for n in names]


def seek_table(f, size: int) -> list[tuple[int, int]] | None:
    """(offset, bytes) of the frames by the seek table at the end; None without one."""
    if size < 17:
        return None
    f.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_FOOTER:
        return None
    entry = 12 if descriptor & 0x80 else 8
    start = size - 9 - count * entry
    if start < 8:
        return None
    f.seek(start - 8)
    table = f.read(8 + count * entry)
    if struct.unpack("<II", table[:8]) != (SEEK_TABLE, count * entry + 9):
        return None
    out, at = [], 0
    for i in range(count):
        (own,) = struct.unpack_from("<I", table, 8 + i * entry)
        out.append((at, own))
        at += own
    return out if at == start - 8 else None


def scanned_frames(f, size: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the frames, found by hopping from block header to block header."""
    out, at = [], 0
    while at < size:
        f.seek(at)
        head = f.read(18)
        if len(head) < 8:
            raise ValueError(f"cut off frame at byte {at}")
        magic, length = struct.unpack_from("<II", head)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        flags = head[4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        fields = (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        end, last = at + 5 + fields, False
        while not last:
            f.seek(end)
            block = f.read(3)
            if len(block) < 3:
                raise ValueError(f"cut off frame at byte {at}")
            value = int.from_bytes(block, "little")
            last, kind, length = bool(value & 1), value >> 1 & 3, value >> 3
            end += 3 + (1 if kind == 1 else length)
        end += 4 * checksum
        if end > size:
            raise ValueError(f"cut off frame at byte {at}")
        out.append((at, end - at))
        at = end
    return out


def frames_of(path: str) -> list[tuple[int, int]]:
    fs, where = file_system(path)
    size = fs.get_file_info(where).size
    with fs.open_input_file(where) as f:
        table = seek_table(f, size)
        return table if table is not None else scanned_frames(f, size)


@dataclass
class Frames(InputPartition):
    """A task's own frames of a file, the number of the first, and the next few: its last record ends in one of
    them, as a rule (where not, the task looks the rest up itself)."""

    path: str
    low: int
    own: tuple[tuple[int, int], ...]
    after: tuple[tuple[int, int], ...]

    def frames(self) -> Iterator[tuple[tuple[int, int], bool]]:
        yield from ((f, True) for f in self.own)
        yield from ((f, False) for f in self.after)
        if len(self.after) == AFTER:
            yield from ((f, False) for f in frames_of(self.path)[self.low + len(self.own) + AFTER:])


class _Bytes:
    """The next ``left`` bytes of a file, as a file."""

    def __init__(self, f, left: int):
        self.f, self.left = f, left

    def read(self, n: int = -1) -> bytes:
        data = self.f.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.separator = options["path"], options.get("separator", "\n").encode()
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Frames]:
        out = []
        for path in archive_files(self.path):
            frames, low, held = tuple(frames_of(path)), 0, 0
            for i, (_, own) in enumerate(frames):
                held += own
                if held >= self.size or i == len(frames) - 1:
                    out.append(Frames(path, low, frames[low: i + 1], frames[i + 1: i + 1 + AFTER]))
                    low, held = i + 1, 0
        return out

    def _text(self, p: Frames) -> Iterator[tuple[bytes, bool]]:
        """Decompressed chunks, and whether they are of the task's own frames."""
        import zstandard
        fs, where = file_system(p.path)
        with fs.open_input_file(where) as f:
            for (at, size), own in p.frames():
                f.seek(at)
                reader = zstandard.ZstdDecompressor().stream_reader(_Bytes(f, size))
                while chunk := reader.read(CHUNK):
                    yield chunk, own

    def _records(self, p: Frames) -> Iterator[bytes]:
        sep, buffer, seen, own_end = self.separator, b"", 0, 0  # seen: text before the buffer
        started, look = p.low == 0, 0
        for chunk, own in self._text(p):
            buffer += chunk
            if own:
                own_end += len(chunk)
            while True:
                at = buffer.find(sep, look)
                if at < 0:
                    look = max(0, len(buffer) - len(sep) + 1)
                    break
                beyond = not own and seen + at >= own_end
                if started:
                    yield buffer[:at]
                if beyond:
                    return
                started = True
                seen, buffer, look = seen + at + len(sep), buffer[at + len(sep):], 0
            if not started:  # text of the record before: only a separator's beginning may still matter
                seen, buffer, look = seen + look, buffer[look:], 0
                if not own and seen >= own_end:
                    return
        if started and buffer:
            yield buffer

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("record_id", pa.int64()), ("value", pa.string())])

        def batch(values: list[str], at: int) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()),
                                               pa.array(range(at, at + n), pa.int64()), pa.array(values, pa.string())], schema=schema)

        held, at = [], partition.low << 32
        for record in self._records(partition):
            held.append(record.decode("utf-8", "replace"))
            if len(held) == RECORDS_AT_ONCE:
                yield batch(held, at)
                held, at = [], at + len(held)
        if held:
            yield batch(held, at)


@dataclass
class Written(WriterCommitMessage):
    aside: str
    name: str


class FrameWriter(DataSourceArrowWriter):
    """One archive a task: independent frames of about ``frameBytes`` of text, and a seek table at the end.

    Tasks write under ``_temporary``; the commit moves what succeeded into place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.frame = options["path"], int(options.get("frameBytes", FRAME_BYTES))
        self.separator = options.get("separator", "\n")
        fs, where = file_system(self.path)
        if overwrite:
            raise ValueError("zstd_frames writes to a new folder (mode append)")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard
        fs, where = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.zst"
        aside = f"{where.rstrip('/')}/_temporary/{name}"
        fs.create_dir(aside.rsplit("/", 1)[0])
        table, text, size, compressor = [], [], 0, zstandard.ZstdCompressor(write_checksum=True)
        with fs.open_output_stream(aside, compression=None) as out:
            def frame() -> None:
                data = "".join(text).encode()
                packed = compressor.compress(data)
                out.write(packed)
                table.append(struct.pack("<II", len(packed), len(data)))

            for batch in iterator:
                for value in batch.column("value").to_pylist():
                    text.append((value or "") + self.separator)
                    size += len(text[-1])
                    if size >= self.frame:
                        frame()
                        text.clear()
                        size = 0
            if text:
                frame()
            if table:
                entries = b"".join(table)
                out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries
                          + struct.pack("<IBI", len(table), 0, SEEK_FOOTER))
        return Written(aside, name if table else "")

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(m.aside, f"{where.rstrip('/')}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = file_system(self.path)
        aside = f"{where.rstrip('/')}/_temporary"
        if fs.get_file_info(aside).type == pafs.FileType.Directory:
            fs.delete_dir(aside)


class ZstdFrames(DataSource):
    """``spark.read.format("zstd_frames")`` with ``path``, ``separator``, ``partitionBytes``; writing takes ``frameBytes``."""

    @classmethod
    def name(cls) -> str:
        return "zstd_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def read_frames(spark: SparkSession, path: str, record_sep: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Records of the archive (or folder of archives): ``file``, ``record_id`` (rising in a file), ``value``."""
    spark.dataSource.register(ZstdFrames)
    return (spark.read.format("zstd_frames").option("path", path).option("separator", record_sep)
            .option("partitionBytes", partition_bytes).load())


def write_frames(records: DataFrame, path: str, value_col: str = "value", frame_bytes: int = FRAME_BYTES) -> None:
    """Records (one text each, a line feed after it) as archives of many frames, one a task."""
    spark = records.sparkSession
    spark.dataSource.register(ZstdFrames)
    rows = records.selectExpr("cast(null as string) as file", "cast(null as long) as record_id", f"`{value_col}` as value")
    rows.write.format("zstd_frames").mode("append").option("path", path).option("frameBytes", frame_bytes).save()
