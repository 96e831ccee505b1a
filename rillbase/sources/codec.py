"""Frames and segments: the binary form of records, for import and export, and the gzip body codec.

All numbers are big-endian. A segment is a 20-byte header (magic, format version, slot, base seq) and frames.
A frame: length of the rest, aggregate id, version, unix time, command id, number of events, flags (not in
format 1), and per event type and body. Ids and types have 2-byte lengths, bodies 4-byte lengths.
"""

from __future__ import annotations

import gzip
import io
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC = b"ESWL"
HEADER = struct.Struct(">4sIIQ")
FORMATS = (1, 2)
CODEC_RAW, CODEC_GZIP = 0, 1
MAX_BODY = 1 << 20
SEGMENT_MIN, SEGMENT_MAX = 256 << 20, 2 << 30
KEEP_RATIO = 0.9


class Corrupt(ValueError):
    """A frame that can't be what was written."""


@dataclass
class Record:
    aggregate_id: str
    version: int
    unix_time: int
    command_id: str
    events: list[tuple[str, bytes]] = field(default_factory=list)
    codec: int = CODEC_RAW


def _text(data: bytes) -> bytes:
    return struct.pack(">H", len(data)) + data


def encode(r: Record, version: int = 2) -> bytes:
    head = _text(r.aggregate_id.encode()) + struct.pack(">Iq", r.version, r.unix_time) + _text(r.command_id.encode()) + struct.pack(">H", len(r.events))
    if version >= 2:
        head += bytes([r.codec])
    body = b"".join(_text(t.encode()) + struct.pack(">I", len(b)) + b for t, b in r.events)
    return struct.pack(">I", len(head) + len(body)) + head + body


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("a field goes past its frame")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self.take(struct.calcsize(f">{kind}")))[0]


def decode(frame: bytes, version: int = 2) -> Record:
    """The record of a frame without its length; raises Corrupt where a length, codec or reserved bit is wrong."""
    r = _Reader(frame)
    aggregate = r.take(r.number("H")).decode()
    number, stamp = r.number("I"), r.number("q")
    command, n = r.take(r.number("H")).decode(), r.number("H")
    flags = r.number("B") if version >= 2 else 0
    if flags & 0xF0:
        raise Corrupt("a reserved flag is set")
    if flags not in (CODEC_RAW, CODEC_GZIP):
        raise Corrupt("unknown codec")
    events = []
    for _ in range(n):
        kind = r.take(r.number("H")).decode()
        size = r.number("I")
        if size > MAX_BODY:
            raise Corrupt("a body is too large")
        events.append((kind, r.take(size)))
    if r.at != len(frame):
        raise Corrupt("bytes are left over")
    return Record(aggregate, number, stamp, command, events, flags)


def segment(slot: int, base_seq: int, records: list[Record], version: int = 2) -> bytes:
    return HEADER.pack(MAGIC, version, slot, base_seq) + b"".join(encode(r, version) for r in records)


def read_stream(file: BinaryIO, size: int) -> tuple[int, Iterator[tuple[int, Record]]]:
    """slot, and (seq, record) up to the last whole frame of an open segment of ``size`` bytes; one frame is held at a time.

    An incomplete or broken tail ends the segment, also where the file turns out shorter than ``size``.
    """
    head = file.read(HEADER.size)
    if len(head) < HEADER.size:
        raise Corrupt("no header")
    magic, version, slot, seq = HEADER.unpack(head)
    if magic != MAGIC or version not in FORMATS:
        raise Corrupt("not a segment")

    def walk():
        at, n = HEADER.size, seq
        while len(prefix := file.read(4)) == 4:
            (length,) = struct.unpack(">I", prefix)
            at += 4 + length
            if at > size:
                return
            try:
                record = decode(file.read(length), version)
            except (Corrupt, UnicodeDecodeError):
                return
            yield n, record
            n += 1

    return slot, walk()


def read_segment(data: bytes) -> tuple[int, Iterator[tuple[int, Record]]]:
    """``read_stream`` of a segment in memory."""
    return read_stream(io.BytesIO(data), len(data))


def valid_segment_bytes(n: int) -> bool:
    return SEGMENT_MIN <= n <= SEGMENT_MAX and n & (n - 1) == 0


SEGMENT_ROWS = "slot int, seq long, aggregate_id string, version long, unix_time long, command_id string, codec tinyint, events array<struct<type:string,body:binary>>"


def _batches(rows: Iterator[tuple], names: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=names)


#: Bytes of a piece: 10,000 rows, Spark's largest batch, have at most 80 MB.
PIECE = 8 << 10


class _Pieces:
    """The pieces of segments, one after another, as files that are read forward; holds what is asked for."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        self.rows = (row for b in batches for row in zip(b["at"], b["size"], b["piece"], strict=True))
        self.next = next(self.rows, None)

    def files(self) -> Iterator[tuple[_Pieces, int]]:
        """Each segment, with its size; what is left of it is passed over before the next."""
        while self.next is not None:
            self.rest, size = memoryview(b""), self.next[1]
            self._take()
            yield self, size
            while self.next is not None and self.next[0] > 0:
                self.next = next(self.rows, None)

    def _take(self) -> None:
        self.rest, self.next = memoryview(self.next[2]), next(self.rows, None)

    def _forward(self, n: int) -> Iterator[memoryview]:
        while n > 0:
            if not self.rest:
                if self.next is None or self.next[0] == 0:
                    return
                self._take()
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part

    def read(self, n: int) -> bytes:
        return b"".join(self._forward(n))

    def seek(self, n: int, whence: int = io.SEEK_CUR) -> None:
        for _ in self._forward(n):
            pass


def pieces(files: DataFrame) -> DataFrame:
    """at, size, piece: the contents of segment files (a column ``content``) cut into pieces, each file's in order.

    A batch of whole segments that Python gets would have as many bytes as a task's partition.
    """
    cut = files.select("content", F.explode(F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(PIECE))).alias("at"))
    return cut.select("at", F.length("content").alias("size"), F.substring("content", F.col("at") + 1, F.lit(PIECE)).alias("piece"))


def read_records(files: DataFrame, from_seq: int = 1) -> DataFrame:
    """The records of segment files (a column ``content``); one frame is held at a time."""

    def read(batches):
        for file, size in _Pieces(batches).files():
            slot, rows = read_stream(file, size)
            out = ((slot, seq, r.aggregate_id, r.version, r.unix_time, r.command_id, r.codec, [{"type": t, "body": b} for t, b in r.events]) for seq, r in rows if seq >= from_seq)
            yield from _batches(out, ["slot", "seq", "aggregate_id", "version", "unix_time", "command_id", "codec", "events"])

    return pieces(files).mapInPandas(read, SEGMENT_ROWS)


def scan_segments(spark: SparkSession, path: str, from_seq: int = 1) -> DataFrame:
    """Records of all segment files under a path, a task per group of files; torn tails are left out.

    For any file system Spark reads. The JVM holds a file whole (Spark's binary files are at most 2 GiB), Python one
    frame at a time, as the ``wal`` source does.
    """
    return read_records(spark.read.format("binaryFile").load(path).select("content"), from_seq)


def header_stream(file: BinaryIO, size: int, frames: bool = False) -> tuple[int, Iterator[tuple]]:
    """slot, and (seq, aggregate id, version, unix time, command id, offset, frame bytes) of each whole frame, read forward.

    Bodies are passed over; with ``frames`` the encoded frame is the last field.
    """
    head = file.read(HEADER.size)
    if len(head) < HEADER.size:
        raise Corrupt("no header")
    magic, version, slot, seq = HEADER.unpack(head)
    if magic != MAGIC or version not in FORMATS:
        raise Corrupt("not a segment")

    def walk():
        at, n = HEADER.size, seq
        while at + 4 <= size:
            prefix = file.read(4)
            (length,) = struct.unpack(">I", prefix)
            if at + 4 + length > size:
                return
            frame = file.read(length if frames else min(length, 2 * (2 + 65535) + 14))
            r = _Reader(frame)
            try:
                head = (r.take(r.number("H")).decode(), r.number("I"), r.number("q"), r.take(r.number("H")).decode())
            except (Corrupt, UnicodeDecodeError):
                return
            file.seek(length - len(frame), io.SEEK_CUR)
            yield (n, *head, at, length + 4, prefix + frame) if frames else (n, *head, at, length + 4)
            at, n = at + 4 + length, n + 1

    return slot, walk()


def read_headers(data: bytes) -> tuple[int, Iterator[tuple]]:
    """``header_stream`` of a segment in memory."""
    return header_stream(io.BytesIO(data), len(data))


HEADER_ROWS = "slot int, seq long, aggregate_id string, version long, unix_time long, command_id string, offset long, bytes long"


def scan_headers(files: DataFrame) -> DataFrame:
    """The heads of all frames of segment files (a column ``content``): what an index or a range read is made of."""

    def read(batches):
        for file, size in _Pieces(batches).files():
            slot, rows = header_stream(file, size)
            yield from _batches(((slot, *r) for r in rows), ["slot", "seq", "aggregate_id", "version", "unix_time", "command_id", "offset", "bytes"])

    return pieces(files).mapInPandas(read, HEADER_ROWS)


def scan_frames(files: DataFrame) -> DataFrame:
    """slot, seq, bytes and the encoded frame of every whole record."""

    def read(batches):
        for file, size in _Pieces(batches).files():
            slot, rows = header_stream(file, size, frames=True)
            yield from _batches(((slot, r[0], r[6], r[7]) for r in rows), ["slot", "seq", "bytes", "frame"])

    return pieces(files).mapInPandas(read, "slot int, seq long, bytes long, frame binary")


def to_segments(log: DataFrame) -> DataFrame:
    """slot, base_seq and content of one segment per slot's contiguous run in a task (for export)."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        records = [Record(a, int(v), int(t), c, [(e["type"], bytes(e["body"])) for e in ev], int(k)) for a, v, t, c, ev, k in zip(rows["aggregate_id"], rows["version"], rows["unix_time"], rows["command_id"], rows["events"], rows["codec"], strict=True)]
        return pd.DataFrame({"slot": [int(rows["slot"].iloc[0])], "base_seq": [int(rows["seq"].iloc[0])], "content": [segment(int(rows["slot"].iloc[0]), int(rows["seq"].iloc[0]), records)]})

    cut = log.withColumn("run", F.floor((F.col("seq") - 1) / 10_000))
    return cut.groupBy("slot", "run").applyInPandas(lambda rows: write(rows), "slot int, base_seq long, content binary")


def compress_bodies(bodies: list[bytes], floor: int) -> tuple[int, list[bytes]]:
    """(codec, bodies) of one record: gzip where their sum reaches the floor and it saves a tenth, else as they are."""
    total = sum(map(len, bodies))
    if not bodies or total < floor:
        return CODEC_RAW, bodies
    packed = [gzip.compress(b, mtime=0) for b in bodies]
    return (CODEC_GZIP, packed) if sum(map(len, packed)) < KEEP_RATIO * total else (CODEC_RAW, bodies)


def inflate(body: bytes) -> bytes:
    """A gzip body's content, at most MAX_BODY bytes; the checksum is verified."""
    if body[:2] != b"\x1f\x8b":
        raise Corrupt("not gzip")
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(body, MAX_BODY + 1)
    except zlib.error as e:
        raise Corrupt(str(e)) from e
    if len(out) > MAX_BODY:
        raise Corrupt("the body inflates past its limit")
    if not d.eof:
        raise Corrupt("the body is cut")
    return out


#: Bytes of bodies that are Python objects at a time.
HELD = 4 << 20


def _bodies(values: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of each body, nulls kept; only some megabytes are Python objects at a time, the rest stays in Arrow."""
    done, part, held = [], [], 0
    for v in values:
        part.append(f(v) if v.is_valid else None)
        made = part[-1]
        held += len(made["body"] if isinstance(made, dict) else made or b"")
        if held >= HELD:
            done, part, held = [*done, pa.array(part, kind)], [], 0
    return pa.chunked_array([*done, pa.array(part, kind)], kind).combine_chunks()


_PACKED = pa.struct([("codec", pa.int32()), ("body", pa.binary())])


def gzip_body(body: Column | str, floor: int) -> Column:
    """struct(codec, body) of a one-event record; null for none."""

    def one(v):
        kind, (out,) = compress_bodies([v.as_py()], floor)
        return {"codec": kind, "body": out}

    @F.arrow_udf("struct<codec:int,body:binary>")
    def pack(bodies: pa.Array) -> pa.Array:
        return _bodies(bodies, one, _PACKED)

    return pack(body)


def inflate_body(packed: Column | str) -> Column:
    """The body of a struct (codec, body). On ``gzip_body`` itself both run in one worker, which a struct's fields apart would not."""

    @F.arrow_udf("binary")
    def unpack(packed: pa.Array) -> pa.Array:
        def one(v):
            body = v["body"].as_py()
            return inflate(body) if v["codec"].as_py() == CODEC_GZIP else body

        return _bodies(packed, one, pa.binary())

    return unpack(packed)
