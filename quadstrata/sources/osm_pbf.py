"""The PBF map format as a Spark data source: one task for a run of blobs, found by a scan of their headers.

Files are opened through pyarrow's file systems, so local, HDFS and object-store addresses work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import NODE, OBJECTS, RELATION, WAY, arrow_changes


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers and values of a protobuf message; length-delimited ones as views."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        tag, at = varint(view, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(view, at)
        elif wire == 2:
            size, at = varint(view, at)
            value, at = view[at : at + size], at + size
        elif wire == 1:
            value, at = int.from_bytes(view[at : at + 8], "little"), at + 8
        elif wire == 5:
            value, at = int.from_bytes(view[at : at + 4], "little"), at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def varint(view: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = view[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def packed(view: memoryview, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(view):
        v, at = varint(view, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def running(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += d
        out.append(total)
    return out


def plain(v: int) -> int:
    """A signed 64-bit value from its unsigned varint."""
    return v - (1 << 64) if v >= 1 << 63 else v


class Block:
    """A primitive block: strings, scales and groups of objects."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[memoryview] = []
        self.grain, self.date_grain, self.lat0, self.lon0 = 100, 1000, 0, 0
        for k, v in fields(data):
            if k == 1:
                self.strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.grain = v
            elif k == 18:
                self.date_grain = v
            elif k == 19:
                self.lat0 = plain(v)
            elif k == 20:
                self.lon0 = plain(v)

    def objects(self) -> Iterator[tuple]:
        for group in self.groups:
            for k, v in fields(group):
                if k == 1:
                    yield self.node(v)
                elif k == 2:
                    yield from self.dense(v)
                elif k == 3:
                    yield self.way(v)
                elif k == 4:
                    yield self.relation(v)

    def degrees(self, v: int, zero: int) -> float:
        return (zero + self.grain * v) / 1e9

    def moment(self, v: int) -> datetime:
        return datetime.fromtimestamp(v * self.date_grain / 1000, timezone.utc)

    def info(self, v: memoryview | None) -> tuple:
        """version, ts, changeset, uid, user, visible."""
        d = dict(fields(v)) if v is not None else {}
        return d.get(1), self.moment(d[2]) if 2 in d else None, d.get(3), d.get(4), self.strings[d[5]] if 5 in d else None, bool(d[6]) if 6 in d else None

    def row(self, kind: int, id_: int, info: tuple, tags: dict, lon=None, lat=None, nodes=None, members=None) -> tuple:
        return (kind, id_, *info, tags or None, lon, lat, nodes, members)

    def tags(self, d: dict) -> dict:
        keys, values = (packed(d[k]) if k in d else [] for k in (2, 3))
        return {self.strings[a]: self.strings[b] for a, b in zip(keys, values)}

    def node(self, v: memoryview) -> tuple:
        d = dict(fields(v))
        zig = lambda x: (x >> 1) ^ -(x & 1)
        return self.row(NODE, zig(d[1]), self.info(d.get(4)), self.tags(d), self.degrees(zig(d[9]), self.lon0), self.degrees(zig(d[8]), self.lat0))

    def dense(self, v: memoryview) -> Iterator[tuple]:
        d = dict(fields(v))
        ids, lats, lons = (running(packed(d[k], True)) for k in (1, 8, 9))
        n = len(ids)
        i = dict(fields(d[5])) if 5 in d else {}
        version = packed(i[1]) if 1 in i else [None] * n
        ts, changeset, uid, user = (running(packed(i[k], True)) if k in i else [None] * n for k in (2, 3, 4, 5))
        seen = packed(i[6]) if 6 in i else [None] * n
        flat, at = packed(d[10]) if 10 in d else [0] * n, 0
        for k in range(n):
            tags = {}
            while at < len(flat) and flat[at]:
                tags[self.strings[flat[at]]] = self.strings[flat[at + 1]]
                at += 2
            at += 1
            info = (version[k], None if ts[k] is None else self.moment(ts[k]), changeset[k], uid[k], None if user[k] is None else self.strings[user[k]], None if seen[k] is None else bool(seen[k]))
            yield self.row(NODE, ids[k], info, tags, self.degrees(lons[k], self.lon0), self.degrees(lats[k], self.lat0))

    def way(self, v: memoryview) -> tuple:
        d = dict(fields(v))
        return self.row(WAY, plain(d[1]), self.info(d.get(4)), self.tags(d), nodes=running(packed(d[8], True)) if 8 in d else None)

    def relation(self, v: memoryview) -> tuple:
        d = dict(fields(v))
        roles, ids, kinds = packed(d[8]) if 8 in d else [], running(packed(d[9], True)) if 9 in d else [], packed(d[10]) if 10 in d else []
        return self.row(RELATION, plain(d[1]), self.info(d.get(4)), self.tags(d), members=[(t, i, self.strings[r]) for r, i, t in zip(roles, ids, kinds)] or None)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def open_file(path: str):
    system, place = _system(path)
    return system.open_input_file(place)


def files(path: str) -> list[str]:
    """The files of a comma-separated list of files and folders."""
    from pyarrow import fs

    out = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        system, place = _system(one)
        if system.get_file_info(place).type == fs.FileType.Directory:
            names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.is_file and i.base_name.endswith(".pbf"))
            out += [f"{one.rstrip('/')}/{n}" for n in names]
        else:
            out.append(one)
    return out


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Kind, offset and size of every blob, from the headers alone."""
    with open_file(path) as f:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            (size,) = struct.unpack(">I", f.read(4))
            head = dict(fields(f.read(size)))
            yield bytes(head[1]).decode(), at + 4 + size, head[3]
            at += 4 + size + head[3]


def inflate(blob: bytes) -> bytes:
    """A blob's content: raw, or by zlib, lzma, lz4 or zstd."""
    d = dict(fields(blob))
    if 1 in d:
        return bytes(d[1])
    if 3 in d:
        return zlib.decompress(d[3])
    if 4 in d:
        import lzma

        return lzma.decompress(d[4])
    if 6 in d:
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(bytes(d[6]), d[2], asbytes=True)
    if 7 in d:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(d[7], max_output_size=d[2])
    raise ValueError("a blob's compression isn't known")


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[Blobs]:
        made = []
        for one in files(self.path):
            spans = [(at, size) for kind, at, size in blobs(one) if kind == "OSMData"]
            made += [Blobs(one, spans[k : k + self.per_task]) for k in range(0, len(spans), self.per_task)]
        return made or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator:
        """An Arrow batch for each blob."""
        import pyarrow as pa

        if not partition.spans:
            return
        schema = pa.schema(list(arrow_changes())[1:])
        with open_file(partition.path) as f:
            for at, size in partition.spans:
                f.seek(at)
                columns = list(zip(*Block(inflate(f.read(size))).objects()))
                if columns:
                    columns[8] = [None if t is None else list(t.items()) for t in columns[8]]
                    columns[12] = [None if m is None else [{"type": a, "id": b, "role": c} for a, b, c in m] for m in columns[12]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class OsmPbf(DataSource):
    """spark.read.format("osmpbf").load(path): a file, a folder or a comma-separated list of them; option blobs_per_task."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("blobs_per_task", 64)))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osmpbf").load(path)
