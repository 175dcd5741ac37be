"""Shapefiles as a Spark data source: runs of records are partitions, found by the index file.

`spark.read.format("shapefile").load("folder/roads*")` reads all triples of .shp, .shx and .dbf under a pattern without
extension, as (file, record, geom, attributes as text); `df.write.format("shapefile")` writes them. Files are opened in
tasks, through the file systems that Arrow knows; the driver sees their sizes and one header.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
FIXED = ["file", "record", "geom"]
#: Fixed values of the format: file code, version, polyline, and kinds with parts (polylines, polygons; plain, z, m).
FILE_CODE, VERSION, POLYLINE, WITH_PARTS = 9994, 1000, 3, (3, 5)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def dbf_fields(head: bytes) -> tuple[int, int, int, list[tuple[str, int]]]:
    """(records, header bytes, record bytes, [(name, width)]) of a .dbf header."""
    count, size, width = struct.unpack("<IHH", head[4:12])
    fields, at = [], 32
    while at < len(head) and head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), head[at + 16]))
        at += 32
    return count, size, width, fields


def parse_record(body: bytes) -> list[list[tuple[float, float]]]:
    """The lines of a record's content; none for null and for points."""
    if len(body) < 4 or struct.unpack("<I", body[:4])[0] % 10 not in WITH_PARTS:
        return []
    parts, points = struct.unpack("<II", body[36:44])
    starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
    at = 44 + 4 * parts
    xy = struct.unpack(f"<{2 * points}d", body[at : at + 16 * points])
    return [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


@dataclass
class Records(InputPartition):
    """A run of records of one triple; `indexed` tells whether an index says where they are."""

    stem: str
    first: int
    last: int
    indexed: bool

    def __post_init__(self):
        super().__init__(self.stem)


def _triples(path: str) -> list[tuple[str, dict[str, int]]]:
    """(stem, {extension: bytes}) of the pairs under a pattern, in order."""
    fs, at = _open(path)
    folder, pattern = posixpath.split(at)
    found: dict[str, dict[str, int]] = {}
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        stem, dot, kind = info.path.rpartition(".")
        if dot and kind.lower() in ("shp", "shx", "dbf") and fnmatch.fnmatch(posixpath.basename(stem), pattern):
            found.setdefault(stem, {})[kind] = info.size
    return [(stem, kinds) for stem, kinds in sorted(found.items()) if {"shp", "dbf"} <= kinds.keys()]


class ShapeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema if f.name not in FIXED]
        self.path, self.run = options["path"], int(options.get("records", 50_000))

    def partitions(self) -> list[InputPartition]:
        out = []
        for stem, kinds in _triples(self.path):
            if "shx" in kinds:
                n = (kinds["shx"] - 100) // 8
                out += [Records(stem, k, min(k + self.run, n), True) for k in range(0, n, self.run)]
            else:
                out.append(Records(stem, 0, 1 << 62, False))
        return out or [Records("", 0, 0, False)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.stem:
            return
        fs, _ = _open(self.path)
        stem, first, last = partition.stem, partition.first, partition.last
        with fs.open_input_file(f"{stem}.dbf") as f:
            count, head, width, fields = dbf_fields(f.read_at(min(f.size(), 65_535), 0))
            rows = f.read_at(width * (min(last, count) - first), head + first * width)
        with fs.open_input_file(f"{stem}.shp") as f:
            begin, end = 100, f.size()
            if partition.indexed:
                with fs.open_input_file(f"{stem}.shx") as index:
                    places = index.read_at(8 * (last - first), 100 + 8 * first)
                words = struct.unpack(f">{len(places) // 4}i", places)
                begin, end = 2 * words[0], 2 * words[-2] + 8 + 2 * words[-1]
            at, k = begin, first
            f.seek(begin)
            source = io.BytesIO(f.read(end - begin)) if partition.indexed else f
            while at + 8 <= end and k < count:
                (size,) = struct.unpack(">4xi", source.read(8))
                body = source.read(2 * size)
                record = rows[(k - first) * width : (k - first + 1) * width]
                at, k = at + 8 + 2 * size, k + 1
                if record[:1] == b"*":
                    continue
                values, o = {}, 1
                for name, wide in fields:
                    values[name] = record[o : o + wide].decode("latin-1").strip()
                    o += wide
                for line in parse_record(body):
                    yield (stem, k - 1, line, *[values.get(name) for name in self.names])


class ShapeWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema if f.name not in FIXED]
        self.at = [f.name for f in schema]
        self.path, self.most, self.width = options["path"], int(options.get("records", 50_000)), int(options.get("width", 64))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """A triple for every `records` rows, held in memory until it is whole."""
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        lines, values, made = [], [], []

        def flush() -> None:
            if lines:
                stem = f"{folder}/part-{uuid.uuid4().hex}"
                made.append(stem)
                for kind, content in triple(lines, values, self.names, self.width).items():
                    with fs.open_output_stream(f"{stem}.{kind}") as f:
                        f.write(content)
                lines.clear()
                values.clear()

        geom = self.at.index("geom")
        for row in rows:
            lines.append([(p[0], p[1]) for p in row[geom]])
            values.append([row[self.at.index(n)] for n in self.names])
            if len(lines) >= self.most:
                flush()
        flush()
        return Written(made)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for stem in (s for m in messages if m is not None for s in m.stems):
            for kind in ("shp", "shx", "dbf"):
                fs.delete_file(f"{stem}.{kind}")


@dataclass
class Written(WriterCommitMessage):
    stems: list[str]


def triple(lines: list, values: list, names: list[str], width: int) -> dict[str, bytes]:
    """The three files of polylines and their attributes; a text longer than `width` bytes is refused."""
    shp, shx, dbf = io.BytesIO(), io.BytesIO(), io.BytesIO()
    xs, ys = [p[0] for line in lines for p in line] or [0.0], [p[1] for line in lines for p in line] or [0.0]
    whole = (min(xs), min(ys), max(xs), max(ys))
    body, index, at = io.BytesIO(), io.BytesIO(), 50
    for k, line in enumerate(lines):
        lx, ly = [p[0] for p in line] or [0.0], [p[1] for p in line] or [0.0]
        record = struct.pack("<I4dIII", POLYLINE, min(lx), min(ly), max(lx), max(ly), 1, len(line), 0) + struct.pack(f"<{2 * len(line)}d", *[c for p in line for c in p])
        body.write(struct.pack(">ii", k + 1, len(record) // 2) + record)
        index.write(struct.pack(">ii", at, len(record) // 2))
        at += 4 + len(record) // 2
    for out, content in ((shp, body), (shx, index)):
        data = content.getvalue()
        out.write(struct.pack(">i20xi", FILE_CODE, 50 + len(data) // 2) + struct.pack("<ii4d32x", VERSION, POLYLINE, *whole) + data)
    dbf.write(struct.pack("<B3xIHH20x", 3, len(lines), 33 + 32 * len(names), 1 + width * len(names)))
    for name in names:
        dbf.write(name.encode("latin-1")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14))
    dbf.write(b"\x0d")
    for row in values:
        dbf.write(b" ")
        for v in row:
            text = ("" if v is None else str(v)).encode("latin-1", "replace")
            if len(text) > width:
                raise ValueError(f"{text!r} is longer than {width} bytes")
            dbf.write(text.ljust(width))
    dbf.write(b"\x1a")
    return {"shp": shp.getvalue(), "shx": shx.getvalue(), "dbf": dbf.getvalue()}


class ShapeSource(DataSource):
    """Options: `attributes`, a comma-separated list (by default those of the first file), `records` in a partition."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        if "attributes" in self.options:
            names = [a for a in self.options["attributes"].split(",") if a]
        else:
            stem = next((s for s, _ in _triples(self.options["path"])), None)
            names = []
            if stem is not None:
                fs, _ = _open(self.options["path"])
                with fs.open_input_file(f"{stem}.dbf") as f:
                    names = [n for n, _ in dbf_fields(f.read_at(min(f.size(), 65_535), 0))[3]]
        fixed = [StructField("file", StringType()), StructField("record", IntegerType()), StructField("geom", ArrayType(POINT))]
        return StructType(fixed + [StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapeReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShapeWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapeSource)
