"""Shapefiles as a Spark data source: ``format("shp")``.

Splits are record ranges found through the .shx index, so a large file is read in parallel
by seeking. Columns: file, record, kind, parts, the attributes as strings, and the box.
"""

from __future__ import annotations

import codecs
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrakit.sources.gpkg import expand
from terrakit.sources.wkb import geometry_array

# Shape type codes; the Z and M variants fold into the plain ones.
SHAPES = {0: None, 1: "Point", 11: "Point", 21: "Point", 3: "Line", 13: "Line", 23: "Line",
          5: "Polygon", 15: "Polygon", 25: "Polygon", 8: "MultiPoint", 18: "MultiPoint", 28: "MultiPoint"}
RECORDS_PER_SPLIT = 50_000
BATCH = 5_000
PARTS = "array<struct<poly:int,ring:int,pts:array<struct<e:double,n:double>>>>"


def shape(record: bytes):
    """(kind, parts) of one record, None for a null or unusable one."""
    code = struct.unpack_from("<i", record)[0]
    if code not in SHAPES:
        raise ValueError(f"unsupported shape type {code}")
    kind = SHAPES[code]
    if kind is None:
        return None
    if kind == "Point":
        return (kind, [(0, 0, np.frombuffer(record, "<f8", 2, 4).reshape(1, 2))]) if len(record) >= 20 else None
    if kind == "MultiPoint":
        count = min(struct.unpack_from("<i", record, 36)[0], (len(record) - 40) // 16)
        points = np.frombuffer(record, "<f8", count * 2, 40).reshape(count, 2)
        return (kind, [(k, 0, points[k : k + 1]) for k in range(count)]) if count else None
    if len(record) < 44:
        return None
    many, total = struct.unpack_from("<2i", record, 36)
    start = 44 + many * 4
    if start + total * 16 > len(record):
        return None
    points = np.frombuffer(record, "<f8", total * 2, start).reshape(total, 2)
    cuts = [*struct.unpack_from(f"<{many}i", record, 44), total]
    runs = [points[a:b] for a, b in zip(cuts, cuts[1:]) if b - a >= 2]
    if not runs:
        return None
    # Every ring is a polygon of its own; exteriors and holes are not told apart.
    name = "MultiPolygon" if kind == "Polygon" else "LineString" if len(runs) == 1 else "MultiLineString"
    return name, [(k, 0, run) for k, run in enumerate(runs)]


class Table:
    """The attribute file beside a shapefile; absent files have no fields."""

    def __init__(self, path: str):
        self.path, self.fields, self.count, self.width, self.head = path, [], 0, 0, 0
        if not os.path.exists(path):
            return
        with open(path, "rb") as f:
            head = f.read(32)
            self.count, self.head, self.width = struct.unpack_from("<IHH", head, 4)
            at = 1
            while (cell := f.read(32)) and len(cell) == 32 and cell[0] != 0x0D and f.tell() <= self.head:
                name = cell[:11].split(b"\0")[0].decode("utf-8", "replace").strip()
                self.fields.append((name, chr(cell[11]), at, cell[16]))
                at += cell[16]

    def encoding(self) -> str:
        """UTF-8 if the whole record area is, else Latin-1; read in blocks."""
        decoder = codecs.getincrementaldecoder("utf-8")()
        with open(self.path, "rb") as f:
            f.seek(self.head)
            try:
                while block := f.read(1 << 20):
                    decoder.decode(block)
                decoder.decode(b"", True)
            except UnicodeDecodeError:
                return "latin-1"
        return "utf-8"

    def rows(self, first: int, count: int):
        """Dictionaries of attribute texts; blank cells are null."""
        if not self.fields:
            return [{} for _ in range(count)]
        code = self.encoding()
        with open(self.path, "rb") as f:
            f.seek(self.head + first * self.width)
            block = f.read(count * self.width)
        out = []
        for k in range(count):
            row = block[k * self.width : (k + 1) * self.width]
            cells = {n: row[a : a + w].decode(code, "replace").strip() for n, _, a, w in self.fields}
            out.append({n: _number(v, kind) for (n, kind, _, _), v in zip(self.fields, cells.values())} if first + k < self.count else {})
        return out


def _number(text: str, kind: str):
    """N and F cells are numbers where they parse: whole ones lose their fraction sign."""
    if text == "":
        return None
    if kind in "NF":
        for cast in (int, float):
            try:
                value = cast(text)
                return str(int(value)) if value == int(value) else str(value)
            except (ValueError, OverflowError):
                continue
    return text


class Split(InputPartition):
    def __init__(self, path, first, count):
        self.path, self.first, self.count = path, first, count


def sidecar(path: str, suffix: str) -> str:
    return os.path.splitext(path)[0] + suffix


class ShapefileSource(DataSource):
    @classmethod
    def name(cls):
        return "shp"

    def _files(self):
        files = [f for f in expand(self.options.get("path", ""), ".shp") if f.lower().endswith(".shp")]
        if not files:
            raise FileNotFoundError(self.options.get("path"))
        return files

    def schema(self):
        names = {}
        for f in self._files():
            for field in Table(sidecar(f, ".dbf")).fields:
                names.setdefault(field[0], None)
        cells = "".join(f", `{n}` string" for n in names)
        return f"file string, record bigint, kind string, parts {PARTS}, min_e double, min_n double, max_e double, max_n double{cells}"

    def reader(self, schema):
        return ShapeReader(self._files(), schema, int(self.options.get("recordsPerSplit", RECORDS_PER_SPLIT)))


class ShapeReader(DataSourceReader):
    def __init__(self, files, schema, per_split):
        self.files, self.names, self.per_split = files, [f.name for f in schema.fields], per_split

    def partitions(self):
        splits = []
        for path in self.files:
            index = sidecar(path, ".shx")
            if os.path.exists(index):
                total = (os.path.getsize(index) - 100) // 8
                splits += [Split(path, k, min(self.per_split, total - k)) for k in range(0, total, self.per_split)]
            else:
                splits.append(Split(path, 0, -1))
        return splits or [Split(self.files[0], 0, 0)]

    def records(self, split):
        """Record bodies of the range; stops at a damaged record."""
        with open(split.path, "rb") as f:
            if split.count >= 0:
                with open(sidecar(split.path, ".shx"), "rb") as x:
                    x.seek(100 + split.first * 8)
                    head = x.read(8)
                f.seek(struct.unpack(">2i", head)[0] * 2 if len(head) == 8 else 0, 0)
            else:
                f.seek(100)
            done = 0
            while (split.count < 0 or done < split.count) and len(head := f.read(8)) == 8:
                size = struct.unpack(">2i", head)[1] * 2
                body = f.read(size)
                if size == 0 or len(body) < size:
                    return
                yield body
                done += 1

    def read(self, split):
        table = Table(sidecar(split.path, ".dbf"))
        stem = os.path.splitext(os.path.basename(split.path))[0]
        first, batch = split.first, []
        for body in self.records(split):
            batch.append(body)
            if len(batch) == BATCH:
                yield self._arrow(stem, first, batch, table)
                first, batch = first + len(batch), []
        if batch:
            yield self._arrow(stem, first, batch, table)

    def _arrow(self, stem, first, batch, table):
        found = [shape(b) for b in batch]
        rows = table.rows(first, len(batch))
        keep = [k for k, item in enumerate(found) if item]
        shapes = geometry_array([found[k] for k in keep], [None] * len(keep))
        boxes = []
        for k in keep:
            points = np.concatenate([p[2] for p in found[k][1]])
            boxes.append([*points.min(axis=0), *points.max(axis=0)])
        columns = {
            "file": pa.array([stem] * len(keep), pa.string()), "record": pa.array([first + k for k in keep], pa.int64()),
            "kind": shapes.field("kind"), "parts": shapes.field("parts"),
            **{n: pa.array([float(b[i]) for b in boxes], pa.float64()) for i, n in enumerate(("min_e", "min_n", "max_e", "max_n"))},
        }
        for name in self.names[8:]:
            columns[name] = pa.array([rows[k].get(name) for k in keep], pa.string())
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


def read_shapes(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("shp").load(path)
    if box:
        e0, n0, e1, n1 = (float(v) for v in box)
        df = df.filter((df.min_e <= e1) & (df.max_e >= e0) & (df.min_n <= n1) & (df.max_n >= n0))
    return df
