"""GeoPackage files as a Spark data source.

    spark.dataSource.register(GeoPackageSource)
    spark.read.format("gpkg").option("table", "roads").load("/shared/data/*.gpkg")

``table=catalog`` lists the layers instead. A layer is split by key range; comparisons on
min_e, min_n, max_e, max_n are answered by the file's spatial index before any geometry is
read. Paths must be visible to all executors.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from terrakit.sources.wkb import BadGeometry, decode, read_blob

BOX = ("min_e", "max_e", "min_n", "max_n")
INDEX = dict(zip(BOX, ("minx", "maxx", "miny", "maxy")))
CATALOG = (
    "file string, name string, id_column string, geometry_column string, geometry_type string, "
    "srs_id bigint, has_index boolean, columns array<string>"
)
ROWS_PER_SPLIT = 200_000
BATCH = 10_000
SIGNS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def expand(path: str, suffix: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", f"*{suffix}"), recursive=True))
    return sorted(glob.glob(path))


def layer_info(con: sqlite3.Connection, name: str) -> dict:
    columns = con.execute(f"pragma table_info({quoted(name)})").fetchall()
    key = [r[1] for r in columns if r[5] and "INT" in (r[2] or "").upper()]
    shape = con.execute(
        "select column_name, geometry_type_name, srs_id from gpkg_geometry_columns where table_name = ?", (name,)
    ).fetchone() or (None, None, 0)
    index = f"rtree_{name}_{shape[0]}"
    has = con.execute("select 1 from sqlite_master where name = ?", (index,)).fetchone() is not None
    return {
        "name": name, "id_column": key[0] if key else "rowid", "geometry_column": shape[0], "geometry_type": shape[1],
        "srs_id": shape[2], "has_index": has, "columns": [r[1] for r in columns],
        "types": {r[1]: (r[2] or "").upper() for r in columns},
    }


def layers(con: sqlite3.Connection) -> list[dict]:
    names = con.execute("select table_name from gpkg_contents order by table_name").fetchall()
    return [layer_info(con, n) for (n,) in names]


def _sql_type(declared: str) -> str:
    if "INT" in declared or declared == "BOOLEAN":
        return "bigint"
    if any(k in declared for k in ("REAL", "DOUB", "FLOA", "NUMERIC")):
        return "double"
    return "string"


class Split(InputPartition):
    def __init__(self, path, low, high):
        self.path, self.low, self.high = path, low, high


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls):
        return "gpkg"

    def _files(self):
        files = expand(self.options.get("path", ""), ".gpkg")
        if not files:
            raise FileNotFoundError(self.options.get("path"))
        return files

    def schema(self):
        table = self.options.get("table", "catalog")
        if table == "catalog":
            return CATALOG
        with connect(self._files()[0]) as con:
            info = layer_info(con, table)
        keep = [n for n in info["columns"] if n not in (info["id_column"], info["geometry_column"])]
        cells = ["`__id` bigint"] + [f"`{n}` {_sql_type(info['types'][n])}" for n in keep]
        cells += [f"{b} double" for b in BOX] + ["geom binary"]
        return ", ".join(cells).replace("`__id`", "`id`" if "id" not in keep else "`__id`")

    def reader(self, schema: StructType):
        table = self.options.get("table", "catalog")
        if table == "catalog":
            return CatalogReader(self._files())
        return LayerReader(self._files(), table, schema, int(self.options.get("rowsPerSplit", ROWS_PER_SPLIT)))


class CatalogReader(DataSourceReader):
    def __init__(self, files):
        self.files = files

    def partitions(self):
        return [Split(f, 0, 0) for f in self.files]

    def read(self, split):
        with connect(split.path) as con:
            for info in layers(con):
                yield (split.path, info["name"], info["id_column"], info["geometry_column"], info["geometry_type"],
                       info["srs_id"], info["has_index"], info["columns"])


class LayerReader(DataSourceReader):
    def __init__(self, files, table, schema, rows_per_split):
        self.files, self.table, self.schema, self.rows = files, table, schema, rows_per_split
        self.box_tests = []

    def pushFilters(self, filters):
        for f in filters:
            sign = SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.box_tests.append((f.attribute[0], sign, float(f.value)))
            # The stored box is rounded outward, so the engine still tests each row.
            yield f

    def partitions(self):
        splits = []
        for path in self.files:
            with connect(path) as con:
                info = layer_info(con, self.table)
                low, high = con.execute(
                    f"select min({quoted(info['id_column'])}), max({quoted(info['id_column'])}) from {quoted(self.table)}").fetchone()
            if low is not None:
                splits += [Split(path, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]
        return splits or [Split(self.files[0], 1, 0)]

    def read(self, split):
        con = connect(split.path)
        info = layer_info(con, self.table)
        key, geom = quoted(info["id_column"]), quoted(info["geometry_column"] or "geom")
        names = [f.name for f in self.schema.fields]
        wanted = [n for n in names[1:] if n not in BOX and n != "geom"]
        cells = [f"t.{quoted(n)}" if n in info["columns"] else "null" for n in wanted]
        text = f"select t.{key}, {''.join(c + ', ' for c in cells)}"
        tests = [f"t.{key} between {split.low} and {split.high}"]
        if info["has_index"]:
            index = quoted(f"rtree_{self.table}_{info['geometry_column']}")
            text += ", ".join(f"i.{INDEX[b]}" for b in BOX) + f", t.{geom} from {quoted(self.table)} t join {index} i on t.{key} = i.id"
            # The index holds 32-bit floats, rounded outward.
            tests += [f"i.{INDEX[b]} {s} {v!r}" for b, s, v in self.box_tests]
        else:
            text += f"null, null, null, null, t.{geom} from {quoted(self.table)} t"
        cursor = con.execute(text + " where " + " and ".join(tests))
        first = 1 + len(wanted)
        while rows := cursor.fetchmany(BATCH):
            columns = [list(col) for col in zip(*rows)]
            if not info["has_index"]:
                boxes = [envelope(b) for b in columns[-1]]
                columns[first : first + 4] = [list(col) for col in zip(*boxes)]
            order = [names[0], *wanted, *BOX, "geom"]
            arrays = [_array(columns[order.index(n)], f) for n, f in zip(names, self.schema.fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        con.close()


def _array(values, field):
    kind = field.dataType.typeName()
    if kind == "long":
        return pa.array([v if isinstance(v, int) else None for v in values], pa.int64())
    if kind == "double":
        return pa.array([float(v) if isinstance(v, (int, float)) else None for v in values], pa.float64())
    if kind == "binary":
        return pa.array([v if isinstance(v, bytes) else None for v in values], pa.binary())
    # Blobs outside the geometry column are not data.
    return pa.array([None if v is None or isinstance(v, bytes) else str(v) for v in values], pa.string())


def envelope(blob) -> tuple:
    """(min_e, max_e, min_n, max_n) from the blob's header, else from its points."""
    if blob is None:
        return (None,) * 4
    if len(blob) >= 40 and blob[:2] == b"GP" and (blob[3] >> 1) & 7:
        return struct.unpack_from("<4d" if blob[3] & 1 else ">4d", blob, 8)
    try:
        found = read_blob(blob)
    except BadGeometry:
        return (None,) * 4
    if not found:
        return (None,) * 4
    es = [p[2][:, 0] for p in found[1]]
    ns = [p[2][:, 1] for p in found[1]]
    return (float(min(x.min() for x in es)), float(max(x.max() for x in es)),
            float(min(x.min() for x in ns)), float(max(x.max() for x in ns)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_layer(spark: SparkSession, path: str, table: str, box: tuple | None = None) -> DataFrame:
    """A layer with decoded geometry; with ``box`` only features whose box meets it."""
    register(spark)
    df = spark.read.format("gpkg").option("table", table).load(path)
    if box:
        e0, n0, e1, n1 = (float(v) for v in box)
        df = df.filter((df.min_e <= e1) & (df.max_e >= e0) & (df.min_n <= n1) & (df.max_n >= n0))
    return decode(df)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gpkg").load(path)
