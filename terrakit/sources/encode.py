"""Small file writers, for round trips and test files.

Files are written by tasks: under a temporary name first, then moved in place, so a task
that runs twice leaves one complete file.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.sources.gpkg import envelope

CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _points(pts, order):
    return struct.pack(f"{order}{2 * len(pts)}d", *[v for p in pts for v in (p["e"], p["n"])])


def wkb(kind: str, parts, big: bool = False) -> bytes:
    """Plain WKB of parts {poly, ring, pts}."""
    order = ">" if big else "<"
    head = (b"\0" if big else b"\1") + struct.pack(order + "I", CODES[kind])
    if kind == "Point":
        return head + _points(parts[0]["pts"], order)
    if kind == "LineString":
        return head + struct.pack(order + "I", len(parts[0]["pts"])) + _points(parts[0]["pts"], order)
    if kind == "Polygon":
        body = b"".join(struct.pack(order + "I", len(p["pts"])) + _points(p["pts"], order) for p in parts)
        return head + struct.pack(order + "I", len(parts)) + body
    groups = {}
    for p in parts:
        groups.setdefault(p["poly"], []).append(p)
    single = kind.removeprefix("Multi")
    return head + struct.pack(order + "I", len(groups)) + b"".join(wkb(single, g, big) for g in groups.values())


def blob(kind: str, parts, big: bool = False, envelope: bool = True) -> bytes:
    """GeoPackage geometry: header, optional envelope, WKB."""
    points = [p for part in parts for p in part["pts"]]
    box = (min(p["e"] for p in points), max(p["e"] for p in points), min(p["n"] for p in points), max(p["n"] for p in points))
    order = ">" if big else "<"
    flags = (0 if big else 1) | (2 if envelope else 0)
    head = b"GP\0" + bytes([flags]) + struct.pack(order + "i", 2056)
    return head + (struct.pack(order + "4d", *box) if envelope else b"") + wkb(kind, parts, big)


def with_blobs(df: DataFrame, big: bool = False) -> DataFrame:
    """Replace kind and parts by a ``geom`` blob."""
    others = [f for f in df.schema.fields if f.name not in ("kind", "parts")]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["geom binary"])

    def run(frames):
        for frame in frames:
            out = frame[[f.name for f in others]].copy()
            out["geom"] = [blob(k, p, big) for k, p in zip(frame["kind"], frame["parts"])]
            yield out

    return df.mapInPandas(run, ddl)


def gpkg_file(path: str, table: str, rows: pd.DataFrame, attributes: list[str], kind: str = "GEOMETRY", index: bool = True) -> None:
    """One layer with an integer key, text attributes and a box index."""
    con = sqlite3.connect(path)
    con.executescript(
        "create table gpkg_contents (table_name text primary key, data_type text);"
        "create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer);")
    con.execute("insert into gpkg_contents values (?, 'features')", (table,))
    con.execute("insert into gpkg_geometry_columns values (?, 'geom', ?, 2056)", (table, kind))
    cells = "".join(f', "{a}" text' for a in attributes)
    con.execute(f'create table "{table}" (fid integer primary key, geom blob{cells})')
    slots = ", ".join("?" for _ in range(2 + len(attributes)))
    con.executemany(f'insert into "{table}" values ({slots})', [
        (int(r["id"]), bytes(r["geom"]), *(None if r[a] is None else str(r[a]) for a in attributes)) for r in rows.to_dict("records")])
    if index:
        con.execute(f'create virtual table "rtree_{table}_geom" using rtree(id, minx, maxx, miny, maxy)')
        con.executemany(f'insert into "rtree_{table}_geom" values (?, ?, ?, ?, ?)',
                        [(int(r["id"]), *envelope(bytes(r["geom"]))) for r in rows.to_dict("records")])
    con.commit()
    con.close()


def _per_partition(df: DataFrame, folder: str, suffix: str, write) -> None:
    """One file per partition; ``write(temporary path, frame)``."""
    folder = local(folder)
    os.makedirs(folder, exist_ok=True)

    def run(frames):
        from pyspark import TaskContext

        whole = pd.concat(list(frames))
        if len(whole):
            name = f"part-{TaskContext.get().partitionId():05d}{suffix}"
            temporary = os.path.join(folder, f".{uuid.uuid4().hex}{suffix}")
            for made in write(temporary, whole):
                ending = made[len(temporary.removesuffix(suffix)):]
                os.replace(made, os.path.join(folder, name.removesuffix(suffix) + ending))
        yield pd.DataFrame({"rows": [len(whole)]})

    df.mapInPandas(run, "rows long").agg(F.sum("rows")).collect()


def write_gpkg(df: DataFrame, folder: str, table: str, index: bool = True) -> None:
    """Rows (id, geom, attributes...) as one GeoPackage per partition."""
    attributes = [c for c in df.columns if c not in ("id", "geom")]

    def write(path, frame):
        gpkg_file(path, table, frame, attributes, index=index)
        return [path]

    _per_partition(df, folder, ".gpkg", write)


def shape_files(path: str, frame: pd.DataFrame, attributes: list[str]) -> list[str]:
    """Polylines or polygons with text attributes: .shp, .shx and .dbf."""
    stem = path.removesuffix(".shp")
    body, index, at = bytearray(), bytearray(), 100
    for kind, parts in zip(frame["kind"], frame["parts"]):
        runs = [[(p["e"], p["n"]) for p in part["pts"]] for part in parts]
        points = [p for run in runs for p in run]
        starts = [sum(len(r) for r in runs[:k]) for k in range(len(runs))]
        es, ns = [p[0] for p in points], [p[1] for p in points]
        record = struct.pack("<i4d2i", 5 if kind.endswith("Polygon") else 3, min(es), min(ns), max(es), max(ns), len(runs), len(points))
        record += struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        index += struct.pack(">2i", at // 2, len(record) // 2)
        body += struct.pack(">2i", len(index) // 8, len(record) // 2) + record
        at += 8 + len(record)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    width = 24
    fields = b"".join(a.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for a in attributes)
    rows = b"".join(b" " + b"".join(str(v)[:width].encode().ljust(width)[:width] for v in row) for row in frame[attributes].itertuples(index=False))
    table = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(frame), 33 + 32 * len(attributes), 1 + width * len(attributes)) + fields + b"\r" + rows
    for suffix, content in ((".shp", head + body), (".shx", head + index), (".dbf", table)):
        with open(stem + suffix, "wb") as f:
            f.write(content)
    return [stem + ".shx", stem + ".dbf", stem + ".shp"]


def write_shapes(df: DataFrame, folder: str) -> None:
    attributes = [c for c in df.columns if c not in ("kind", "parts")]
    _per_partition(df, folder, ".shp", lambda path, frame: shape_files(path, frame, attributes))


def fit_bytes(name: str, points) -> bytes:
    """A course file of points (lon, lat, ele or None)."""
    def semicircles(v):
        return int(round(v * 2**31 / 180.0))

    text = name.encode()[:15].ljust(16, b"\0")
    out = bytes([0x40, 0, 0]) + struct.pack("<HB", 31, 1) + bytes([5, 16, 7]) + b"\0" + text
    out += bytes([0x41, 0, 0]) + struct.pack("<HB", 20, 3) + bytes([0, 4, 0x85, 1, 4, 0x85, 2, 2, 0x84])
    for lon, lat, ele in points:
        height = 0xFFFF if ele is None or pd.isna(ele) else int(round((ele + 500) * 5))
        out += b"\1" + struct.pack("<iiH", semicircles(lat), semicircles(lon), height)
    return struct.pack("<BBHI4sH", 14, 0x10, 0, len(out), b".FIT", 0) + out


#: Documents whose points are Python objects at a time.
FIT_SLICE = 64


def fit_files(points: DataFrame) -> DataFrame:
    """(path, content) from (path, pts ARRAY<{lon, lat, ele}>) rows."""
    def run(frames):
        # A few documents at a time: as Python objects their points take many times their size.
        for batch in frames:
            for first in range(0, batch.num_rows, FIT_SLICE):
                part = batch.slice(first, FIT_SLICE)
                paths = part.column("path").to_pylist()
                made = [fit_bytes(p, [(x["lon"], x["lat"], x["ele"]) for x in pts.as_py()]) for p, pts in zip(paths, part.column("pts"))]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return points.select("path", "pts").mapInArrow(run, "path string, content binary")
