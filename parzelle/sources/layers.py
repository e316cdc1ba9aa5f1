"""Layers of GeoPackages (.gpkg) and rasters of GeoTIFF (.tif), read as whole files by tasks.

A file is one task's work, which streams its rows or lines of pixels; a pattern of paths reads many files side by side. A
GeoPackage is one SQLite file, so rows go to it one partition at a time. Rasters are written as tiles, each a GeoTIFF of
its own that a task makes, so a raster of any size is many tasks' work.
"""

from __future__ import annotations

import re
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parzelle.sources.files import _files

#: Rows of a batch.
ROWS = 1000
# Geometry kinds of well-known binary, bytes of a GeoPackage's envelope by its code, its application id.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
GPKG = 0x47504B47


def text_of(data: bytes, at: int = 0) -> tuple[str, int]:
    """Well-known text of well-known binary, in two dimensions, and where it ends."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (code & 0xFFFF) // 1000 % 4 - ((code & 0xFFFF) // 3000 == 1)
    at += 9 if code & 0x20000000 else 5
    kind = code & 0xFFFF
    kind %= 1000

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", data, at - 4)[0]

    def point() -> str:
        nonlocal at
        x, y = struct.unpack_from(f"{order}2d", data, at)
        at += 8 * size
        return f"{x:.17g} {y:.17g}"

    def line() -> str:
        return "(" + ", ".join(point() for _ in range(count())) + ")"

    if kind == 1:
        one = point()
        return ("POINT EMPTY" if "nan" in one else f"POINT ({one})"), at
    if kind == 2:
        body = line()
        return f"LINESTRING {body}" if body != "()" else "LINESTRING EMPTY", at
    if kind == 3:
        rings = [line() for _ in range(count())]
        return f"POLYGON ({', '.join(rings)})" if rings else "POLYGON EMPTY", at
    parts = []
    for _ in range(count()):
        part, at = text_of(data, at)
        parts.append(part if kind == 7 else part.split(" ", 1)[1])
    return (f"{KINDS[kind]} ({', '.join(parts)})" if parts else f"{KINDS[kind]} EMPTY"), at


def geometry_of(blob: bytes | None) -> str | None:
    """The text of a GeoPackage's geometry; null for an empty one."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:
        return None
    return text_of(blob, 8 + ENVELOPES[blob[3] >> 1 & 7])[0]


def _binary(text: str) -> bytes:
    """Well-known binary of a text of points or polygons."""
    numbers = lambda s: [float(x) for x in s.replace(",", " ").split()]
    if text.startswith("POINT"):
        return struct.pack("<BI2d", 1, 1, *numbers(text[text.index("(") + 1 : text.rindex(")")]))
    if not re.match(r"(MULTI)?POLYGON\s*\(", text):
        raise ValueError("geometries must be polygons or points")
    polygons = []
    for part in re.findall(r"\(\([^()]+\)(?:,\s*\([^()]+\))*\)", text):
        rings = [numbers(r) for r in re.findall(r"\(([^()]+)\)", part)]
        polygons.append(struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack(f"<I{len(r)}d", len(r) // 2, *r) for r in rings))
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons) if text.startswith("MULTI") else polygons[0]


def _opened(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


_LAYERS = "SELECT c.table_name, g.column_name, g.geometry_type_name, c.srs_id, c.min_x, c.min_y, c.max_x, c.max_y FROM gpkg_contents c LEFT JOIN gpkg_geometry_columns g ON c.table_name = g.table_name ORDER BY c.rowid"
_QUOTED = lambda name: '"' + name.replace('"', '""') + '"'


def layers(spark: SparkSession, path: str) -> DataFrame:
    """path, layer, geometry, kind, srs, x_min, y_min, x_max, y_max: the layers of GeoPackages, with the column of their geometries, their reference system and extent."""
    names = ["path", "layer", "geometry", "kind", "srs", "x_min", "y_min", "x_max", "y_max"]
    types = [pa.string()] * 4 + [pa.int64()] + [pa.float64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                con = _opened(data)
                rows = [[at, *r] for r in con.execute(_LAYERS)]
                con.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, layer string, geometry string, kind string, srs long, x_min double, y_min double, x_max double, y_max double")


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, where: str | None = None) -> DataFrame:
    """geometry (text), then the columns of a layer (the first without a name); where: a condition on them in SQLite's SQL, by which the files are filtered as they are read. All files must have the first one's columns."""
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                con = _opened(data)
                found = {r[0]: r[1] for r in con.execute(_LAYERS)}
                name = layer or next(iter(found))
                if name not in found:
                    raise ValueError(f"no layer {name}; there are {', '.join(found)}")
                rows = [(r[1], r[2].upper(), name, found[name]) for r in con.execute(f"PRAGMA table_info({_QUOTED(name)})")]
                con.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["name", "kind", "layer", "geometry"])

    first = _files(spark, path).orderBy("path").limit(1).select("content").mapInArrow(head, "name string, kind string, layer string, geometry string").collect()
    name, geometry = first[0]["layer"], first[0]["geometry"]
    columns = [r["name"] for r in first if r["name"] != geometry]
    kind_of = lambda k: "long" if "INT" in k else "boolean" if "BOOL" in k else "double" if re.match("REAL|DOUBLE|FLOAT", k) else "binary" if k == "BLOB" else "string"
    kinds = {r["name"]: kind_of(r["kind"]) for r in first}
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    sql = f"SELECT {_QUOTED(geometry) if geometry else 'NULL'}, {', '.join(map(_QUOTED, columns))} FROM {_QUOTED(name)}" + (f" WHERE {where}" if where else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                con = _opened(data)
                cursor = con.execute(sql)
                while held := cursor.fetchmany(ROWS):
                    cols = list(zip(*held, strict=True))
                    arrays = [pa.array([geometry_of(g) for g in cols[0]], pa.string())]
                    for c, values in zip(columns, cols[1:], strict=True):
                        kind = kinds[c]
                        arrays.append(pa.array([None if v is None else bool(v) if kind == "boolean" else str(v) if kind == "string" else v for v in values], arrow[kind]))
                    yield pa.RecordBatch.from_arrays(arrays, names=["g", *(f"c{i}" for i in range(len(columns)))])
                con.close()

    schema = ", ".join(["g string", *(f"c{i} {kinds[c]}" for i, c in enumerate(columns))])
    return _files(spark, path).select("content").mapInArrow(rows, schema).toDF("geometry", *columns)


def write_geopackage(df: DataFrame, geometry: str, path: str, layer: str, srs: int = 25833) -> None:
    """A new layer of a GeoPackage at a path of the driver, which is made if it isn't there. Texts of polygons or points."""
    names = [c for c in df.columns if c != geometry]
    kinds = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "BOOLEAN", "float": "REAL", "double": "REAL", "binary": "BLOB"}
    con = sqlite3.connect(path)
    try:
        con.execute(f"PRAGMA application_id = {GPKG}")
        con.execute("PRAGMA user_version = 10300")
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        con.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        con.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
        con.execute(f"CREATE TABLE {_QUOTED(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom GEOMETRY, {', '.join(f'{_QUOTED(n)} {kinds.get(df.schema[n].dataType.simpleString(), "TEXT")}' for n in names)})")
        plain = [F.col(f"`{n}`") if df.schema[n].dataType.simpleString() in kinds else F.col(f"`{n}`").cast("string") for n in names]
        box, held = [float("inf")] * 2 + [float("-inf")] * 2, []
        insert = f"INSERT INTO {_QUOTED(layer)} (geom, {', '.join(map(_QUOTED, names))}) VALUES (?{', ?' * len(names)})"
        for row in df.select(F.col(f"`{geometry}`"), *plain).toLocalIterator():
            blob = None
            if row[0] is not None:
                blob = b"GP\0\1" + struct.pack("<i", srs) + _binary(row[0])
                xy = [float(v) for v in re.findall(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", row[0])]
                box = [min(box[0], *xy[::2]), min(box[1], *xy[1::2]), max(box[2], *xy[::2]), max(box[3], *xy[1::2])]
            held.append([blob, *row[1:]])
            if len(held) >= ROWS:
                con.executemany(insert, held)
                held = []
        con.executemany(insert, held)
        con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", [layer, layer, *([None] * 4 if box[0] > box[2] else box), srs])
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", [layer, srs])
        con.commit()
    finally:
        con.close()


# Bytes of a TIFF field's kinds and how they are read; the fields that are used.
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_PIXEL, STRIP_ROWS, SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE, SCALE, TIE, NO_DATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113


def tiff_fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    (n,) = struct.unpack_from(f"{order}H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind in FIELDS:
            size = struct.calcsize(FIELDS[kind]) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
            found[tag] = (data[place : place + count].rstrip(b"\0"),) if kind == 2 else struct.unpack_from(f"{order}{count}{FIELDS[kind]}", data, place)
    return order, found


def raster_lines(data: bytes, band: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """row, first column, values: the lines of pixels of a band, strip by strip or tile by tile, with NaN for no data."""
    order, f = tiff_fields(data)
    width, height, n = f[WIDTH][0], f[HEIGHT][0], f.get(PER_PIXEL, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[f.get(SAMPLE, (1,))[0]] }{f[BITS][0] // 8}")
    tiled = TILE_WIDTH in f
    w, h = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(STRIP_ROWS, (height,))[0]))
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_SIZES]) if tiled else (f[OFFSETS], f[SIZES])
    method, predictor = f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
    if method not in (1, 8, 32946) or predictor not in (1, 2) or f.get(284, (1,))[0] != 1:
        raise ValueError("rasters must be plain or deflated, with pixels' bands side by side")
    gone = float(f[NO_DATA][0]) if NO_DATA in f else None
    across = -(-width // w)
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[at : at + size] if method == 1 else zlib.decompress(data[at : at + size])
        top, left = i // across * h, i % across * w
        rows = h if tiled else min(h, height - top)
        cells = np.frombuffer(raw, dtype=kind, count=rows * w * n).reshape(rows, w, n)
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=kind.newbyteorder("="))
        values = cells[: height - top, : width - left, band - 1].astype(float)
        if gone is not None:
            values[values == gone] = np.nan
        for k, line in enumerate(values):
            yield top + k, left, line


def read_raster(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """path, row, first, values, x0, y0, dx, dy: lines of pixels from a column on, null where there is no data, and where the raster's upper left corner lies and how large pixels are (dy downwards)."""
    names = ["path", "row", "first", "values", "x0", "y0", "dx", "dy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, f = tiff_fields(data)
                scale, tie = f.get(SCALE, (1.0, 1.0)), f.get(TIE, (0.0,) * 6)
                place = [tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]]
                held: list[tuple] = []

                def out() -> pa.RecordBatch:
                    values = pa.array([[None if np.isnan(v) else v for v in line.tolist()] for *_, line in held], pa.list_(pa.float64()))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array([at] * len(held)), pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), values, *(pa.array([p] * len(held), pa.float64()) for p in place)], names=names)  # noqa: B023

                for line in raster_lines(data, band):
                    held.append(line)
                    if len(held) >= 64:
                        yield out()
                        held.clear()
                if held:
                    yield out()

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, row long, first long, values array<double>, x0 double, y0 double, dx double, dy double")


def pixels(raster: DataFrame) -> DataFrame:
    """path, row, col, value, x, y (the centre) of the pixels with data."""
    each = raster.select("path", "row", "first", "x0", "y0", "dx", "dy", F.posexplode("values").alias("i", "value")).where("value IS NOT NULL")
    col = F.col("first") + F.col("i")
    return each.select("path", "row", col.alias("col"), "value", (F.col("x0") + (col + 0.5) * F.col("dx")).alias("x"), (F.col("y0") - (F.col("row") + 0.5) * F.col("dy")).alias("y"))


def tiff(values: np.ndarray, x0: float, y0: float, size: float, gone: float) -> bytes:
    """A deflated GeoTIFF of one band of 64-bit floats."""
    body = zlib.compress(np.ascontiguousarray(values, dtype="<f8").tobytes())
    height, width = values.shape
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (262, 3, [1]), (OFFSETS, 4, [8]), (PER_PIXEL, 3, [1]), (STRIP_ROWS, 4, [height]), (SIZES, 4, [len(body)]), (SAMPLE, 3, [3]), (SCALE, 12, [size, size, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (NO_DATA, 2, f"{gone!r}\0".encode())]
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    extra_at, head, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values_ in fields:
        raw = values_ if kind == 2 else struct.pack(f"<{len(values_)}{FIELDS[kind]}", *values_)
        head += struct.pack("<HHI", tag, kind, len(values_)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra)))
        extra += (raw + b"\0" * (len(raw) % 2)) if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + head + bytes(4) + extra


def raster_tiles(cells: DataFrame, x0: float, y0: float, size: float, side: int = 512, gone: float = -9999.0) -> DataFrame:
    """tile_row, tile_col, tif: pixels (row, col, value) as GeoTIFF files of side x side pixels, from the upper left corner x0, y0. Of several values of a pixel the largest counts; pixels without any have no data."""
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = int(pdf["tile_row"].iat[0]), int(pdf["tile_col"].iat[0])
        values = np.full((side, side), gone)
        values[pdf["row"].to_numpy() - r * side, pdf["col"].to_numpy() - c * side] = pdf["value"].to_numpy()
        return pd.DataFrame({"tile_row": [r], "tile_col": [c], "tif": [tiff(values, x0 + c * side * size, y0 - r * side * size, size, gone)]})

    each = cells.where("value IS NOT NULL").groupBy("row", "col").agg(F.max(F.col("value").cast("double")).alias("value"))
    dealt = each.withColumns({"tile_row": F.floor(F.col("row") / side).cast("long"), "tile_col": F.floor(F.col("col") / side).cast("long")})
    return dealt.groupBy("tile_row", "tile_col").applyInPandas(tile, "tile_row long, tile_col long, tif binary")


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """Each tile as a file row_col.tif in a folder of the driver; one at a time passes it."""
    for r in tiles.toLocalIterator():
        with open(f"{folder}/{r['tile_row']}_{r['tile_col']}.tif", "wb") as out:
            out.write(r["tif"])
