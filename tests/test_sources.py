"""Files written and read again."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.sources import files, layers, tables


def test_character_sets_and_digits(spark, tmp_path):
    df = spark.createDataFrame([("m€x", 1.23456), (None, None)], "a string, b double")
    tables.write_csv(df, f"{tmp_path}/t.csv", encoding="ISO 8859-15", digits=2)
    text = b"".join(p.read_bytes() for p in (tmp_path / "t.csv").glob("part*"))
    assert "m€x;1.23".encode("iso-8859-15") in text
    back = tables.read_table(spark, f"{tmp_path}/t.csv", encoding="ISO 8859-15").collect()
    assert sorted(map(tuple, back), key=str) == [("m€x", "1.23"), (None, None)]
    tables.write_csv(df, f"{tmp_path}/t.csv", encoding="ISO 8859-15", digits=2, append=True)
    assert tables.read_table(spark, f"{tmp_path}/t.csv", encoding="ISO 8859-15").count() == 4


def test_text_lists_of_many_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"batch_{i}.txt").write_text(f"n{i}\nm{i}\n")
    (tmp_path / "other.txt").write_text("no\n")
    found = tables.text_lists(spark, f"{tmp_path}/batch_*.txt").collect()
    assert sorted(r["value"] for r in found) == ["m0", "m1", "m2", "n0", "n1", "n2"] and len({r["file"] for r in found}) == 3
    tables.append_lines(spark.createDataFrame([("a",)], "x string"), "x", f"{tmp_path}/log")
    tables.append_lines(spark.createDataFrame([("b",)], "x string"), "x", f"{tmp_path}/log")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/log").collect()) == ["a", "b"]


def test_kept_table_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.kept(spark, f"{tmp_path}/kept", make).count() == 3
    assert len(made) == 1
    (tmp_path / "kept" / "_SUCCESS").unlink()
    assert tables.kept(spark, f"{tmp_path}/kept", make).count() == 3 and len(made) == 2


def test_dictionary_is_one_object(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ('q"', 3), ("a", 5), (None, 4), ("n", None)], "k string, v long").repartition(3)
    tables.write_dictionary(df, "k", "v", f"{tmp_path}/d")
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part*")))
    assert json.loads(text) == {"a": 1, "b": 2, "n": None, 'q"': 3}
    tables.write_dictionary(df.where("k = 'zz'"), "k", "v", f"{tmp_path}/e")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part*"))) == {}
    tables.write_lookup(df.where("k = 'b'"), "k", "v", f"{tmp_path}/l")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "l").glob("part*"))) == {"b": 2}


def test_sheets(spark, tmp_path):
    one = spark.createDataFrame([(1, "ä <&> b", 1.5, None), (2, None, None, True), (3, " x ", -2.0, False)], "a long, b string, c double, d boolean")
    two = spark.range(30).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(30)])
    files.write_sheets({"one": one, "zwei & drei": two}, f"{tmp_path}/t.xlsx")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/t.xlsx").collect())) == [("1", "ä <&> b", "1.5", None), ("2", None, None, "True"), ("3", " x ", "-2.0", "False")]
    back = tables.read_table(spark, f"{tmp_path}/t.xlsx", sheet="zwei & drei")
    assert back.columns == [f"c{i}" for i in range(30)] and {r["c29"] for r in back.collect()} == {str(29 * i) for i in range(30)}
    with pytest.raises(Exception, match="no sheet"):
        tables.read_table(spark, f"{tmp_path}/t.xlsx", sheet="x")
    tables.write_sheets({"one": one, "two": two}, f"{tmp_path}/folder")
    assert tables.read_table(spark, f"{tmp_path}/folder/two", sep=";").count() == 30


def test_shapes(spark, tmp_path):
    rows = [(1, "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))"), (2, "POLYGON ((5 5, 5 9, 9 9, 9 5, 5 5), (6 6, 7 6, 7 7, 6 7, 6 6))"), (3, "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((3.5 3, 3.5 4, 4 4, 3.5 3)))"), (4, None)]
    files.write_shapes(spark.createDataFrame(rows, "id long, geometry string"), "geometry", f"{tmp_path}/a.shp")
    found = tables.read_table(spark, f"{tmp_path}/a.shp").collect()
    assert sorted((int(r["id"]), r["geometry"]) for r in found) == rows


def test_shapes_lose_nothing(spark, tmp_path):
    rows = [("a" * 254, "ä" * 127, " x", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), (None, "漢字 🙂", None, None)]
    files.write_shapes(spark.createDataFrame(rows, "ten_bytes_ string, b string, c string, geometry string"), "geometry", f"{tmp_path}/a.shp")
    back = tables.read_table(spark, f"{tmp_path}/a.shp")
    assert {(r["ten_bytes_"], r["b"], r["c"]) for r in back.collect()} == {r[:3] for r in rows}
    # the outer ring is turned, as the format wants it
    assert {r["geometry"] for r in back.collect()} == {None, "POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))"}
    files.write_shapes(spark.createDataFrame([(1, "POINT (3 4)"), (2, "POINT (0.25 -7.5)")], "id int, geometry string"), "geometry", f"{tmp_path}/p.shp")
    assert {r["geometry"] for r in tables.read_table(spark, f"{tmp_path}/p.shp").collect()} == {"POINT (3 4)", "POINT (0.25 -7.5)"}
    for bad in (("x" * 255, "POINT (1 1)"), ("x", "LINESTRING (0 0, 1 1)")):
        with pytest.raises(ValueError):
            files.write_shapes(spark.createDataFrame([bad], "v string, geometry string"), "geometry", f"{tmp_path}/b.shp")
    for names in ("elevenbytes string, geometry string",):
        with pytest.raises(ValueError, match="names"):
            files.write_shapes(spark.createDataFrame([("x", None)], names), "geometry", f"{tmp_path}/b.shp")
    with pytest.raises(ValueError, match="all"):
        files.write_shapes(spark.createDataFrame([("x", "POINT (1 1)"), ("y", rows[0][3])], "v string, geometry string"), "geometry", f"{tmp_path}/b.shp")
    assert not (tmp_path / "b.shp").exists()


def test_other_kinds_are_refused(spark):
    for name in ("x.xls",):
        with pytest.raises(ValueError, match="convert"):
            tables.read_table(spark, name)


def test_geopackage(spark, tmp_path):
    rows = [(1, "ä'\"", 1.5, True, "POLYGON ((0 0, 0 2.5, 2 2, 0 0), (0.5 1, 1 1, 1 1.5, 0.5 1))"), (2, None, None, None, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((-5 5, 6 5, 6 6, -5 5)))"), (3, "x", -0.1, False, "POINT (1e-07 -3)"), (4, "y", 2.0, False, None)]
    df = spark.createDataFrame(rows, "id long, name string, v double, ok boolean, geometry string").repartition(2)
    path = f"{tmp_path}/a.gpkg"
    layers.write_geopackage(df, "geometry", path, "fields", 25833)
    layers.write_geopackage(df.where("id < 0"), "geometry", path, "no fields", 4326)
    found = layers.read_geopackage(spark, path)
    assert found.columns == ["geometry", "fid", "id", "name", "v", "ok"]
    value = lambda r: (r["id"], r["name"], r["v"], r["ok"], r["geometry"])
    assert sorted(value(r) for r in found.collect()) == [(*r[:4], r[4].replace("1e-07", "9.9999999999999995e-08") if r[4] else None) for r in rows]
    assert [r["id"] for r in layers.read_geopackage(spark, path, "fields", "v > 1 AND ok = 0").collect()] == [4]
    assert tables.read_table(spark, path, sheet="no fields").count() == 0
    info = {r["layer"]: r for r in layers.layers(spark, path).collect()}
    assert info.keys() == {"fields", "no fields"} and info["fields"]["srs"] == 25833 and info["no fields"]["x_min"] is None
    assert [info["fields"][c] for c in ("x_min", "y_min", "x_max", "y_max")] == [-5, -3, 6, 6]
    with pytest.raises(Exception, match="no layer"):
        layers.read_geopackage(spark, path, "x").collect()


def test_well_known_binary_of_all_kinds():
    point = lambda x, y: struct.pack("<BI2d", 1, 1, x, y)
    line = lambda order, kind, xy: struct.pack(f"{order}BII{len(xy)}d", order == "<", kind, len(xy) // (3 if kind > 1000 else 2), *xy)
    assert layers.text_of(line(">", 2, [0, 1, 2, 3]))[0] == "LINESTRING (0 1, 2 3)"
    assert layers.text_of(line("<", 1002, [0, 1, 9, 2, 3, 9]))[0] == "LINESTRING (0 1, 2 3)"
    assert layers.text_of(struct.pack("<BII", 1, 4, 2) + point(1, 2) + point(3, 4))[0] == "MULTIPOINT ((1 2), (3 4))"
    assert layers.text_of(struct.pack("<BII", 1, 7, 2) + point(1, 2) + line("<", 2, [0, 1, 2, 3]))[0] == "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 1, 2 3))"
    assert layers.text_of(struct.pack("<BII", 1, 6, 0))[0] == "MULTIPOLYGON EMPTY"


def test_rasters(spark, tmp_path):
    cells = {(r, c): float(r * 31 + c) for r in range(70) for c in range(90) if (r * c) % 7}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(3, 4, -1.0), (0, 0, None)], "row long, col long, value double").repartition(3)
    layers.write_tiles(layers.raster_tiles(df, 100.0, 500.0, 2.5, side=32), str(tmp_path))
    assert len(list(tmp_path.glob("*.tif"))) == 9
    found = layers.pixels(tables.read_table(spark, f"{tmp_path}/*.tif")).collect()
    place = {(round((500 - r["y"]) / 2.5 - 0.5), round((r["x"] - 100) / 2.5 - 0.5)): r["value"] for r in found}
    assert place == cells and len(found) == len(cells)
    # tiles inside a file, whole numbers, differences, another byte order
    grid = np.arange(12, dtype=">i2").reshape(3, 4) * 7
    tiles = [np.pad(grid[a : a + 2, b : b + 2], ((0, 2 - len(grid[a : a + 2])), (0, 0))) for a in (0, 2) for b in (0, 2)]
    parts = [zlib.compress(np.diff(t, axis=1, prepend=0).astype(">i2").tobytes()) for t in tiles]
    offsets = [8 + sum(map(len, parts[:i])) for i in range(4)]
    at = 8 + sum(map(len, parts))
    fields = [(256, 3, 1, 4 << 16), (257, 3, 1, 3 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (317, 3, 1, 2 << 16), (322, 3, 1, 2 << 16), (323, 3, 1, 2 << 16), (324, 4, 4, at + 2 + 12 * 10 + 4), (325, 4, 4, at + 2 + 12 * 10 + 20), (339, 3, 1, 2 << 16)]
    data = b"MM\0*" + struct.pack(">I", at) + b"".join(parts) + struct.pack(">H", 10) + b"".join(struct.pack(">HHII", *f) for f in fields) + bytes(4) + struct.pack(">4I", *offsets) + struct.pack(">4I", *map(len, parts))
    read = {(r, c + i): v for r, c, line in layers.raster_lines(data) for i, v in enumerate(line.tolist())}
    assert read == {(r, c): float(grid[r, c]) for r in range(3) for c in range(4)}


def test_objects_of_objects(spark, tmp_path):
    rows = [("b", "x", 1), ("a", 'q"', 2), ("b", "x", 3), ("b", "a", None), ("a", "z", 4), (None, "n", 5), ("c", None, 6)]
    df = spark.createDataFrame(rows, "o string, i string, v long").repartition(3)
    tables.write_nested(df, "o", "i", "v", f"{tmp_path}/n")
    text = "".join(p.read_text() for p in sorted((tmp_path / "n").glob("part*")))
    assert json.loads(text) == {"a": {'q"': 2, "z": 4}, "b": {"a": None, "x": 1}}
    back = {(r["outer"], r["inner"]): r["value"] for r in tables.nested_lookup(spark, f"{tmp_path}/n/part*").collect()}
    assert back == {("a", 'q"'): "2", ("a", "z"): "4", ("b", "a"): None, ("b", "x"): "1"}
    tables.write_nested(df.where("false"), "o", "i", "v", f"{tmp_path}/e")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part*"))) == {}
