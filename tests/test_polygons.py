"""Polygons against exact or numeric areas that share nothing with the operators."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.operators import polygons as Y, spatial as S
from parzelle.sources import files, tables


def text(*parts):
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")"
    body = ["(" + ", ".join(ring(r) for r in p) + ")" for p in parts]
    return f"POLYGON {body[0]}" if len(body) == 1 else f"MULTIPOLYGON ({', '.join(body)})"


def convex(rnd, n, at, size):
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(at[0] + size * math.cos(a), at[1] + size * math.sin(a)) for a in angles]


def exact(a, b):
    """The common area of two convex polygons that run against the clock, in fractions."""
    cut = [(Fraction(x), Fraction(y)) for x, y in a]
    b = [(Fraction(x), Fraction(y)) for x, y in b]
    for (x1, y1), (x2, y2) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p, x1=x1, y1=y1, x2=x2, y2=y2: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        out = []
        for p, q in zip(cut, cut[1:] + cut[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if (side(p) >= 0) != (side(q) >= 0):
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        cut = out
        if not cut:
            return 0.0
    return float(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(cut, cut[1:] + cut[:1], strict=True)) / 2)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, geometry string")


@pytest.mark.parametrize("size", [0.7, 3.0, 100.0])
def test_overlay_of_slanted_polygons(spark, size):
    rnd = random.Random(3)
    a = [convex(rnd, rnd.randrange(3, 8), (rnd.uniform(-9, 9), rnd.uniform(-9, 9)), rnd.uniform(0.3, 4)) for _ in range(25)]
    b = [convex(rnd, rnd.randrange(3, 8), (rnd.uniform(-9, 9), rnd.uniform(-9, 9)), rnd.uniform(0.3, 4)) for _ in range(25)]
    b += a[:3]
    want = {(i, j): v for i, x in enumerate(a) for j, y in enumerate(b) if (v := exact(x, y)) > 1e-9}
    # written with the clock and against it
    left, right = frame(spark, [text([p[::-1]]) if i % 2 else text([p]) for i, p in enumerate(a)]), frame(spark, [text([p]) for p in b])
    found = {(r["l_key"], r["r_key"]): r["area"] for r in Y.overlay(left, right, "k", "geometry", size).collect()}
    assert found.keys() >= want.keys()
    assert all(found[k] == pytest.approx(want.get(k, 0), abs=1e-9) for k in found)
    rest = {r["l_key"]: r["area"] for r in Y.outer_overlay(left, right, "k", "geometry", size).where("r_key IS NULL").collect()}
    # polygons 0 to 2 are covered by their copies; others by numbers of points
    assert not {0, 1, 2} & rest.keys()
    g = np.linspace(-14, 14, 1401)
    x, y = np.meshgrid(g, g)
    inside = lambda r: np.logical_and.reduce([(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0 for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True)])
    covered = np.logical_or.reduce([inside(r) for r in b])
    for i, p in enumerate(a):
        assert rest.get(i, 0) == pytest.approx((inside(p) & ~covered).sum() * 0.02**2, abs=0.15)


RING = [[(0, 0), (0, 4), (4, 4), (4, 0)], [(1, 1), (3, 1), (3, 3), (1, 3)]]
SHAPES = {
    "ring": text(RING),
    "ring turned": text([RING[0][::-1], RING[1][::-1]]),
    "two parts": text([[(5, 0), (6, 0), (6, 1), (5, 1)]], RING[:1]),
    "collection": "GEOMETRYCOLLECTION (POINT (1 1), POLYGON ((0 0, 2 0, 0 2, 0 0)))",
    "spaces": "POLYGON  ((0 0,2 0,2 2,0 2,0 0))",
    "empty": "POLYGON EMPTY",
    "point": "POINT (1 2)",
    "null": None,
    "flat": "POLYGON ((0 0, 5 5, 0 0))",
}


def test_measures_of_parts_and_holes(spark):
    rows = spark.createDataFrame([(k, v) for k, v in SHAPES.items()], "k string, geometry string").withColumn("e", S.edges(F.col("geometry")))
    s = S.shape(F.col("e"))
    found = {r["k"]: r for r in rows.select("k", "e", s["area"].alias("area"), s["perimeter"].alias("perimeter"), s["cx"].alias("cx"), S.inside(F.lit(2.0), F.lit(2.0), F.col("e")).alias("middle")).collect()}
    assert [found[k]["area"] for k in SHAPES] == [12, 12, 17, 2, 4, None, None, None, 0]
    assert found["ring"]["perimeter"] == 24 and found["ring"]["cx"] == 2
    assert [found[k]["middle"] for k in ("ring", "ring turned", "two parts", "null")] == [False, False, True, None]


def test_points_pieces_and_joins_of_odd_shapes(spark):
    shapes = spark.createDataFrame([(k, v) for k, v in SHAPES.items()], "k string, geometry string")
    points = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (3.5, 2.0), (9.0, 9.0), (None, 1.0)], "x double, y double")
    for size in (0.9, 2.0, 50.0):
        met = {(r["x"], r["p_k"]) for r in Y.in_polygons(points, shapes, size).collect()}
        assert met == {(0.5, "ring"), (0.5, "ring turned"), (0.5, "two parts"), (0.5, "collection"), (0.5, "spaces"), (2.0, "two parts"), (3.5, "ring"), (3.5, "ring turned"), (3.5, "two parts")}
        area = {r["key"]: r["a"] for r in Y.pieces(shapes, "k", "geometry", size).groupBy("key").agg(F.sum("area").alias("a")).collect()}
        assert area == pytest.approx({"ring": 12, "ring turned": 12, "two parts": 17, "collection": 2, "spaces": 4, "flat": 0} if "flat" in area else {"ring": 12, "ring turned": 12, "two parts": 17, "collection": 2, "spaces": 4})
    none = shapes.where("false")
    assert Y.overlay(shapes, none, "k", "geometry", 1.0).count() == 0
    assert {r["l_key"] for r in Y.outer_overlay(shapes, none, "k", "geometry", 1.0).collect()} == {"ring", "ring turned", "two parts", "collection", "spaces"}


def test_touching_triangles_share_a_corner(spark):
    rnd = random.Random(4)
    n = 6
    corner = {(i, j): (i + rnd.uniform(-0.3, 0.3), j + rnd.uniform(-0.3, 0.3)) for i in range(n) for j in range(n)}
    triangles = [t for i in range(n - 1) for j in range(n - 1) for t in (((i, j), (i + 1, j), (i, j + 1)), ((i + 1, j), (i + 1, j + 1), (i, j + 1)))]
    texts = [text([[corner[p] for p in t]]) for t in triangles]
    want = {(a, b) for a, s in enumerate(triangles) for b, t in enumerate(triangles) if a != b and set(s) & set(t)}
    for size in (0.8, 10.0):
        assert {tuple(r) for r in Y.touching(frame(spark, texts), "k", "geometry", size).collect()} == want


def test_contacts_of_all_kinds(spark):
    shapes = {0: [(0, 0), (4, 0), (4, 4), (0, 4)], 1: [(4, 1), (6, 1), (6, 3), (4, 3)], 2: [(4, 4), (5, 4), (5, 5), (4, 5)], 3: [(1, 1), (2, 1), (2, 2), (1, 2)], 4: [(0, 1), (1, 0.5), (1, 1.5)], 5: [(9, 9), (10, 9), (10, 10)], 6: [(3, 3), (8, 3), (8, 8), (3, 8)], 7: [(-3, 2), (0, 1.7), (-3, 1)]}
    rows = spark.createDataFrame([(k, text([r])) for k, r in shapes.items()], "k long, geometry string")
    found = {tuple(r) for r in Y.touching(rows, "k", "geometry", 3.0).where("key < neighbour").collect()}
    assert found == {(0, 1), (0, 2), (0, 7), (1, 6), (3, 4)}
    joined = {tuple(r) for r in Y.intersecting(rows.where("k = 0"), rows, "k", "geometry", 3.0).collect()}
    assert joined == {(0, k) for k in (0, 1, 2, 3, 4, 6, 7)}


def test_circles(spark):
    ring = np.array([[0.0, 0, 4, 0], [4, 0, 4, 4], [4, 4, 0, 4], [0, 4, 0, 0], [1, 1, 1, 3], [1, 3, 3, 3], [3, 3, 3, 1], [3, 1, 1, 1]])
    g = (np.arange(4000) + 0.5) / 1000
    x, y = np.meshgrid(g, g)
    solid = ~((x > 1) & (x < 3) & (y > 1) & (y < 3))
    for at in ((2.0, 2.0), (0.0, 0.0), (5.0, 1.0), (2.0, 0.5), (1.0, 1.0)):
        r = np.array([0.2, 0.9, 1.5, 2.5, 4.0, 9.0])
        far = np.hypot(x - at[0], y - at[1])
        want = [((far <= v) & solid).sum() / 1e6 for v in r]
        assert Y.circle_areas(ring - np.array([*at, *at]), r) == pytest.approx(want, abs=0.02)


def test_covering_circles(spark):
    """Two squares of one key: from the middle between them, which radius holds the share of both."""
    square = lambda x: text([[(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0)]])
    rows = spark.createDataFrame([("a", square(0.0)), ("a", square(10.0)), ("b", square(3.0)), ("c", None)], "farm string, geometry string")
    found = {r["farm"]: r for r in Y.covering_circles(rows, "farm", "geometry", 0.9, 0.5).collect()}
    assert found.keys() == {"a", "b"}
    g = (np.arange(1000) + 0.5) / 500
    x, y = np.meshgrid(g, g)
    for k, mx, my in (("a", 6.0, 1.0), ("b", 1.0, 1.0)):
        shares = [(np.hypot(x - mx, y - my) <= 0.5 * n).mean() for n in range(1, 30)]
        assert found[k]["radius"] == 0.5 * (1 + next(i for i, v in enumerate(shares) if v >= 0.9))
    assert (found["a"]["cx"], found["a"]["cy"], found["a"]["total_area"], found["a"]["max_radius"]) == (6, 1, 8, 6)
    assert found["a"]["farthest"] == pytest.approx(math.hypot(6, 1))


def test_pixels(spark):
    rnd = random.Random(6)
    shapes = {i: [(rnd.uniform(0, 30), rnd.uniform(0, 30)) for _ in range(3)] for i in range(12)}
    shapes[12] = None
    rows = spark.createDataFrame([(k, text([r]) if r else None) for k, r in shapes.items()], "k long, geometry string")
    runs = Y.pixel_runs(rows, "k", "geometry", -1.0, -2.0, 1.5)
    pixels = lambda df, k: {(r[k], r["row"], c) for r in df.collect() for c in range(r["first"], r["last"] + 1)}
    want = set()
    for k, r in shapes.items():
        for i in range(-3, 25) if r else ():
            for j in range(-3, 25):
                x, y = -1 + (j + 0.5) * 1.5, -2 + (i + 0.5) * 1.5
                sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0 for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True)]
                if all(sides) or not any(sides):
                    want.add((k, i, j))
    assert pixels(runs, "k") == want
    windows = spark.createDataFrame([(1, 10.0, 12.0), (2, 25.0, 3.0)], "w long, x double, y double")
    round_ = pixels(Y.circle_runs(windows, "w", 7.0, -1.0, -2.0, 1.5), "w")
    assert round_ == {(w, i, j) for w, x, y in ((1, 10, 12), (2, 25, 3)) for i in range(-20, 40) for j in range(-20, 40) if math.hypot(-1 + (j + 0.5) * 1.5 - x, -2 + (i + 0.5) * 1.5 - y) <= 7}
    got = {(r["w"], r["k"]): r["pixels"] for r in Y.pixels_within(runs, Y.circle_runs(windows, "w", 7.0, -1.0, -2.0, 1.5), "k", "w", 4).collect()}
    assert got == {(w, k): n for w in (1, 2) for k in shapes if (n := sum((w, i, j) in round_ for kk, i, j in want if kk == k))}


def test_shapes_of_a_file_join(spark, tmp_path):
    rows = spark.createDataFrame([(k, v) for k, v in SHAPES.items() if v and "(((" in v or k in ("ring", "spaces")], "k string, geometry string")
    files.write_shapes(rows, "geometry", f"{tmp_path}/a.shp")
    back = tables.read_table(spark, f"{tmp_path}/a.shp")
    points = spark.createDataFrame([(2.0, 2.0), (0.5, 0.5)], "x double, y double")
    assert {(r["x"], r["p_k"]) for r in Y.in_polygons(points, back, 3.0).collect()} == {(0.5, "ring"), (0.5, "two parts"), (2.0, "two parts"), (0.5, "spaces")}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_pieces_pass_the_driver(spark):
    k = F.col("id")
    corner = lambda a, b: F.concat((k % 10 * 10 + a).cast("string"), F.lit(" "), (F.floor(k / 10) * 10 + b).cast("string"))
    ring = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10), corner(0, 0)), F.lit("))"))
    tiles = spark.range(50).select(k.alias("k"), ring.alias("geometry"))
    points = spark.range(300).select(k.alias("n"), (k % 3 * 10 + 5.0).alias("x"), F.when(k < 299, 5.0).alias("y"))
    shapes = Y.pixel_runs(tiles, "k", "geometry", 0.0, 0.0, 2.0)
    found = {
        "overlay": Y.overlay(tiles, tiles, "k", "geometry", 16.0),
        "outer": Y.outer_overlay(tiles, tiles, "k", "geometry", 16.0),
        "touching": Y.touching(tiles, "k", "geometry", 16.0),
        "intersecting": Y.intersecting(tiles, tiles, "k", "geometry", 16.0),
        "points": Y.in_polygons(points, tiles, 16.0),
        "pixels": Y.pixels_around(shapes, points, "k", 5.0, 0.0, 0.0, 2.0),
    }
    for name, df in found.items():
        assert "Broadcast" not in plan_of(df), name
    assert found["overlay"].count() == 50
    near = {(a, b) for a in range(50) for b in range(50) if a != b and max(abs(a % 10 - b % 10), abs(a // 10 - b // 10)) == 1}
    assert {tuple(r) for r in found["touching"].collect()} == near
    rows = [(r["n"], r["p_k"]) for r in found["points"].collect()]
    assert sorted(rows) == [(n, n % 3) for n in range(299)]
    whole = {(r["n"], r["k"]): r["pixels"] for r in found["pixels"].collect()}
    assert len(whole) == 299 and {k for _, k in whole} == {0, 1, 2} and set(whole.values()) == {21}
