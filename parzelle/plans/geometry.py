"""Polygons with parts, holes and slanted sides: measures, overlays, contacts, circles, pixels. The SQL takes the same
shapes as sets of rectangles, or as triangles, so it shares no geometry with the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parzelle.operators import polygons as Y, projection as P, spatial as S
from parzelle.plans.registry import Tables, query

c = F.col


def wkt(kind: str, polygons: list[list[list[tuple[float, float]]]], x: Column, y: Column) -> Column:
    """A text of a polygon with corners moved by (x, y)."""
    corner = lambda p: F.concat((x + p[0]).cast("string"), F.lit(" "), (y + p[1]).cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", *[corner(p) for p in [*r, r[0]]]), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.concat_ws(", ", *[ring(r) for r in p]), F.lit(")"))
    body = F.concat_ws(", ", *[part(p) for p in polygons])
    return F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")) if kind == "multi" else F.concat(F.lit("POLYGON "), body)


FRAME = [[[(0, 0), (0, 40), (40, 40), (40, 0)], [(10, 10), (10, 30), (30, 30), (30, 10)]], [[(50, 0), (60, 0), (60, 20), (50, 20)]]]
ANGLE = [[[(0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30)]]]
_FRAME = "(0, 0, 40, 10), (0, 30, 40, 40), (0, 10, 10, 30), (30, 10, 40, 30), (50, 0, 60, 20)"
_ANGLE = "(0, 0, 30, 10), (0, 10, 10, 30)"


def frames(t: Tables) -> DataFrame:
    """A square with a hole, and a part beside it, for each supplier; the area grows with their number."""
    k = c("s_suppkey")
    return t.supplier.select(k.alias("k"), wkt("multi", FRAME, k * 13 % 500 + F.floor(k / 100) * 600, k * 29 % 500).alias("geometry"))


def angles(t: Tables) -> DataFrame:
    """A concave shape for each part."""
    k = c("p_partkey")
    return t.part.select(k.alias("k"), wkt("one", ANGLE, k * 7 % 500 + F.floor(k / 2000) * 600, k * 11 % 500).alias("geometry"))


_RECTS = f"""fr AS (SELECT s_suppkey AS k, s_suppkey * 13 % 500 + s_suppkey // 100 * 600 + a AS x1, s_suppkey * 29 % 500 + b AS y1, s_suppkey * 13 % 500 + s_suppkey // 100 * 600 + c AS x2, s_suppkey * 29 % 500 + d AS y2 FROM supplier, (VALUES {_FRAME}) v(a, b, c, d)),
    an AS (SELECT p_partkey AS k, p_partkey * 7 % 500 + p_partkey // 2000 * 600 + a AS x1, p_partkey * 11 % 500 + b AS y1, p_partkey * 7 % 500 + p_partkey // 2000 * 600 + c AS x2, p_partkey * 11 % 500 + d AS y2 FROM part, (VALUES {_ANGLE}) v(a, b, c, d))"""
_SHARED = "SELECT l.k AS l_k, r.k AS r_k, sum((least(l.x2, r.x2) - greatest(l.x1, r.x1)) * (least(l.y2, r.y2) - greatest(l.y1, r.y1))) AS area FROM fr l JOIN an r ON least(l.x2, r.x2) > greatest(l.x1, r.x1) AND least(l.y2, r.y2) > greatest(l.y1, r.y1) GROUP BY ALL"


@query("geo_overlay", f"WITH {_RECTS} SELECT l_k, r_k, CAST(area AS DOUBLE) AS area FROM ({_SHARED})")
def geo_overlay(t: Tables) -> DataFrame:
    return Y.overlay(frames(t), angles(t), "k", "geometry", 64.0).select(c("l_key").alias("l_k"), c("r_key").alias("r_k"), F.round("area", 6).alias("area"))



@query(
    "geo_outer_overlay",
    f"""WITH {_RECTS}, cov AS (SELECT DISTINCT x, unnest(range(y1, y2)) AS y FROM (SELECT unnest(range(x1, x2)) AS x, y1, y2 FROM an)),
    un AS (SELECT k, x, unnest(range(y1, y2)) AS y FROM (SELECT k, unnest(range(x1, x2)) AS x, y1, y2 FROM fr))
    SELECT l_k, r_k, CAST(area AS DOUBLE) AS area FROM ({_SHARED}) UNION ALL SELECT k, NULL, CAST(count(*) AS DOUBLE) FROM un ANTI JOIN cov ON un.x = cov.x AND un.y = cov.y GROUP BY k""",
)
def geo_outer_overlay(t: Tables) -> DataFrame:
    found = Y.outer_overlay(frames(t), angles(t), "k", "geometry", 64.0)
    return found.select(c("l_key").alias("l_k"), c("r_key").alias("r_k"), F.round("area", 6).alias("area"))


@query("geo_in_parts", f"WITH {_RECTS} SELECT c_custkey, k FROM customer JOIN fr ON c_custkey % 560 + 0.5 BETWEEN x1 AND x2 AND c_custkey * 7 % 540 + 0.5 BETWEEN y1 AND y2")
def geo_in_parts(t: Tables) -> DataFrame:
    points = t.customer.select("c_custkey", (c("c_custkey") % 560 + 0.5).alias("x"), (c("c_custkey") * 7 % 540 + 0.5).alias("y"))
    return Y.in_polygons(points, frames(t), 64.0).select("c_custkey", c("p_k").alias("k"))


@query("geo_shape_parts", f"WITH {_RECTS}, m AS (SELECT k, sum((x2 - x1) * (y2 - y1)) AS area, sum((x2 - x1) * (y2 - y1) * (x1 + x2) / 2.0) AS mx, min(x1) AS x_min, max(x2) AS x_max FROM fr GROUP BY k) SELECT k, CAST(area AS DOUBLE) AS area, CAST(160 + 80 + 60 AS DOUBLE) AS perimeter, round(mx / area, 6) AS cx, CAST(x_min AS DOUBLE) AS x_min, CAST(x_max AS DOUBLE) AS x_max FROM m")
def geo_shape_parts(t: Tables) -> DataFrame:
    rows = frames(t).select("k", F.explode(F.array(S.edges(c("geometry")))).alias("e"))
    s = S.shape(c("e"))
    return rows.select("k", *[F.round(s[n], 6).alias(n) for n in ("area", "perimeter", "cx", "x_min", "x_max")])


_NEAR = "least(l.x2, r.x2) >= greatest(l.x1, r.x1) AND least(l.y2, r.y2) >= greatest(l.y1, r.y1)"


@query(
    "geo_polygon_touch",
    f"WITH ti AS (SELECT p_partkey AS k, p_partkey % 50 * 30 + a AS x1, p_partkey // 50 * 20 + b AS y1, p_partkey % 50 * 30 + c AS x2, p_partkey // 50 * 20 + d AS y2 FROM part, (VALUES {_ANGLE}) v(a, b, c, d)) SELECT l.k AS k, r.k AS neighbour FROM ti l JOIN ti r ON l.k <> r.k AND {_NEAR} GROUP BY ALL HAVING NOT bool_or(least(l.x2, r.x2) > greatest(l.x1, r.x1) AND least(l.y2, r.y2) > greatest(l.y1, r.y1))",
)
def geo_polygon_touch(t: Tables) -> DataFrame:
    """Concave shapes in rows that touch beside each other and overlap above each other."""
    k = c("p_partkey")
    rows = t.part.select(k.alias("k"), wkt("one", ANGLE, k % 50 * 30, F.floor(k / 50) * 20).alias("geometry"))
    return Y.touching(rows, "k", "geometry", 64.0).select(c("key").alias("k"), "neighbour")


@query("geo_polygon_join", f"WITH {_RECTS} SELECT DISTINCT l.k AS l_k, r.k AS r_k FROM fr l JOIN an r ON {_NEAR}")
def geo_polygon_join(t: Tables) -> DataFrame:
    return Y.intersecting(frames(t), angles(t), "k", "geometry", 64.0).select(c("l_key").alias("l_k"), c("r_key").alias("r_k"))


@query(
    "geo_pixels",
    f"""WITH {_RECTS}, px AS (SELECT k, i, unnest(range(CAST(ceil(y1 / 2.0 - 0.5) AS BIGINT), CAST(ceil(y2 / 2.0 - 0.5) AS BIGINT))) AS j FROM (SELECT k, y1, y2, unnest(range(CAST(ceil(x1 / 2.0 - 0.5) AS BIGINT), CAST(ceil(x2 / 2.0 - 0.5) AS BIGINT))) AS i FROM fr)),
    w AS (SELECT c_custkey, c_custkey % 560 + 0.3 AS x, c_custkey * 7 % 540 + 0.4 AS y FROM customer)
    SELECT c_custkey, k, count(*) AS pixels FROM w JOIN px ON px.i BETWEEN floor((w.x - 25) / 2) AND ceil((w.x + 25) / 2) AND pow(px.i * 2 + 1 - w.x, 2) + pow(px.j * 2 + 1 - w.y, 2) <= 625 GROUP BY ALL""",
)
def geo_pixels(t: Tables) -> DataFrame:
    """Pixels of two by two whose centres lie in a shape and within 25 of a customer."""
    at = t.customer.select("c_custkey", (c("c_custkey") % 560 + 0.3).alias("x"), (c("c_custkey") * 7 % 540 + 0.4).alias("y"))
    shapes = Y.pixel_runs(frames(t), "k", "geometry", 0.0, 0.0, 2.0)
    return Y.pixels_around(shapes, at, "k", 25.0, 0.0, 0.0, 2.0).select("c_custkey", "k", "pixels")


@query("geo_farm_circles")
def geo_farm_circles(t: Tables) -> DataFrame:
    """The circle that holds nine tenths of the shapes of each nation's suppliers; shapes at its edge count in part."""
    fields = frames(t).join(t.supplier.select(c("s_suppkey").alias("k"), "s_nationkey"), "k")
    found = Y.covering_circles(fields, "s_nationkey", "geometry", 0.9, 10.0)
    return found.select("s_nationkey", *[F.round(x, 6).alias(x) for x in ("cx", "cy", "total_area", "max_radius", "farthest", "radius")])


def _vincenty(rounds: int = 8) -> str:
    """Vincenty's inverse formula as one common table expression a round."""
    f, a = 1 / 298.257223563, 6378137.0
    steps = [f"v0 AS (SELECT o_orderkey, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, d, d AS lam FROM (SELECT o_orderkey, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS d FROM x))"]
    parts = "sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS sg, s1 * s2 + c1 * c2 * cos(lam) AS cg"
    more = f"SELECT *, CASE WHEN q > 0 THEN cg - 2 * s1 * s2 / q ELSE 0 END AS mid, atan2(sg, cg) AS arc, {f} / 16 * q * (4 + {f} * (4 - 3 * q)) AS c FROM (SELECT *, 1 - az * az AS q FROM (SELECT *, CASE WHEN sg > 0 THEN c1 * c2 * sin(lam) / sg ELSE 0 END AS az FROM (SELECT *, {parts} FROM v{{0}})))"
    for i in range(rounds):
        steps.append(f"v{i + 1} AS (SELECT o_orderkey, s1, c1, s2, c2, d, d + (1 - c) * {f} * az * (arc + c * sg * (mid + c * cg * (2 * mid * mid - 1))) AS lam FROM ({more.format(i)}))")
    b, e = a * (1 - f), (1 - (1 - f) ** 2) / (1 - f) ** 2
    big, small = "(1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))))", "(w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))))"
    off = f"{small} * sg * (mid + {small} / 4 * (cg * (2 * mid * mid - 1) - {small} / 6 * mid * (4 * sg * sg - 3) * (4 * mid * mid - 3)))"
    return ", ".join(steps) + f" SELECT o_orderkey, round({b} * {big} * (arc - {off}) / 1000, 5) AS km FROM (SELECT *, q * {e} AS w FROM ({more.format(rounds)}))"


_PLACES = "x AS (SELECT o_orderkey, 47 + (o_custkey % 800) / 100.0 lat1, 6 + (o_custkey * 7 % 900) / 100.0 lon1, 47 + (o_orderkey % 800) / 100.0 lat2, 6 + (o_orderkey * 7 % 900) / 100.0 lon2 FROM orders)"


@query("geo_geodesic", f"WITH {_PLACES}, {_vincenty()}")
def geo_geodesic(t: Tables) -> DataFrame:
    lat, lon = (lambda k: 47 + (c(k) % 800) / 100.0), (lambda k: 6 + (c(k) * 7 % 900) / 100.0)
    return t.orders.select("o_orderkey", F.round(P.geodesic(lat("o_custkey"), lon("o_custkey"), lat("o_orderkey"), lon("o_orderkey")), 5).alias("km"))


@query("geo_reproject", "SELECT c_custkey, round(9 + c_custkey * 7 % 900 / 100.0, 7) AS x, round(47 + c_custkey % 800 / 100.0, 7) AS y, 0 AS off FROM customer")
def geo_reproject(t: Tables) -> DataFrame:
    """Degrees to UTM zone 33 and by way of Gauss-Krueger zone 4 back; off: whether any step is off by a millimetre."""
    x, y = 9 + c("c_custkey") * 7 % 900 / 100.0, 47 + c("c_custkey") % 800 / 100.0
    rows = t.customer.select("c_custkey", F.explode(F.array(P.reproject(x, y, 4258, 25833))).alias("u"))
    rows = rows.select("*", F.explode(F.array(P.reproject(c("u.x"), c("u.y"), 25833, 31468))).alias("g"))
    rows = rows.select("*", F.explode(F.array(P.reproject(c("g.x"), c("g.y"), 31468, 25833))).alias("b"))
    back = P.reproject(c("b.x"), c("b.y"), 25833, 4258)
    off = (F.abs(c("u.x") - c("b.x")) > 0.05) | (F.abs(c("u.y") - c("b.y")) > 0.05)
    return rows.select("c_custkey", back.alias("p"), off.cast("int").alias("off")).select("c_custkey", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"), "off")
