"""Polygons of any form with each other, with points, circles and pixels: parts, holes, concave and slanted outlines.

Polygons come as text. What is compared meets in the cells of a grid, by an equi-join: polygons are cut by half-planes
into one piece for each cell that they touch, so a task works on small outlines however large a polygon is, and a
polygon's rows spread over its cells. The measures of pieces are sums, which are added by key afterwards.

Two pieces are measured by vertical slabs between all corners and crossings of their edges: within a slab no edges
cross, so what both cover there is a trapezoid for each stretch of the slab's middle line that lies in both. Edges carry
their direction (inside to the left), so the winding along that line counts how often it is covered; that holds for holes,
outlines that share edges, and the edges along a cell's border that cutting leaves.

A null text, an empty geometry, or one that is no polygon, meets nothing. Cells are numbered by long integers; their
side `size` should be near that of a typical polygon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.spatial import forms, of_all, rings, shape

#: Areas under this share of a cell are noise of the arithmetic.
NOISE = 1e-12


def flat(wkt: Column) -> Column:
    """The rings of a polygon, each as x, y, x, y, ... of its corners."""
    return F.transform(rings(wkt), lambda r: F.flatten(F.transform(r, lambda e: F.array(e["x1"], e["y1"]))))


def clipped(ring: np.ndarray, axis: int, bound: float, side: int) -> np.ndarray:
    """The part of a ring (corners) at one side of a bound: side 1 keeps what is larger."""
    d = side * (ring[:, axis] - bound)
    kept = d >= 0
    if kept.all():
        return ring
    if not kept.any():
        return ring[:0]
    crosses = kept != np.roll(kept, -1)
    then = np.roll(ring, -1, axis=0)
    share = np.divide(d, d - np.roll(d, -1), out=np.zeros_like(d), where=crosses)
    both = np.stack([ring, ring + share[:, None] * (then - ring)], axis=1)
    both[:, 1, axis] = bound
    return both[np.column_stack([kept, crosses])]


def strips(parts: list[np.ndarray], axis: int, size: float) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rings cut into strips of cells along an axis; from strip to strip only what lies beyond is cut on."""
    low = min(r[:, axis].min() for r in parts)
    high = max(r[:, axis].max() for r in parts)
    i, last = int(np.floor(low / size)), int(np.floor(high / size))
    while i < last:
        bound = (i + 1) * size
        here = [x for x in (clipped(r, axis, bound, -1) for r in parts) if len(x) > 2]
        parts = [x for x in (clipped(r, axis, bound, 1) for r in parts) if len(x) > 2]
        if here:
            yield i, here
        if not parts:
            return
        i = max(i + 1, int(np.floor(min(r[:, axis].min() for r in parts) / size)))
    yield i, parts


def edges_of(parts: list[np.ndarray]) -> np.ndarray:
    found = np.concatenate([np.column_stack([r, np.roll(r, -1, axis=0)]) for r in parts])
    return found[(found[:, :2] != found[:, 2:]).any(axis=1)]


def area_of(e: np.ndarray) -> float:
    x, y = e[0, 0], e[0, 1]
    return float(((e[:, 0] - x) * (e[:, 3] - y) - (e[:, 2] - x) * (e[:, 1] - y)).sum() / 2)


@lru_cache(maxsize=4096)
def _pairs_of(n: int, m: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs among n edges; with m, of those between the first n and the m that follow."""
    return np.triu_indices(n, 1) if m is None else (np.repeat(np.arange(n), m), n + np.tile(np.arange(m), n))


def common_area(a: np.ndarray, b: np.ndarray, several: bool = False) -> float:
    """The area in both of two sets of directed edges. several: the second holds polygons that may overlap each other; what they cover several times counts once."""
    low = max(a[:, [0, 2]].min(), b[:, [0, 2]].min())
    high = min(a[:, [0, 2]].max(), b[:, [0, 2]].max())
    if low >= high:
        return 0.0
    e = np.concatenate([a, b])
    of_a = np.arange(len(e)) < len(a)
    use = e[:, 0] != e[:, 2]
    e, of_a = e[use], of_a[use]
    sign = np.where(e[:, 0] < e[:, 2], 1, -1)
    e = np.where((sign > 0)[:, None], e, e[:, [2, 3, 0, 1]])
    x1, y1, x2, y2 = e.T
    slope = (y2 - y1) / (x2 - x1)
    at = y1 - slope * (x1 - low)  # height at `low`
    i, j = _pairs_of(len(e), None) if several else _pairs_of(int(of_a.sum()), int((~of_a).sum()))
    apart = slope[i] - slope[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = low + (at[j] - at[i]) / apart
    real = (apart != 0) & (x > np.maximum(x1[i], x1[j])) & (x < np.minimum(x2[i], x2[j]))
    xs = np.unique(np.clip(np.concatenate([x1, x2, x[real]]), low, high))
    total = 0.0
    for start in range(0, len(xs) - 1, 256):  # so many slabs at once
        left, right = xs[:-1][start : start + 256], xs[1:][start : start + 256]
        middle = (left + right) / 2
        active = (x1 <= middle[:, None]) & (x2 >= middle[:, None])
        y = np.where(active, y1 + slope * (middle[:, None] - x1), np.inf)
        order = np.argsort(y, axis=1, kind="stable")
        y = np.take_along_axis(y, order, axis=1)
        turn = np.where(np.take_along_axis(active, order, axis=1), sign[order], 0)
        in_a = np.cumsum(np.where(of_a[order], turn, 0), axis=1) > 0
        in_b = np.cumsum(np.where(of_a[order], 0, turn), axis=1) > 0
        both = (in_a & in_b)[:, :-1] & np.isfinite(y[:, 1:])
        heights = np.where(both, np.subtract(y[:, 1:], y[:, :-1], where=both, out=np.zeros_like(y[:, 1:])), 0.0)
        total += float(((right - left) * heights.sum(axis=1)).sum())
    return total


def mapped(df: DataFrame, f: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """f's rows for each row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                for out in f(row):
                    held.append(out)
                    if len(held) >= 2000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return df.mapInPandas(run, schema)


def _ringed(df: DataFrame, key: str, wkt: str) -> DataFrame:
    """key, rings of the polygons. Texts are dealt to as many tasks as a shuffle has: reading and cutting one may be long work, and small files are one task. The rings come by way of a generator, behind which they are read from the text once."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{wkt}`").alias("wkt")).where("wkt IS NOT NULL").repartition(tasks)
    return rows.select("key", F.explode(F.array(flat(F.col("wkt")))).alias("rings")).where("rings IS NOT NULL")


def pieces(df: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """key, cx, cy, edges (x1, y1, x2, y2, ...), area, and the bounds x1, y1, x2, y2 of each polygon's piece in each cell that it touches."""
    def cut(row) -> Iterator[tuple]:
        parts = [r for r in (np.asarray(x, dtype=float).reshape(-1, 2) for x in row.rings) if len(r) > 2]
        if not parts:
            return
        for cx, column in strips(parts, 0, size):
            for cy, cell in strips(column, 1, size):
                e = edges_of(cell)
                if len(e):
                    yield row.key, cx, cy, e.ravel().tolist(), area_of(e), e[:, 0].min(), e[:, 1].min(), e[:, 0].max(), e[:, 1].max()

    kind = df.schema[key].dataType.simpleString()
    return mapped(_ringed(df, key, wkt), cut, f"key {kind}, cx long, cy long, edges array<double>, area double, x1 double, y1 double, x2 double, y2 double")


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled whatever Spark takes the sides' sizes for: pieces, edges and runs are many times
    the table that they come from, by whose size Spark would send them through the driver to all."""
    return df.hint("merge")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pieces of one cell whose bounds overlap."""
    l_side = left.select("cx", "cy", *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in ("cx", "cy")])
    r_side = right.select("cx", "cy", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in ("cx", "cy")])
    over = (F.col("l_x1") < F.col("r_x2")) & (F.col("r_x1") < F.col("l_x2")) & (F.col("l_y1") < F.col("r_y2")) & (F.col("r_y1") < F.col("l_y2"))
    return unbroadcast(l_side).join(r_side, ["cx", "cy"]).where(over)


def _array(values) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(-1, 4)


def _pairs(met: DataFrame, size: float) -> DataFrame:
    """l_key, r_key, area: summed over the cells. A piece that fills its cell shares all of the other one."""
    full = size * size * (1 - NOISE)
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("l_key", "r_key"))
    filled = met.where((F.col("l_area") >= full) | (F.col("r_area") >= full)).select("l_key", "r_key", F.least("l_area", "r_area").alias("area"))
    # pairs are short rows but long work, so they are dealt to as many tasks as a shuffle has, however few bytes they are
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = met.where((F.col("l_area") < full) & (F.col("r_area") < full)).select("l_key", "r_key", "l_edges", "r_edges").repartition(tasks)
    shared = mapped(rest, lambda row: iter([(row.l_key, row.r_key, common_area(_array(row.l_edges), _array(row.r_edges)))]), f"{kinds}, area double")
    return filled.unionByName(shared).groupBy("l_key", "r_key").agg(F.sum("area").alias("area")).where(F.col("area") > NOISE * size * size)


def overlay(left: DataFrame, right: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """l_key, r_key, area: what each two polygons of two tables share, if it has an area."""
    return _pairs(_met(pieces(left, key, wkt, size), pieces(right, key, wkt, size)), size)


def outer_overlay(left: DataFrame, right: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """As overlay(), and a row without r_key for what of a left polygon no right one covers; right ones may overlap each
    other. The outlines of equal pieces of a cell count once; the others that meet one left piece in its cell are held together."""
    mine = pieces(left, key, wkt, size)
    met = _met(mine, pieces(right, key, wkt, size))

    def covered(pdf: pd.DataFrame) -> pd.DataFrame:
        others = np.concatenate([_array(e) for e in pdf["r_edges"]])
        return pd.DataFrame({"l_key": pdf["l_key"].iloc[:1], "covered": [common_area(_array(pdf["l_edges"].iloc[0]), others, several=True)]})

    kind = met.schema["l_key"].dataType.simpleString()
    distinct = met.select("l_key", "cx", "cy", "l_edges", "r_edges").dropDuplicates(["l_key", "cx", "cy", "r_edges"])
    hidden = distinct.groupBy("l_key", "cx", "cy").applyInPandas(covered, f"l_key {kind}, covered double").groupBy("l_key").agg(F.sum("covered").alias("covered"))
    whole = mine.groupBy(F.col("key").alias("l_key")).agg(F.sum("area").alias("whole"))
    rest = unbroadcast(whole).join(hidden, "l_key", "left").select("l_key", F.lit(None).cast(met.schema["r_key"].dataType).alias("r_key"), (F.col("whole") - F.coalesce("covered", F.lit(0.0))).alias("area"))
    return _pairs(met, size).unionByName(rest.where(F.col("area") > 1e-9 * size * size))


def in_polygons(points: DataFrame, polygons: DataFrame, size: float, wkt: str = "geometry") -> DataFrame:
    """Points (x, y) with the polygons that they lie in, whose columns, but for the text, get the prefix p_. Points on a border belong to the polygon above or to the right. Equal points meet the polygons once."""
    names = [c for c in polygons.columns if c != wkt]
    rows = polygons.select(F.struct(*names).alias("key"), F.col(f"`{wkt}`").alias("wkt"))
    cut = pieces(rows, "key", "wkt", size).select("cx", "cy", "key", "edges", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    at = forms(points, ("x", "y")).select("x", "y").withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    x, y = F.col("x"), F.col("y")
    n = lambda i, k: F.get("edges", 4 * i + k)
    crossed = lambda i: ((n(i, 1) > y) != (n(i, 3) > y)) & (x < n(i, 0) + (y - n(i, 1)) * F.try_divide(n(i, 2) - n(i, 0), n(i, 3) - n(i, 1)))
    odd = F.size(F.filter(F.sequence(F.lit(0), (F.size("edges") / 4).cast("int") - 1), crossed)) % 2 == 1
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = unbroadcast(at).join(cut, ["cx", "cy"]).where(x.between(F.col("_x1"), F.col("_x2")) & y.between(F.col("_y1"), F.col("_y2")))
    # the test of a pair is long work, so pairs are dealt to as many tasks as a shuffle has
    met = near.repartition(tasks).where(odd).select("x", "y", *[F.col(f"key.`{c}`").alias(f"p_{c}") for c in names])
    found = of_all(met, points, None, ("x", "y"))
    return found.select(*points.columns, *[f"p_{c}" for c in names])


def contacts(polygons: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """key, neighbour: polygons whose outlines have a point in common. Edges meet in the cells that their bounds touch."""
    e = polygons.select(F.col(f"`{key}`").alias("k"), F.explode(F.flatten(rings(F.col(f"`{wkt}`")))).alias("e")).select("k", "e.*")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long")))
    dealt = e.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    a, b = (dealt.select("cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("k", "x1", "y1", "x2", "y2")]) for p in "ab")

    def side(p: str, q: str, i: int) -> Column:
        """Where corner i of q lies: left of the line through p, right, or on it."""
        v = lambda n: F.col(f"{p}_{n}")
        dx, dy = v("x2") - v("x1"), v("y2") - v("y1")
        ex, ey = F.col(f"{q}_x{i}") - v("x1"), F.col(f"{q}_y{i}") - v("y1")
        turn = dx * ey - dy * ex
        return F.when(F.abs(turn) <= 1e-12 * (F.abs(dx * ey) + F.abs(dy * ex)), 0).otherwise(F.signum(turn))

    reach = lambda n: (F.least(f"a_{n}1", f"a_{n}2") <= F.greatest(f"b_{n}1", f"b_{n}2")) & (F.least(f"b_{n}1", f"b_{n}2") <= F.greatest(f"a_{n}1", f"a_{n}2"))
    touch = (side("a", "b", 1) * side("a", "b", 2) <= 0) & (side("b", "a", 1) * side("b", "a", 2) <= 0)
    return unbroadcast(a).join(b, ["cx", "cy"]).where((F.col("a_k") < F.col("b_k")) & reach("x") & reach("y") & touch).select(F.col("a_k").alias("key"), F.col("b_k").alias("neighbour")).distinct()


def touching(polygons: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """key, neighbour, both ways: polygons that share a piece of border, or a corner, but no area."""
    cut = pieces(polygons, key, wkt, size)
    met = _met(cut, cut).where("l_key < r_key")
    over = _pairs(met, size).select(F.col("l_key").alias("key"), F.col("r_key").alias("neighbour"))
    near = unbroadcast(contacts(polygons, key, wkt, size)).join(over, ["key", "neighbour"], "left_anti")
    return near.unionByName(near.select(F.col("neighbour").alias("key"), F.col("key").alias("neighbour")))


def intersecting(left: DataFrame, right: DataFrame, key: str, wkt: str, size: float) -> DataFrame:
    """l_key, r_key: polygons of two tables that have a point in common."""
    side = lambda df, i: df.select(F.struct(F.lit(i).alias("side"), F.col(f"`{key}`").alias("key")).alias("key"), F.col(f"`{wkt}`").alias("wkt"))
    near = contacts(side(left, 0).unionByName(side(right, 1)), "key", "wkt", size).where("key.side = 0 AND neighbour.side = 1")
    return overlay(left, right, key, wkt, size).select("l_key", "r_key").unionByName(near.select(F.col("key.key").alias("l_key"), F.col("neighbour.key").alias("r_key"))).distinct()


def circle_areas(e: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The area that edges around the origin enclose within circles about it: for each edge a sector up to where it enters, a triangle inside, a sector after it."""
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    r2 = radius[:, None] ** 2
    square, along = (d * d).sum(axis=1), (a * d).sum(axis=1)
    inner = along**2 - square * ((a * a).sum(axis=1) - r2)
    root = np.sqrt(np.maximum(inner, 0))
    first, last = np.clip((-along - root) / square, 0, 1), np.clip((-along + root) / square, 0, 1)
    hit = (inner > 0) & (first < last)
    first, last = np.where(hit, first, 1.0), np.where(hit, last, 1.0)
    p, q = (a + t[..., None] * d for t in (first, last))
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    sector = lambda u, v: r2 / 2 * np.arctan2(cross(u, v), (u * v).sum(axis=-1))
    return (sector(a[None], p) + cross(p, q) / 2 + sector(q, e[None, :, 2:])).sum(axis=1)


def covering_circles(fields: DataFrame, key: str, wkt: str, share: float = 0.9, step: float = 100.0) -> DataFrame:
    """For each key the mean of its fields' centroids (cx, cy), total_area, and the radius, in steps, of the smallest
    circle about it that holds the share of the fields' area; a field at its edge counts for what lies within. Also
    half the longer side of all fields' bounds (max_radius) and the distance to the farthest corner (farthest).

    Each field tells what it adds at each step between its nearest and its farthest point; these are summed by key and
    step, of which there are few, so the fields of a key never meet in a task."""
    k = F.col(f"`{key}`")
    edged = fields.select(k.alias("key"), F.explode(F.array(F.flatten(rings(F.col(f"`{wkt}`"))))).alias("e")).where("e IS NOT NULL")
    s = shape(F.col("e"))
    measured = edged.select("key", F.flatten(F.transform("e", lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"]))).alias("edges"), *[s[n].alias(n) for n in ("area", "cx", "cy", "x_min", "y_min", "x_max", "y_max")])
    centres = measured.groupBy("key").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.sum("area").alias("total_area"), (F.greatest(F.max("x_max") - F.min("x_min"), F.max("y_max") - F.min("y_min")) / 2).alias("max_radius"))

    def steps(row) -> Iterator[tuple]:
        e = _array(row.edges) - np.array([row.mx, row.my] * 2)
        far = float(np.hypot(e[:, 0], e[:, 1]).max())
        d = e[:, 2:] - e[:, :2]
        t = np.clip(-(e[:, :2] * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        near = float(np.hypot(*(e[:, :2] + t[:, None] * d).T).min())
        within = bool(((e[:, 1] > 0) != (e[:, 3] > 0)).dot((e[:, 0] - e[:, 1] * np.divide(d[:, 0], d[:, 1], out=np.zeros(len(d)), where=d[:, 1] != 0)) > 0) % 2)
        low, high = 0 if within else int(near // step), max(1, int(np.ceil(far / step)))
        held = 0.0
        for start in range(low + 1, high + 1, 1000):
            at = np.arange(start, min(start + 1000, high + 1))
            for n, area in zip(at.tolist(), circle_areas(e, at * step).tolist(), strict=True):
                yield row.key, n, (row.area if n == high else area) - held, far
                held = area

    kind = fields.schema[key].dataType.simpleString()
    added = mapped(measured.select("key", "edges", "area").join(centres.select("key", "mx", "my"), "key"), steps, f"key {kind}, n long, part double, far double")
    found = added.groupBy("key", "n").agg(F.sum("part").alias("part"), F.max("far").alias("far")).join(centres, "key")
    upto = F.sum("part").over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    held = found.withColumn("held", upto / F.col("total_area"))
    out = held.groupBy("key").agg(F.first("mx").alias("cx"), F.first("my").alias("cy"), F.first("total_area").alias("total_area"), F.first("max_radius").alias("max_radius"), F.max("far").alias("farthest"), (F.min(F.when(F.col("held") >= share - 1e-9, F.col("n"))) * step).alias("radius"))
    return out.withColumnRenamed("key", key)


def pixel_runs(df: DataFrame, key: str, wkt: str, x0: float, y0: float, size: float) -> DataFrame:
    """key, row, first, last: the pixels, numbered from a corner, whose centres lie in a polygon, as runs of columns."""
    def fill(row) -> Iterator[tuple]:
        e = np.concatenate([np.zeros((0, 4)), *[edges_of([np.asarray(r, dtype=float).reshape(-1, 2)]) for r in row.rings if len(r)]])
        e = e[e[:, 1] != e[:, 3]]
        if not len(e):
            return
        low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        for i in range(int(np.ceil((low.min() - y0) / size - 0.5)), int(np.ceil((high.max() - y0) / size - 0.5))):
            y = y0 + (i + 0.5) * size
            cut = (low <= y) & (high > y)
            xs = np.sort(e[cut, 0] + (y - e[cut, 1]) * slope[cut])
            columns = np.ceil((xs - x0) / size - 0.5).astype(np.int64)
            for a, b in zip(columns[::2].tolist(), columns[1::2].tolist(), strict=False):
                if b > a:
                    yield row.key, i, a, b - 1

    kind = df.schema[key].dataType.simpleString()
    return mapped(_ringed(df, key, wkt), fill, f"key {kind}, row long, first long, last long").withColumnRenamed("key", key)


def circle_runs(df: DataFrame, key: str, radius: float, x0: float, y0: float, size: float) -> DataFrame:
    """key, row, first, last: the pixels whose centres lie within a radius of points (x, y)."""
    number = lambda v, o: (v - o) / size - 0.5
    rows = df.select(F.col(f"`{key}`").alias(key), "x", "y", F.explode(F.sequence(F.ceil(number(F.col("y") - radius, y0)).cast("long"), F.floor(number(F.col("y") + radius, y0)).cast("long"))).alias("row"))
    high = F.lit(y0) + (F.col("row") + 0.5) * size - F.col("y")
    half = F.sqrt(F.greatest(F.lit(radius) * radius - high * high, F.lit(0.0)))
    return rows.select(key, "row", F.ceil(number(F.col("x") - half, x0)).cast("long").alias("first"), F.floor(number(F.col("x") + half, x0)).cast("long").alias("last")).where("first <= last")


def pixels_within(shapes: DataFrame, windows: DataFrame, key: str, window: str, block: int = 256) -> DataFrame:
    """window, key, pixels: how many pixels of each shape lie in each window. Runs meet in blocks of columns of a row."""
    spread = lambda df, p, k: df.select(F.col(k), "row", F.col("first").alias(f"{p}1"), F.col("last").alias(f"{p}2"), F.explode(F.sequence(F.floor(F.col("first") / block).cast("long"), F.floor(F.col("last") / block).cast("long"))).alias("block"))
    met = unbroadcast(spread(shapes, "s", key)).join(spread(windows, "w", window), ["row", "block"])
    shared = F.least("s2", "w2", (F.col("block") + 1) * block - 1) - F.greatest("s1", "w1", F.col("block") * block) + 1
    return met.where(shared > 0).groupBy(window, key).agg(F.sum(shared).alias("pixels"))


def pixels_around(shapes: DataFrame, points: DataFrame, key: str, radius: float, x0: float, y0: float, size: float) -> DataFrame:
    """The points' columns, key, pixels: how many pixels of each shape (pixel_runs()) lie within a radius of points (x, y). Equal points meet the shapes once."""
    places = forms(points, ("x", "y")).select("x", "y", F.struct("x", "y").alias("_at"))
    met = pixels_within(shapes, circle_runs(places, "_at", radius, x0, y0, size), key, "_at")
    return of_all(met.select("_at.x", "_at.y", key, "pixels"), points, None, ("x", "y")).select(*points.columns, key, "pixels")
