"""Queries for renaming, filling, ordering, maps, set operations, and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.functions import text as T
from parzelle.operators import concentration as C, polygons as Y, relational as R, reports as P, spatial as S
from parzelle.plans import concentration as K
from parzelle.plans.registry import Tables, query

c = F.col


@query("prj_rename", "SELECT n_nationkey AS id_key, n_name AS label_key, n_regionkey AS region_key FROM nation")
def prj_rename(t: Tables) -> DataFrame:
    named = t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "label", "n_regionkey": "region"}).select("id", "label", "region")
    return named.toDF(*[f"{x}_key" for x in named.columns])


@query("prj_from_other", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderstatus END AS label FROM orders")
def prj_from_other(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(c("o_orderstatus")).alias("label"))


@query("prj_transpose", " UNION ALL ".join(f"SELECT '{v}' AS variable, " + ", ".join(f"round({f} FILTER (c_mktsegment = '{s}'), 4) AS {s}" for s in K.SEGMENTS) + " FROM customer" for v, f in (("mean", "avg(c_acctbal)"), ("largest", "max(c_acctbal)"), ("smallest", "min(c_acctbal)"))))
def prj_transpose(t: Tables) -> DataFrame:
    rows = t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.max("c_acctbal"), 4).alias("largest"), F.round(F.min("c_acctbal"), 4).alias("smallest"))
    return R.transposed(rows, "c_mktsegment", K.SEGMENTS)


@query("flt_nulls", "WITH x AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders) SELECT o_orderkey, s, p FROM x WHERE s IS NOT NULL AND p IS NULL")
def flt_nulls(t: Tables) -> DataFrame:
    x = t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s"), F.nullif(c("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    return x.dropna(subset=["s"]).where(c("p").isNull())


@query("jn_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_regionkey AS r, n_name FROM nation) NATURAL LEFT JOIN (SELECT c_nationkey AS k, c_nationkey % 5 AS r, count(*) AS n FROM customer GROUP BY ALL)")
def jn_natural(t: Tables) -> DataFrame:
    left = t.nation.select(c("n_nationkey").alias("k"), c("n_regionkey").alias("r"), "n_name")
    return R.natural(left, t.customer.groupBy(c("c_nationkey").alias("k"), (c("c_nationkey") % 5).alias("r")).agg(F.count(F.lit(1)).alias("n")))


@query("jn_dictionary", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_dictionary(t: Tables) -> DataFrame:
    return R.looked_up(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation, "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("agg_first_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def agg_first_row(t: Tables) -> DataFrame:
    return R.first_row(t.orders, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("rsh_reindex", "WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1), l(ord, segment) AS (VALUES (1, 'MACHINERY'), (2, 'BUILDING'), (3, 'FURNITURE')) SELECT ord, segment, n FROM l LEFT JOIN n ON segment = c_mktsegment")
def rsh_reindex(t: Tables) -> DataFrame:
    n = t.customer.where("c_mktsegment <> 'BUILDING'").groupBy(c("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return P.reindexed(n, "segment", ["MACHINERY", "BUILDING", "FURNITURE"])


@query("srt_custom", "SELECT row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'BUILDING' THEN 3 ELSE 4 END, c_mktsegment, c_custkey) AS place, c_custkey, c_mktsegment FROM customer")
def srt_custom(t: Tables) -> DataFrame:
    return R.in_given_order(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "FURNITURE", "BUILDING"], "c_custkey")


@query("srt_by_length", "SELECT p_partkey, array_to_string([x[2] FOR x IN list_sort([[lpad(length(w)::VARCHAR, 5, '0'), w] FOR w IN string_split(p_name || ' a ' || lower(p_brand), ' ')])], ' ') AS words FROM part")
def srt_by_length(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(T.by_length(F.split(F.concat_ws(" a ", "p_name", F.lower("p_brand")), " ")), " ").alias("words"))


@query("arr_positions", "WITH x AS (SELECT p_partkey, string_split(p_name, '') AS l FROM part) SELECT p_partkey, array_to_string([i - 1 FOR i IN range(1, len(l) + 1) IF l[i] = 'e'], ',') AS places FROM x")
def arr_positions(t: Tables) -> DataFrame:
    letters = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.substr("p_name", i, F.lit(1)))
    return t.part.select("p_partkey", F.array_join(F.transform(T.positions(letters, "e"), lambda i: i.cast("string")), ",").alias("places"))


@query("arr_flatten", "SELECT o_custkey, len(flatten(list(string_split(o_orderpriority, '-')))) AS n, array_to_string(list_sort(flatten(list(string_split(o_orderpriority, '-')))), '_') AS parts FROM orders GROUP BY 1")
def arr_flatten(t: Tables) -> DataFrame:
    flat = F.flatten(F.collect_list(F.split("o_orderpriority", "-")))
    return t.orders.groupBy("o_custkey").agg(F.size(flat).cast("long").alias("n"), F.array_join(F.array_sort(flat), "_").alias("parts"))


@query("map_merge", "SELECT o_orderkey, 'a=' || o_orderstatus || ';b=' || CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END || CASE WHEN o_orderkey % 2 = 0 THEN ';c=more' ELSE '' END AS merged FROM orders")
def map_merge(t: Tables) -> DataFrame:
    a = F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), "o_orderpriority")
    b = F.when(c("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("more"))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.array_sort(F.map_entries(T.merged(a, b)))
    return t.orders.select("o_orderkey", F.array_join(F.transform(both, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("map_range", "WITH a AS (SELECT o_custkey, sum(o_totalprice) / 10000 AS ha FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN ha >= 100 THEN '100+' WHEN ha >= 50 THEN '50-100' WHEN ha >= 25 THEN '25-50' ELSE '10-25' END AS class FROM a WHERE ha >= 10")
def map_range(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg((F.sum("o_totalprice") / 10000).alias("ha")).where("ha >= 10")
    return a.select("o_custkey", F.when(c("ha") >= 100, "100+").when(c("ha") >= 50, "50-100").when(c("ha") >= 25, "25-50").otherwise("10-25").alias("class"))


@query("set_reconcile", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE lower(o_orderpriority) END AS state FROM orders")
def set_reconcile(t: Tables) -> DataFrame:
    return R.processed_half(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), c("o_orderstatus") == "F", lambda d: d.withColumn("state", F.lit("done")), lambda d: d.withColumn("state", F.lower("o_orderpriority"))).select("o_orderkey", "state")


@query("set_repeated", "WITH b AS (SELECT c_nationkey AS postcode, c_mktsegment AS name, 0 AS source, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'BUILDING', 1, s_suppkey FROM supplier) SELECT *, CAST(row_number() OVER (PARTITION BY postcode, name ORDER BY source, id) > 1 AS INT) AS repeated FROM b")
def set_repeated(t: Tables) -> DataFrame:
    both = t.customer.select(c("c_nationkey").alias("postcode"), c("c_mktsegment").alias("name"), F.lit(0).alias("source"), c("c_custkey").alias("id")).unionByName(t.supplier.select(c("s_nationkey").alias("postcode"), F.lit("BUILDING").alias("name"), F.lit(1).alias("source"), c("s_suppkey").alias("id")))
    return R.repeated(both, ["postcode", "name"], ["source", "id"])


@query(
    "win_lorenz_curve",
    f"""WITH {K.PARCELS}, a AS (SELECT unit, owner, sum(area) a FROM parcels GROUP BY ALL) SELECT unit, row_number() OVER w AS i, round(sum(a) OVER w / sum(a) OVER (PARTITION BY unit), 6) AS share, round(row_number() OVER w / count(*) OVER (PARTITION BY unit), 6) AS population FROM a WINDOW w AS (PARTITION BY unit ORDER BY a, owner DESC)
    UNION ALL SELECT DISTINCT unit, 0, 0.0, 0.0 FROM parcels""",
)
def win_lorenz_curve(t: Tables) -> DataFrame:
    found = C.lorenz(C.owner_areas(K.holdings(t), "unit", "area", "owner"), "unit", "area", "owner")
    return found.select("unit", "i", F.round("share", 6).alias("share"), F.round("population", 6).alias("population"))


@query("cat_topx_filled", f"WITH {K._OWN}, f AS (SELECT * FROM r WHERE unit % 3 <> 0) SELECT CAST(n_nationkey AS INT) AS unit, " + ", ".join(f"count(*) FILTER (klass = '{s}' AND k <= {x}) AS count_{s}_top{x}" for s in K.SEGMENTS for x in (1, 3, 5)) + " FROM nation LEFT JOIN f ON unit = n_nationkey GROUP BY 1")
def cat_topx_filled(t: Tables) -> DataFrame:
    counts = C.class_counts(K.holdings(t).where("unit % 3 <> 0"), "unit", "area", "owner", "klass", K.SEGMENTS)
    return R.every_unit(counts, "unit", t.nation.select(c("n_nationkey").alias("unit")))


@query("cat_share_filled", f"WITH {K._OWN}, f AS (SELECT * FROM r WHERE unit % 3 <> 0) SELECT CAST(n_nationkey AS INT) AS unit, " + ", ".join(f"round(coalesce(sum(CASE WHEN klass = '{s}' THEN a ELSE 0 END) / max(tot) * 100, 0), 6) AS share_{s}_sh100, count(*) FILTER (klass = '{s}') AS count_{s}_sh100" for s in K.SEGMENTS) + " FROM nation LEFT JOIN f ON unit = n_nationkey GROUP BY 1")
def cat_share_filled(t: Tables) -> DataFrame:
    shares = C.class_shares(K.holdings(t).where("unit % 3 <> 0"), "unit", "area", "owner", "klass", K.SEGMENTS, (100,))
    found = R.every_unit(shares, "unit", t.nation.select(c("n_nationkey").alias("unit")))
    return found.select(*[F.round(x, 6).alias(x) if x.startswith("share_") else x for x in found.columns])


_WEIGHTED = "r AS (SELECT c_nationkey unit, c_acctbal + 1000 x, c_custkey % 5 + 1 w FROM customer), m AS (SELECT unit, sum(x * w) / sum(w) mu, sum(w) n, sum(x * w) l FROM r GROUP BY 1)"


@query(
    "conc_weighted_lac",
    f"""WITH {_WEIGHTED}, q AS (SELECT unit, max(mu) mu, max(n) n, max(l) l, coalesce(sum(w) FILTER (x < mu), 0) m, coalesce(sum(x * w) FILTER (x < mu), 0) lm, sum(w) FILTER (x = mu) a, sum(x * w) FILTER (x = mu) la, max(x) FILTER (x < mu) xm, min(x) FILTER (x >= mu) xm1 FROM r JOIN m USING (unit) GROUP BY unit)
    SELECT unit, round(CASE WHEN a > 0 THEN (m + a / 2) / n + (lm + la / 2) / l ELSE (m + (mu - xm) / (xm1 - xm)) / n + (lm + (mu - xm) / (xm1 - xm) * xm1) / l END, 6) AS lac FROM q""",
)
def conc_weighted_lac(t: Tables) -> DataFrame:
    rows = t.customer.select(c("c_nationkey").alias("nation"), (c("c_acctbal") + 1000).alias("x"), (c("c_custkey") % 5 + 1).alias("w"), "c_custkey")
    return C.weighted(rows, "nation", "x", "w", "c_custkey").select("unit", F.round("lac", 6).alias("lac"))


@query("geo_grids", "WITH b AS (SELECT min(c_acctbal) - 1200 x0, max(c_acctbal) + 1200 x1, min(c_nationkey) - 1200.0 y0, max(c_nationkey) + 1200.0 y1 FROM customer), v(version, dx, dy) AS (VALUES (1, 0, 0), (2, 0, 400), (3, 400, 0), (4, 400, 400)) SELECT version, printf('%04d_%04d', CAST(i AS INT), CAST(j AS INT)) AS cell_id, round((x0 + dx + (i - 1) * 800)::DOUBLE, 4) AS x_min, round((y0 + dy + (j - 1) * 800)::DOUBLE, 4) AS y_min FROM b, v, range(1, CAST(greatest(ceil((x1 - x0 - dx) / 800), 1) AS INT) + 1) a(i), range(1, CAST(greatest(ceil((y1 - y0 - dy) / 800), 1) AS INT) + 1) e(j)")
def geo_grids(t: Tables) -> DataFrame:
    found = S.grids(t.customer.select("c_acctbal", c("c_nationkey").cast("double").alias("y")), "c_acctbal", "y", 800.0, 1200.0, [0, 400])
    return found.select("version", "cell_id", F.round("x_min", 4).alias("x_min"), F.round("y_min", 4).alias("y_min"))


_BOXES = "bx AS (SELECT c_custkey AS k, CAST(c_custkey % 40 * 10 AS DOUBLE) AS x1, CAST(c_custkey // 40 % 30 * 10 AS DOUBLE) AS y1, CAST(c_custkey % 40 * 10 + 10 + c_custkey % 2 * 10 AS DOUBLE) AS x2, CAST(c_custkey // 40 % 30 * 10 + 10 AS DOUBLE) AS y2 FROM customer)"


def boxes(t: Tables) -> DataFrame:
    k = c("c_custkey")
    x, y = (k % 40 * 10).cast("double"), (F.floor(k / 40) % 30 * 10).cast("double")
    return t.customer.select(k.alias("k"), x.alias("x1"), y.alias("y1"), (x + 10 + k % 2 * 10).alias("x2"), (y + 10).alias("y2"))


@query("geo_touch", f"WITH {_BOXES} SELECT l.k, r.k AS neighbour FROM bx l JOIN bx r ON l.k <> r.k AND greatest(l.x1, r.x1) <= least(l.x2, r.x2) AND greatest(l.y1, r.y1) <= least(l.y2, r.y2) AND (greatest(l.x1, r.x1) = least(l.x2, r.x2) OR greatest(l.y1, r.y1) = least(l.y2, r.y2))")
def geo_touch(t: Tables) -> DataFrame:
    return S.touching(boxes(t), "k", 50.0)


_CELLBOX = "cl AS (SELECT i * 6 + j AS k, i * 35.0 AS x1, j * 35.0 AS y1, i * 35.0 + 35 AS x2, j * 35.0 + 35 AS y2 FROM range(0, 8) a(i), range(0, 6) b(j))"


@query(
    "geo_outer_overlap",
    f"""WITH {_BOXES}, {_CELLBOX}, o AS (SELECT l.k AS l_k, r.k AS r_k, (least(l.x2, r.x2) - greatest(l.x1, r.x1)) * (least(l.y2, r.y2) - greatest(l.y1, r.y1)) AS area FROM bx l JOIN cl r ON greatest(l.x1, r.x1) < least(l.x2, r.x2) AND greatest(l.y1, r.y1) < least(l.y2, r.y2))
    SELECT l_k, CAST(r_k AS BIGINT) AS r_k, CAST(area AS DOUBLE) AS area FROM o UNION ALL SELECT k, NULL, (x2 - x1) * (y2 - y1) - coalesce(s, 0) FROM bx LEFT JOIN (SELECT l_k, sum(area) s FROM o GROUP BY 1) ON l_k = k WHERE (x2 - x1) * (y2 - y1) - coalesce(s, 0) > 1e-9""",
)
def geo_outer_overlap(t: Tables) -> DataFrame:
    i, j = (c("id") / 6).cast("int"), c("id") % 6
    cells = t.spark.range(48).select(c("id").alias("k"), (i * 35.0).alias("x1"), (j * 35.0).alias("y1"), (i * 35.0 + 35).alias("x2"), (j * 35.0 + 35).alias("y2"))
    return S.outer_overlap(boxes(t), cells, 50.0).select("l_k", "r_k", "area")


def diamonds(t: Tables) -> DataFrame:
    """A square on its corner for each supplier."""
    k = c("s_suppkey")
    x, y, r = (k * 13 % 800), (k * 29 % 900), (k % 37 + 20)
    wkt = F.concat_ws("", F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", (x + a * r).cast("string"), (y + b * r).cast("string")) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))]), F.lit("))"))
    return t.supplier.select(k.alias("k"), wkt.alias("wkt"))


@query("geo_in_polygon", "SELECT c_custkey, s_suppkey AS k FROM customer JOIN supplier ON abs(c_custkey % 800 + 0.3 - s_suppkey * 13 % 800) + abs(c_custkey * 7 % 900 + 0.4 - s_suppkey * 29 % 900) < s_suppkey % 37 + 20")
def geo_in_polygon(t: Tables) -> DataFrame:
    points = t.customer.select("c_custkey", (c("c_custkey") % 800 + 0.3).alias("x"), (c("c_custkey") * 7 % 900 + 0.4).alias("y"))
    return Y.in_polygons(points, diamonds(t), 50.0, "wkt").select("c_custkey", c("p_k").alias("k"))


@query("geo_shapes", "WITH x AS (SELECT s_suppkey AS k, s_suppkey * 13 % 800 AS x, s_suppkey * 29 % 900 AS y, s_suppkey % 37 + 20 AS r FROM supplier) SELECT k, CAST(2 * r * r AS DOUBLE) AS area, round(4 * sqrt(2) * r, 6) AS perimeter, round(x::DOUBLE, 6) AS cx, round(y::DOUBLE, 6) AS cy, CAST(x - r AS DOUBLE) AS x_min, CAST(y + r AS DOUBLE) AS y_max FROM x")
def geo_shapes(t: Tables) -> DataFrame:
    s = S.shape(c("edges"))
    return diamonds(t).select("k", F.explode(F.array(S.edges(c("wkt")))).alias("edges")).select("k", *[F.round(s[n], 6).alias(n) for n in ("area", "perimeter", "cx", "cy", "x_min", "y_max")])


@query("geo_slivers", "WITH x AS (SELECT p_partkey, CAST(p_size * (p_partkey % 7 + 1) AS DOUBLE) AS a, 2.0 * (p_size + p_partkey % 7 + 1) AS p FROM part) SELECT p_partkey, round(4 * 3.14 * a / (p * p), 6) AS thin_ratio FROM x WHERE a >= 30 AND 4 * 3.14 * a / (p * p) > 0.4")
def geo_slivers(t: Tables) -> DataFrame:
    w = c("p_partkey") % 7 + 1
    rows = t.part.select("p_partkey", (c("p_size") * w).cast("double").alias("a"), (2.0 * (c("p_size") + w)).alias("p"))
    return S.without_slivers(rows, "a", "p", 30, 0.4).select("p_partkey", F.round("thin_ratio", 6).alias("thin_ratio"))


@query("geo_polygon_parts", "SELECT s_suppkey AS k, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['POLYGON ((0 0, 1 0, 1 ' || s_suppkey || ', 0 0))'] WHEN 1 THEN ['POLYGON ((0 0, 2 0, 2 2, 0 0))', 'POLYGON ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 5.5, 7 6, 6 5.5))'] ELSE ['POLYGON ((3 3, 4 3, 4 4, 3 3))'] END) AS part FROM supplier")
def geo_polygon_parts(t: Tables) -> DataFrame:
    k = c("s_suppkey")
    one = F.concat(F.lit("POLYGON ((0 0, 1 0, 1 "), k, F.lit(", 0 0))"))
    wkt = F.when(k % 3 == 0, one).when(k % 3 == 1, "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 5.5, 7 6, 6 5.5)))").otherwise("GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 1 1), POLYGON ((3 3, 4 3, 4 4, 3 3)))")
    return t.supplier.select(k.alias("k"), F.explode(S.polygon_parts(wkt)).alias("part"))


#: The projection by another series (Redfearn's), which agrees to millimetres within a zone.
_UTM = """p AS (SELECT c_custkey, radians(50 + c_custkey % 400 / 100.0) AS f, radians(12 + c_custkey * 7 % 600 / 100.0 - 15) AS l FROM customer),
    q AS (SELECT *, 6378137.0 / sqrt(1 - 0.00669438002290 * sin(f) * sin(f)) AS n, tan(f) * tan(f) AS t, 0.00673949677548 * cos(f) * cos(f) AS c, cos(f) * l AS a,
        6378137.0 * ((1 - 0.00669438002290 / 4 - 3 * pow(0.00669438002290, 2) / 64 - 5 * pow(0.00669438002290, 3) / 256) * f - (3 * 0.00669438002290 / 8 + 3 * pow(0.00669438002290, 2) / 32 + 45 * pow(0.00669438002290, 3) / 1024) * sin(2 * f) + (15 * pow(0.00669438002290, 2) / 256 + 45 * pow(0.00669438002290, 3) / 1024) * sin(4 * f) - 35 * pow(0.00669438002290, 3) / 3072 * sin(6 * f)) AS m FROM p)"""


@query("geo_utm", f"WITH {_UTM} SELECT c_custkey, CAST(round((500000 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * 0.00673949677548) * pow(a, 5) / 120)) / 10) AS BIGINT) AS east, CAST(round(0.9996 * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * 0.00673949677548) * pow(a, 6) / 720)) / 10) AS BIGINT) AS north FROM q")
def geo_utm(t: Tables) -> DataFrame:
    east, north = S.to_utm(50 + c("c_custkey") % 400 / 100.0, 12 + c("c_custkey") * 7 % 600 / 100.0, 33)
    return t.customer.select("c_custkey", F.round(east / 10).cast("long").alias("east"), F.round(north / 10).cast("long").alias("north"))
