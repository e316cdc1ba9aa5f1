"""Report tables: parcels are orders, owners suppliers by line item, networks groups of forty suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.operators import concentration as C, reports as P, spatial as S
from parzelle.plans import concentration as K
from parzelle.operators.spatial import haversine
from parzelle.plans.registry import Tables, query

c = F.col

CATEGORIES = list(P.SHORT.values())
NETWORKS = ["nCN", "aCN"]
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"

#: The frame in SQL. Every fifth network has no known place, every eleventh owner no class.
_REP = f"""ow AS (SELECT l_orderkey AS parcel, 's' || l_suppkey AS owner, 'm' || (l_suppkey % 40) AS mother, CAST(l_suppkey % 40 AS INT) AS community, CAST(l_suppkey % 2 + 1 AS INT) AS level1,
        CASE l_suppkey % 11 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CATEGORIES))} WHEN 9 THEN 'nCN' END AS category, n_name AS state, 'f' || (l_partkey % 50) AS farm, l_quantity,
        47 + (l_suppkey * 13 % 800) / 100.0 AS olat, 6 + (l_suppkey * 29 % 900) / 100.0 AS olon,
        CASE WHEN l_suppkey % 5 <> 0 THEN 47 + (l_suppkey % 40 * 17 % 800) / 100.0 END AS mlat, CASE WHEN l_suppkey % 5 <> 0 THEN 6 + (l_suppkey % 40 * 7 % 900) / 100.0 END AS mlon
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    nn AS (SELECT parcel, count(*) AS n FROM ow GROUP BY 1),
    info AS (SELECT community, count(DISTINCT owner) FILTER (level1 = 1) AS number_people, count(DISTINCT owner) FILTER (level1 = 2) AS number_companies FROM ow GROUP BY 1),
    pl AS (SELECT o_orderkey AS parcel, o_totalprice, 47 + (o_orderkey % 800) / 100.0 AS plat, 6 + (o_orderkey * 7 % 900) / 100.0 AS plon FROM orders),
    rep0 AS (SELECT pl.parcel, owner, mother, ow.community, level1, coalesce(category, 'nPR') AS category, state, farm, l_quantity, o_totalprice / n / 10000 AS area, CASE WHEN olat IS NOT NULL THEN {_HAV.format(a='p', b='o')} END AS distance, CASE WHEN mlat IS NOT NULL THEN {_HAV.format(a='p', b='m')} END AS md, number_people, number_companies
        FROM pl LEFT JOIN nn USING (parcel) LEFT JOIN ow USING (parcel) LEFT JOIN info ON ow.community = info.community),
    rep AS (SELECT * EXCLUDE (md), coalesce(md, distance) AS mcomp_dist FROM rep0)"""


def report(t: Tables, rows: int | None = None) -> DataFrame:
    k = c("l_suppkey")
    klass = F.try_element_at(F.array(*[F.lit(x) for x in CATEGORIES], F.lit("nCN")), (k % 11 + 1).cast("int"))
    placed = k % 5 != 0
    owners = t.lineitem.join(t.supplier, k == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey")).select(
        c("l_orderkey").alias("parcel"), F.concat(F.lit("s"), k).alias("owner"), F.concat(F.lit("m"), k % 40).alias("mother"), (k % 40).cast("int").alias("community"), (k % 2 + 1).cast("int").alias("level1"), klass.alias("category"),
        c("n_name").alias("state"), F.concat(F.lit("f"), c("l_partkey") % 50).alias("farm"), "l_quantity", (47 + (k * 13 % 800) / 100.0).alias("owner_lat"), (6 + (k * 29 % 900) / 100.0).alias("owner_lon"),
        F.when(placed, 47 + (k % 40 * 17 % 800) / 100.0).alias("mother_lat"), F.when(placed, 6 + (k % 40 * 7 % 900) / 100.0).alias("mother_lon"),
    )
    parcels = t.orders.select(c("o_orderkey").alias("parcel"), c("o_totalprice").alias("area"), (47 + (c("o_orderkey") % 800) / 100.0).alias("parcel_lat"), (6 + (c("o_orderkey") * 7 % 900) / 100.0).alias("parcel_lon"))
    each = owners.select("community", "owner", "level1").distinct()
    info = each.groupBy("community").agg(F.count_if(c("level1") == 1).alias("number_people"), F.count_if(c("level1") == 2).alias("number_companies"))
    return P.frame(parcels, owners, info, "community", "nPR", haversine, rows)


def dealt(t: Tables) -> DataFrame:
    """The frame for what groups by holder and parcel. Only the footers of line items are read to count them."""
    return report(t, t.lineitem.count())


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(x, digits[x]).alias(x) if x in digits else x for x in df.columns])


@query("rep_frame", f"WITH {_REP} SELECT parcel, owner, mother, community, level1, category, state, farm, l_quantity, round(area, 10) AS area, round(distance, 5) AS distance, round(mcomp_dist, 5) AS mcomp_dist, number_people, number_companies FROM rep")
def rep_frame(t: Tables) -> DataFrame:
    return rounded(report(t), {"area": 10, "distance": 5, "mcomp_dist": 5})


@query("geo_distance_chain", f"WITH {_REP} SELECT parcel, owner, farm, l_quantity, round(distance, 5) AS distance, round(mcomp_dist, 5) AS mcomp_dist FROM rep WHERE owner IS NOT NULL")
def geo_distance_chain(t: Tables) -> DataFrame:
    return rounded(report(t).where("owner IS NOT NULL").select("parcel", "owner", "farm", "l_quantity", "distance", "mcomp_dist"), {"distance": 5, "mcomp_dist": 5})


def _dist_class(d: str) -> str:
    return f"CASE WHEN {d} > 0 AND {d} <= 10 THEN '0-10' WHEN {d} > 10 AND {d} <= 25 THEN '10-25' WHEN {d} > 25 AND {d} <= 50 THEN '25-50' WHEN {d} > 50 AND {d} <= 250 THEN '50-250' WHEN {d} > 250 THEN '>250' ELSE 'unkown' END"


def _holders(holder: str, distance: str, where: str = "TRUE") -> str:
    return f"(SELECT holder, sum(area) AS area, min(category) AS category, count(parcel) AS num_plots, avg(d) AS avg_dist, min(d) AS min_dist, max(d) AS max_dist, max(d) - min(d) AS range_dist, min(number_people) AS number_people, min(number_companies) AS number_companies, {_dist_class('avg(d)')} AS dist_class FROM (SELECT {holder} AS holder, parcel, sum(area) AS area, min(category) AS category, avg({distance}) AS d, min(number_people) AS number_people, min(number_companies) AS number_companies FROM rep WHERE {holder} IS NOT NULL AND {where} GROUP BY 1, 2) GROUP BY 1)"


@query("rep_holders", f"WITH {_REP} SELECT holder, category, round(area, 6) AS area, num_plots, round(avg_dist, 5) AS avg_dist, round(range_dist, 5) AS range_dist, dist_class FROM {_holders('mother', 'mcomp_dist')}")
def rep_holders(t: Tables) -> DataFrame:
    return rounded(P.holders(dealt(t), "mother", "mcomp_dist").select("holder", "category", "area", "num_plots", "avg_dist", "range_dist", "dist_class"), {"area": 6, "avg_dist": 5, "range_dist": 5})


@query("rep_class_profile", f"WITH {_REP}, h AS {_holders('owner', 'distance')} SELECT category, count(*) AS owners, round(avg(num_plots), 6) AS mean_plots, round(avg(avg_dist), 5) AS mean_dist, round(sum(area), 5) AS area, round(median(avg_dist), 5) AS median_dist, round(sum(area) / (SELECT sum(area) FROM h) * 100, 6) AS share FROM h GROUP BY 1")
def rep_class_profile(t: Tables) -> DataFrame:
    return rounded(P.class_profile(dealt(t), "owner", "distance"), {"mean_plots": 6, "mean_dist": 5, "area": 5, "median_dist": 5, "share": 6})


@query("rep_distance_heat", f"WITH {_REP}, h AS {_holders('owner', 'distance')}, b AS (SELECT category, dist_class FROM h UNION ALL SELECT 'ALL', dist_class FROM h) SELECT category, count(*) AS holders, " + ", ".join(f"round(count(*) FILTER (dist_class = '{x}') * 100.0 / count(*), 6) AS \"{x}\"" for x in P.distance_classes()) + " FROM b GROUP BY 1")
def rep_distance_heat(t: Tables) -> DataFrame:
    found = P.distance_heat(dealt(t), "owner", "distance")
    return found.select("category", "holders", *[F.round(f"`{x}`", 6).alias(x) for x in P.distance_classes()])


_LABELS = ", ".join(f"('{x}')" for x in P.distance_classes())


@query(
    "rep_distance_shares",
    f"WITH {_REP}, b AS (SELECT 'Aggr1' AS level, dist_class, area FROM {_holders('owner', 'distance')} UNION ALL SELECT 'Aggr2', dist_class, area FROM {_holders('mother', 'mcomp_dist')}), l(dist_class) AS (VALUES {_LABELS}), v(level) AS (VALUES ('Aggr1'), ('Aggr2')) SELECT level, dist_class, round(coalesce(sum(area), 0), 5) AS area, round(coalesce(sum(area), 0) / (SELECT sum(area) FROM b x WHERE x.level = v.level) * 100, 6) AS share FROM v CROSS JOIN l LEFT JOIN b USING (level, dist_class) GROUP BY level, dist_class",
)
def rep_distance_shares(t: Tables) -> DataFrame:
    return rounded(P.distance_shares(dealt(t), {"Aggr1": ("owner", "distance"), "Aggr2": ("mother", "mcomp_dist")}), {"area": 5, "share": 6})


_STATS = ["area", "num_plots", "avg_dist", "range_dist", "number_people", "number_companies"]


def _describe(x: str) -> str:
    cuts = ", ".join(f"round(quantile_cont({x}, {p}), 4) AS p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"SELECT '{x}' AS variable, count({x}) AS count, round(avg({x}), 4) AS mean, round(stddev({x}), 4) AS std, round(min({x})::DOUBLE, 4) AS min, {cuts}, round(max({x})::DOUBLE, 4) AS max FROM h"


@query("rep_networks", f"WITH {_REP}, h AS {_holders('mother', 'mcomp_dist', "category IN ('nCN', 'aCN')")} " + " UNION ALL ".join(map(_describe, _STATS)))
def rep_networks(t: Tables) -> DataFrame:
    found = P.network_summary(dealt(t), NETWORKS, "mother", "mcomp_dist", _STATS, ["number_people", "number_companies"])
    return rounded(found, dict.fromkeys(("mean", "std", "min", "p5", "p25", "p50", "p75", "p95", "max"), 4))


@query(
    "rep_indicators",
    f"""WITH {_REP}, r AS (SELECT * FROM rep WHERE category IN ('nCN', 'aCN')), o AS (SELECT owner, avg(distance) d FROM r GROUP BY 1), m AS (SELECT community, avg(mcomp_dist) d FROM r GROUP BY 1)
    SELECT unnest(['no. networks', 'no. owners aggr1', 'no. people', 'no. companies', 'area', 'mean distance aggr1', 'mean distance aggr2', 'distance increase']) AS variable,
    unnest([count(DISTINCT community)::DOUBLE, count(DISTINCT owner), count(DISTINCT owner) FILTER (level1 = 1), count(DISTINCT owner) FILTER (level1 = 2), round(sum(area), 5), round((SELECT avg(d) FROM o), 5), round((SELECT avg(d) FROM m), 5), round((SELECT avg(d) FROM m) - (SELECT avg(d) FROM o), 5)]) AS value FROM r""",
)
def rep_indicators(t: Tables) -> DataFrame:
    return rounded(P.network_indicators(report(t), NETWORKS, "owner", "community"), {"value": 5})


#: Made-up origins; the last nations have none.
ORIGINS = {f"NATION_{i}": ("Home", "Old", "New", "Foreign")[i % 4] for i in range(22)}
_ORIGIN = "CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORIGINS.items()) + " END"


@query("rep_origins", f"WITH {_REP}, o AS (SELECT mother, min(state) AS state, sum(area) AS area FROM rep WHERE mother IS NOT NULL GROUP BY 1), g AS (SELECT {_ORIGIN} AS origin, count(*) AS holders, sum(area) AS area FROM o GROUP BY 1) SELECT origin, holders, round(area, 5) AS area, round(holders * 100.0 / sum(holders) OVER (), 6) AS share_holders, round(area * 100 / sum(area) OVER (), 6) AS share_area FROM g WHERE origin IS NOT NULL")
def rep_origins(t: Tables) -> DataFrame:
    return rounded(P.origin_statistics(report(t), "mother", "state", ORIGINS), {"area": 5, "share_holders": 6, "share_area": 6})


@query("rep_state_shares", f"WITH {_REP}, g AS (SELECT state, sum(area) AS area FROM rep WHERE category = 'nPR' GROUP BY 1) SELECT state, round(area, 5) AS area, round(area * 100 / sum(area) OVER (), 6) AS share FROM g")
def rep_state_shares(t: Tables) -> DataFrame:
    return rounded(P.state_shares(report(t), "nPR", "state"), {"area": 5, "share": 6})


@query("agg_nested_sum", f"WITH {_REP}, g AS (SELECT category, community, sum(area) AS area FROM rep GROUP BY 1, 2) SELECT category, community, round(area, 5) AS area, round(area * 100 / sum(area) OVER (PARTITION BY category), 6) AS share FROM g")
def agg_nested_sum(t: Tables) -> DataFrame:
    return rounded(P.class_communities(report(t), "community"), {"area": 5, "share": 6})


def _ranking(key: str, where: str) -> str:
    return f"""WITH {_REP}, g AS (SELECT {key}, min(category) AS category, sum(area) AS area, count(DISTINCT farm) AS farms, count(*) AS parcels, string_agg(DISTINCT state, '_' ORDER BY state) AS states FROM rep WHERE {key} IS NOT NULL AND {where} GROUP BY 1)
    SELECT row_number() OVER o AS place, {key}, category, round(area, 5) AS area, farms, parcels, states, round(area * 100 / sum(area) OVER (), 6) AS share, round(sum(area) OVER o * 100 / sum(area) OVER (), 6) AS cum_share FROM g WINDOW o AS (ORDER BY area DESC, {key})"""


@query("rep_community_areas", _ranking("community", "category NOT IN ('PU', 'RE')"))
def rep_community_areas(t: Tables) -> DataFrame:
    return rounded(P.area_ranking(report(t).where("community IS NOT NULL"), "community", ["PU", "RE"]), {"area": 5, "share": 6, "cum_share": 6})


@query("rep_owner_areas", _ranking("owner", "TRUE"))
def rep_owner_areas(t: Tables) -> DataFrame:
    return rounded(P.area_ranking(report(t).where("owner IS NOT NULL"), "owner"), {"area": 5, "share": 6, "cum_share": 6})


_LEADING = f"""a AS (SELECT unit, owner, min(klass) klass, sum(area) a FROM parcels GROUP BY unit, owner), rr AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY a DESC, owner) k, sum(a) OVER (PARTITION BY unit) tot FROM a),
    sh AS (SELECT unit, klass, sum(a) / max(tot) * 100 AS s FROM rr GROUP BY ALL), mn AS (SELECT unit, klass AS main_class, s AS main_share FROM sh QUALIFY row_number() OVER (PARTITION BY unit ORDER BY s DESC, klass) = 1), lead AS (SELECT unit, klass AS top_class, main_class, main_share FROM rr JOIN mn USING (unit) WHERE k = 1)"""


def leading(t: Tables) -> DataFrame:
    h = K.holdings(t)
    return P.leading_classes(C.class_counts(h, "unit", "area", "owner", "klass", K.SEGMENTS), C.class_shares(h, "unit", "area", "owner", "klass", K.SEGMENTS), "unit", K.SEGMENTS)


@query("rep_leading_class", f"WITH {K.PARCELS}, {_LEADING} SELECT unit, top_class, main_class, round(main_share, 6) AS main_share FROM lead")
def rep_leading_class(t: Tables) -> DataFrame:
    return rounded(leading(t), {"main_share": 6})


def _mix(klass: str) -> str:
    return ", ".join(f"round(count(*) FILTER ({klass} = '{x}') * 100.0 / count(*), 6) AS {x}" for x in K.SEGMENTS)


@query("rep_range_mix", f"WITH {K.PARCELS}, {K.kernel_sql('parcels')}, {_LEADING}, b AS (SELECT CASE WHEN cr1 > 0 AND cr1 <= 0.5 THEN '0-0.5' WHEN cr1 > 0.5 AND cr1 <= 1 THEN '0.5-1' WHEN cr1 > 1 AND cr1 <= 5 THEN '1-5' WHEN cr1 > 5 THEN '>5' ELSE 'none' END AS range, top_class FROM m JOIN lead USING (unit)) SELECT range, count(*) AS units, {_mix('top_class')} FROM b GROUP BY range")
def rep_range_mix(t: Tables) -> DataFrame:
    found = P.range_mix(C.measures(K.holdings(t), "unit", "area", "owner"), leading(t), "unit", "cr1", [0, 0.5, 1, 5], "top_class", K.SEGMENTS)
    return rounded(found, dict.fromkeys(K.SEGMENTS, 6))


@query("rep_over_touched", f"WITH {K.PARCELS}, {K.kernel_sql('parcels')}, h AS (SELECT DISTINCT klass, owner % 7 AS grp, unit FROM parcels) SELECT klass || grp AS holder, count(*) AS units, round(min(cr1), 4) AS low, round(avg(cr1), 4) AS mean, round(max(cr1), 4) AS high FROM h JOIN m USING (unit) GROUP BY 1")
def rep_over_touched(t: Tables) -> DataFrame:
    h = K.holdings(t)
    held = h.select(F.concat("klass", c("owner") % 7).alias("holder"), "unit")
    return rounded(P.over_touched(held, C.measures(h, "unit", "area", "owner"), "holder", "unit", "cr1"), {"low": 4, "mean": 4, "high": 4})


@query(
    "rep_metric_histogram",
    f"""WITH {K.PARCELS}, {K.kernel_sql('parcels')}, f AS (SELECT gini_coeff AS g FROM m WHERE total_area >= 1000), q AS (SELECT quantile_cont(g, 0.02) lo, (quantile_cont(g, 0.98) - quantile_cont(g, 0.02)) / 8 w FROM f),
    b AS (SELECT coalesce(greatest(1, least(8, CAST(floor((g - lo) / nullif(w, 0)) AS INT) + 1)), 1) AS bin, count(*) AS n FROM f, q GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, round(lo + (i - 1) * w, 6) AS low, round(lo + i * w, 6) AS high, coalesce(n, 0) AS n FROM q, range(1, 9) r(i) LEFT JOIN b ON b.bin = r.i""",
)
def rep_metric_histogram(t: Tables) -> DataFrame:
    found = P.metric_histogram(K.rounded(C.measures(K.holdings(t), "unit", "area", "owner")), "gini_coeff", "total_area", 1000, 8)
    return rounded(found, {"low": 6, "high": 6})


_DIGITS = {"total_area": 0, "gini_coeff": 2, "cr1": 1, "cr3": 1}


def _mean_std(rel: str, x: str, d: int, label: str) -> str:
    mean, std = f"round(avg({x}), {d})", f"round(stddev({x}), {d})"
    return f"SELECT '{x}' AS variable, {mean} AS mean_{label}, {std} AS std_{label}, printf('%.{d}f ±(%.{d}f)', {mean}, {std}) AS text_{label} FROM {rel}"


@query(
    "rep_change_table",
    f"""WITH {K.PARCELS}, x AS (WITH {K.kernel_sql('parcels')} SELECT * FROM m), seg AS (SELECT unit, klass || owner % 30 AS owner, area FROM parcels), y AS (WITH {K.kernel_sql('seg')} SELECT * FROM m),
    p AS ({' UNION ALL '.join(_mean_std('x', k, d, 'Aggr1') for k, d in _DIGITS.items())}), q AS ({' UNION ALL '.join(_mean_std('y', k, d, 'Aggr2') for k, d in _DIGITS.items())})
    SELECT p.*, q.* EXCLUDE (variable), round(q.mean_Aggr2 - p.mean_Aggr1, 4) AS diff FROM p JOIN q USING (variable)""",
)
def rep_change_table(t: Tables) -> DataFrame:
    h = K.holdings(t)
    a = K.rounded(C.measures(h, "unit", "area", "owner"))
    b = K.rounded(C.measures(h.withColumn("owner", F.concat("klass", c("owner") % 30)), "unit", "area", "owner"))
    return rounded(P.change_table(a, b, _DIGITS, ("Aggr1", "Aggr2")), {"diff": 4})


@query(
    "rep_class_lorenz",
    f"""WITH {K.PARCELS}, a AS (SELECT owner, min(klass) AS category, sum(area) AS a FROM parcels GROUP BY 1), e AS (SELECT quantile_cont(a, [i / 100.0 FOR i IN range(1, 100)]) q FROM a),
    b AS (SELECT CAST(1 + len(list_filter(q, lambda x: x < a)) AS INT) AS bin, category, sum(a) AS a FROM a, e GROUP BY 1, 2)
    SELECT bin, category, round(a * 100 / sum(a) OVER (), 6) AS share, round(sum(a) OVER (PARTITION BY category ORDER BY bin) * 100 / sum(a) OVER (), 6) AS cum_share FROM b""",
)
def rep_class_lorenz(t: Tables) -> DataFrame:
    h = K.holdings(t).select("owner", c("klass").alias("category"), "area")
    return rounded(P.class_lorenz(h, "owner"), {"share": 6, "cum_share": 6})


@query(
    "rep_led_windows",
    f"""WITH {K._CELLS}, s(version, sx, sy) AS (VALUES {K._SHIFT}), x AS (SELECT {K._WINDOW} AS unit, owner, area FROM cells c, s), {K.kernel_sql('x')} SELECT unit AS win, substr(unit, 1, 3) AS version, cr1 FROM m WHERE owner1 = '7'""",
)
def rep_led_windows(t: Tables) -> DataFrame:
    found = C.measures(S.window_ids(K.cells(t), "col", "row"), "window", "area", "owner").withColumnRenamed("unit", "win")
    return P.led_by(found, "owner1", "7", "win").select("win", "version", "cr1")
