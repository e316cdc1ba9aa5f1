"""Concentration queries: parcels are orders, owners customers, units nations, classes market segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.operators import concentration as C, relational as R, spatial as S
from parzelle.operators.ranks import percentiles
from parzelle.plans.registry import Tables, query

MEASURES = ["gini_coeff", "hhi", "rosenbluth_index", "theil_index", "lac", "palma_v1", "palma_v2", "palma_v3", "share_p100", "share_p95_99", "share_v19", "share_m50", "share_b40"]
RATIOS = ["cr1", "cr3", "cr4", "cr5", "share1", "share2", "share3"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def holdings(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("parcel"), F.col("c_nationkey").alias("unit"), F.col("o_custkey").alias("owner"), F.col("c_mktsegment").alias("klass"), F.col("o_totalprice").alias("area"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("unit", "num_owners", F.round("total_area", 2).alias("total_area"), *[F.round(c, 6).alias(c) for c in MEASURES], *RATIOS, *[f"owner{k}" for k in range(1, 6)])


def kernel_sql(source: str, unit: str = "unit") -> str:
    """All measures of a DuckDB relation with unit, owner, area."""
    crs = ", ".join(f"round(sum(CASE WHEN k <= {k} THEN a ELSE 0 END) / max(tot) * 100, 2) AS cr{k}" for k in (1, 3, 4, 5))
    shares = ", ".join(f"round(sum(CASE WHEN k = {k} THEN a ELSE 0 END) / max(tot) * 100, 2) AS share{k}" for k in (1, 2, 3))
    names = ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN CAST(owner AS VARCHAR) END), 'None') AS owner{k}" for k in range(1, 6))
    bands = {"share_p100": "a >= p99", "share_p95_99": "a >= p95 AND a < p99", "share_v19": "a >= p90 AND a < p95", "share_m50": "a >= p40 AND a < p90", "share_b40": "a < p40"}
    band = ", ".join(f"round(sum(CASE WHEN {c} THEN a ELSE 0 END) / max(tot) * 100, 6) AS {n}" for n, c in bands.items())
    palma = ", ".join(f"round(sum(CASE WHEN {x} THEN a ELSE 0 END) / nullif(sum(CASE WHEN {y} THEN a ELSE 0 END), 0), 6) AS {n}" for n, x, y in (("palma_v1", "a > p99", "a < p40"), ("palma_v2", "a > p99", "a < p90"), ("palma_v3", "a > p95", "a < p40")))
    return f"""
        agg AS (SELECT {unit} AS unit, owner, sum(area) AS a FROM {source} GROUP BY ALL),
        cut AS (SELECT unit, quantile_cont(a, 0.4) p40, quantile_cont(a, 0.9) p90, quantile_cont(a, 0.95) p95, quantile_cont(a, 0.99) p99, avg(a) mu, count(*) n, sum(a) tot FROM agg GROUP BY unit),
        r AS (SELECT agg.*, cut.* EXCLUDE (unit), row_number() OVER (PARTITION BY agg.unit ORDER BY a, owner DESC) i, row_number() OVER (PARTITION BY agg.unit ORDER BY a DESC, owner) k FROM agg JOIN cut USING (unit)),
        m AS (SELECT unit, count(*) AS num_owners, round(sum(a), 2) AS total_area,
            round(2 * sum(i * a) / (max(n) * max(tot)) - (max(n) + 1) / max(n), 6) AS gini_coeff,
            round(sum((a / tot) * (a / tot)) * 10000, 6) AS hhi, round(1.0 / nullif(2 * sum(k * a / tot) - 1, 0), 6) AS rosenbluth_index,
            round(sum(a / tot * ln(a / tot * n)), 6) AS theil_index,
            round(CASE WHEN count(*) FILTER (a = mu) > 0
                THEN (count(*) FILTER (a < mu) + count(*) FILTER (a = mu) / 2) / max(n) + (coalesce(sum(a) FILTER (a < mu), 0) + sum(a) FILTER (a = mu) / 2) / max(tot)
                ELSE (count(*) FILTER (a < mu) + (max(mu) - max(a) FILTER (a < mu)) / (min(a) FILTER (a >= mu) - max(a) FILTER (a < mu))) / max(n)
                   + (sum(a) FILTER (a < mu) + (max(mu) - max(a) FILTER (a < mu)) / (min(a) FILTER (a >= mu) - max(a) FILTER (a < mu)) * min(a) FILTER (a >= mu)) / max(tot) END, 6) AS lac,
            {palma}, {band}, {crs}, {shares}, {names} FROM r GROUP BY unit)"""


PARCELS = "parcels AS (SELECT o_orderkey parcel, c_nationkey unit, o_custkey AS owner, c_mktsegment klass, o_totalprice area FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("conc_by_nation", f"WITH {PARCELS}, {kernel_sql('parcels')} SELECT * FROM m")
def conc_by_nation(t: Tables) -> DataFrame:
    return rounded(C.measures(holdings(t), "unit", "area", "owner"))


@query("conc_global", f"WITH {PARCELS}, whole AS (SELECT 1 AS unit, owner, area FROM parcels), {kernel_sql('whole')} SELECT * FROM m")
def conc_global(t: Tables) -> DataFrame:
    return rounded(C.measures(holdings(t).withColumn("unit", F.lit(1)), "unit", "area", "owner"))


@query("conc_excluding_own_unit", f"WITH {PARCELS}, kept AS (SELECT * FROM parcels WHERE owner % 25 <> unit), {kernel_sql('kept')} SELECT * FROM m")
def conc_excluding(t: Tables) -> DataFrame:
    return rounded(C.measures(holdings(t).where(F.col("owner") % 25 != F.col("unit")), "unit", "area", "owner"))


@query(
    "conc_theil_decomp",
    f"""WITH {PARCELS}, a AS (SELECT unit, owner, klass, sum(area) a FROM parcels GROUP BY ALL),
    t AS (SELECT *, sum(a) OVER (PARTITION BY unit) tot, count(*) OVER (PARTITION BY unit) n FROM a),
    g AS (SELECT unit, klass, sum(a) / max(tot) s, count(*) ng, max(n) n FROM t GROUP BY ALL),
    bg AS (SELECT unit, sum(s * ln(s * n / ng)) bg FROM g GROUP BY unit),
    w AS (SELECT unit, sum(a / tot * ln(a / tot * n)) th FROM t GROUP BY unit)
    SELECT unit, round(th, 6) theil_index, round(bg, 6) theil_bg, round(th - bg, 6) theil_wg, round(bg / nullif(th, 0), 6) theil_bs FROM w JOIN bg USING (unit)""",
)
def conc_theil(t: Tables) -> DataFrame:
    found = C.theil_parts(holdings(t), "unit", "area", "owner", "klass")
    return found.select("unit", *[F.round(c, 6).alias(c) for c in ("theil_index", "theil_bg", "theil_wg", "theil_bs")])


@query(
    "conc_weighted",
    """WITH r AS (SELECT c_nationkey unit, c_acctbal + 1000 x, c_custkey % 5 + 1 w, c_custkey k FROM customer),
    q AS (SELECT *, sum(w) OVER o cw, sum(x * w) OVER o cx, sum(x) OVER (PARTITION BY unit) t FROM r WINDOW o AS (PARTITION BY unit ORDER BY x, k)),
    l AS (SELECT *, lag(cw) OVER o pw, lag(cx) OVER o px FROM q WINDOW o AS (PARTITION BY unit ORDER BY x, k))
    SELECT unit, round(coalesce(sum(cx * pw - px * cw), 0) / nullif(max(cx) * max(cw), 0), 6) gini, round(sum((x / t) * (x / t) * w) * 10000, 6) hhi FROM l GROUP BY unit""",
)
def conc_weighted(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") + 1000).alias("x"), (F.col("c_custkey") % 5 + 1).alias("w"), "c_custkey")
    return C.weighted(rows, "nation", "x", "w", "c_custkey").select("unit", F.round("gini", 6).alias("gini"), F.round("hhi", 6).alias("hhi"))


_PCT = "CASE WHEN n = 1 THEN 50 ELSE greatest(1, ceil(100 * (k - 1) / (n - 1))) END"
_OWN = f"{PARCELS}, a AS (SELECT unit, owner, min(klass) klass, sum(area) a FROM parcels GROUP BY unit, owner), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY a DESC, owner) k, count(*) OVER (PARTITION BY unit) n, sum(a) OVER (PARTITION BY unit) tot FROM a)"


@query(
    "cat_share",
    f"WITH {_OWN}, p AS (SELECT *, {_PCT} pct FROM r) SELECT unit, "
    + ", ".join(f"round(sum(CASE WHEN klass = '{c}' AND pct <= {p} THEN a ELSE 0 END) / max(tot) * 100, 6) AS share_{c}_sh{p}, count(*) FILTER (klass = '{c}' AND pct <= {p}) AS count_{c}_sh{p}" for c in SEGMENTS for p in (1, 10, 100))
    + " FROM p GROUP BY unit",
)
def cat_share(t: Tables) -> DataFrame:
    found = C.class_shares(holdings(t), "unit", "area", "owner", "klass", SEGMENTS)
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("share_") else F.col(c) for c in found.columns])


@query("cat_topx", f"WITH {_OWN} SELECT unit, " + ", ".join(f"count(*) FILTER (klass = '{c}' AND k <= {x}) AS count_{c}_top{x}" for c in SEGMENTS for x in (1, 3, 5)) + " FROM r GROUP BY unit")
def cat_topx(t: Tables) -> DataFrame:
    return C.class_counts(holdings(t), "unit", "area", "owner", "klass", SEGMENTS)


@query(
    "conc_compare",
    f"""WITH {PARCELS}, x AS (WITH {kernel_sql('parcels')} SELECT * FROM m), seg AS (SELECT unit, klass AS owner, area FROM parcels), y AS (WITH {kernel_sql('seg')} SELECT * FROM m)
    SELECT x.unit, x.cr1 cr1_owner, y.cr1 cr1_class, round(y.cr1 - x.cr1, 3) cr1_diff, round(y.cr1 / nullif(x.cr1, 0) - 1, 3) cr1_incr,
    x.gini_coeff gini_coeff_owner, y.gini_coeff gini_coeff_class, round(y.gini_coeff - x.gini_coeff, 3) gini_coeff_diff, round(y.gini_coeff / nullif(x.gini_coeff, 0) - 1, 3) gini_coeff_incr FROM x LEFT JOIN y USING (unit)""",
)
def conc_compare(t: Tables) -> DataFrame:
    h = holdings(t)
    x, y = rounded(C.measures(h, "unit", "area", "owner")), rounded(C.measures(h, "unit", "area", "klass"))
    return C.compare(x, y, "unit", ["cr1", "gini_coeff"], ("owner", "class"))


_CELLS = "cells AS (SELECT p_size col, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS row, l_suppkey % 200 AS owner, l_extendedprice area FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SHIFT = ", ".join(f"({3 * a + b + 1}, {x}, {y})" for a, x in enumerate(S.SHIFTS) for b, y in enumerate(S.SHIFTS))
_WINDOW = "printf('v%02d_%04d_%04d', version, CAST(floor((col - 1 + sx) / 3) + 1 AS INT), CAST(floor((row - 1 + sy) / 3) + 1 AS INT))"


def cells(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("p_size").alias("col"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("row"), (F.col("l_suppkey") % 200).alias("owner"), F.col("l_extendedprice").alias("area"))


@query(
    "win_moving12",
    f"""WITH {_CELLS}, s(version, sx, sy) AS (VALUES {_SHIFT}), d AS (SELECT DISTINCT col, row FROM cells),
    w AS (SELECT col, row, {_WINDOW} win FROM d, s), f AS (SELECT win FROM w GROUP BY win HAVING count(*) >= 9),
    x AS (SELECT win AS unit, owner, area FROM (SELECT c.*, {_WINDOW} win FROM cells c, s) SEMI JOIN f USING (win)), {kernel_sql('x')}
    SELECT col, row, CASE WHEN count(cr1) >= 3 THEN round(avg(cr1), 4) END cr1, CASE WHEN count(gini_coeff) >= 3 THEN round(avg(gini_coeff), 4) END gini_coeff FROM w JOIN m ON w.win = m.unit GROUP BY col, row""",
)
def win_moving12(t: Tables) -> DataFrame:
    found = C.moving_window(cells(t), "area", "owner", "col", "row", ["cr1", "gini_coeff"])
    return found.select("col", "row", F.round("cr1", 4).alias("cr1"), F.round("gini_coeff", 4).alias("gini_coeff"))


@query("geo_window", f"WITH {_CELLS}, s(version, sx, sy) AS (VALUES {_SHIFT}) SELECT {_WINDOW} AS win, count(*) n, round(sum(area), 2) area FROM cells, s GROUP BY 1")
def geo_window(t: Tables) -> DataFrame:
    return S.window_ids(cells(t), "col", "row").groupBy(F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query("conc_largest_owner", f"WITH {PARCELS}, {kernel_sql('parcels')} SELECT DISTINCT owner1 FROM m WHERE cr1 > 1 AND cr1 <= 60")
def conc_largest(t: Tables) -> DataFrame:
    return C.measures(holdings(t), "unit", "area", "owner").where("cr1 > 1 AND cr1 <= 60").select("owner1").distinct()


@query(
    "win_lorenz",
    f"""WITH {PARCELS}, a AS (SELECT unit, owner, sum(area) a FROM parcels GROUP BY ALL)
    SELECT unit, owner, round(sum(a) OVER (PARTITION BY unit ORDER BY a, owner DESC) / sum(a) OVER (PARTITION BY unit), 6) AS share, round(row_number() OVER (PARTITION BY unit ORDER BY a, owner DESC) / count(*) OVER (PARTITION BY unit), 6) AS population FROM a""",
)
def win_lorenz(t: Tables) -> DataFrame:
    from parzelle.operators.ranks import ranked

    rows = ranked(C.owner_areas(holdings(t), "unit", "area", "owner"), ["unit"], "area", "owner")
    return rows.select("unit", "owner", F.round(F.col("run") / F.col("tot"), 6).alias("share"), F.round(F.col("i") / F.col("n"), 6).alias("population"))


@query(
    "rep_top_owners",
    f"""WITH {PARCELS}, a AS (SELECT owner, min(klass) klass, count(*) parcels, sum(area) a FROM parcels GROUP BY owner)
    SELECT row_number() OVER (ORDER BY a DESC, owner) place, owner, klass, parcels, round(a, 2) area FROM a ORDER BY a DESC, owner LIMIT 100""",
)
def rep_top_owners(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    a = holdings(t).groupBy("owner").agg(F.min("klass").alias("klass"), F.count(F.lit(1)).alias("parcels"), F.sum("area").alias("area"))
    top = a.orderBy(F.desc("area"), "owner").limit(100)
    return top.select(F.row_number().over(Window.orderBy(F.desc("area"), "owner")).cast("long").alias("place"), "owner", "klass", "parcels", F.round("area", 2).alias("area"))


@query(
    "rep_class_characteristics",
    f"""WITH {PARCELS}, a AS (SELECT klass, owner, sum(area) a, count(*) p FROM parcels GROUP BY ALL)
    SELECT klass, count(*) owners, round(avg(p), 6) mean_plots, round(avg(a), 4) mean_area, round(median(a), 4) median_area, round(sum(a) / (SELECT sum(a) FROM a) * 100, 6) AS share FROM a GROUP BY klass""",
)
def rep_classes(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    a = holdings(t).groupBy("klass", "owner").agg(F.sum("area").alias("a"), F.count(F.lit(1)).alias("p"))
    out = a.groupBy("klass").agg(F.count(F.lit(1)).alias("owners"), F.round(F.avg("p"), 6).alias("mean_plots"), F.round(F.avg("a"), 4).alias("mean_area"), F.sum("a").alias("t"))
    middle = percentiles(a, ["klass"], "a", {"median_area": 0.5}).select("klass", F.round("median_area", 4).alias("median_area"))
    return out.join(middle, "klass").withColumn("share", F.round(F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0))) * 100, 6)).drop("t")


@query(
    "rep_cr1_ranges",
    f"""WITH {PARCELS}, {kernel_sql('parcels')}, b AS (SELECT CASE WHEN cr1 > 0 AND cr1 <= 0.5 THEN '0-0.5' WHEN cr1 > 0.5 AND cr1 <= 1 THEN '0.5-1' WHEN cr1 > 1 AND cr1 <= 5 THEN '1-5' WHEN cr1 > 5 THEN '>5' ELSE 'none' END AS range FROM m)
    SELECT range, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) percent FROM b GROUP BY range""",
)
def rep_cr1_ranges(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from parzelle.functions.text import bin_of

    m = C.measures(holdings(t), "unit", "area", "owner").select(bin_of(F.col("cr1"), [0, 0.5, 1, 5], "none").alias("range"))
    out = m.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("agg_levels", f"""WITH {PARCELS}, l AS (SELECT 'klass' AS level, klass AS value, * EXCLUDE (unit, klass) FROM parcels UNION ALL SELECT 'unit', CAST(unit AS VARCHAR), * EXCLUDE (unit, klass) FROM parcels),
    o AS (SELECT level, value, owner, sum(area) a, count(parcel) p FROM l GROUP BY ALL) SELECT level, value, count(*) owners, round(avg(a), 4) mean_area, round(avg(p), 6) mean_parcels, round(sum(a), 2) total_area FROM o GROUP BY level, value""")
def agg_levels(t: Tables) -> DataFrame:
    found = R.level_statistics(holdings(t), ["klass", "unit"], "area", "parcel", "owner")
    return found.select("level", "value", "owners", F.round("mean_area", 4).alias("mean_area"), F.round("mean_parcels", 6).alias("mean_parcels"), F.round("total_area", 2).alias("total_area"))
