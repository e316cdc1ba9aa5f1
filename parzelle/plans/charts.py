"""Tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.operators import charts as H
from parzelle.plans.registry import Tables, query


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "plot_boxes",
    """WITH r AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) v FROM orders WHERE o_totalprice IS NOT NULL),
    q AS (SELECT o_orderpriority, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) q2, quantile_cont(v, 0.75) q3 FROM r GROUP BY 1)
    SELECT r.o_orderpriority, count(*) n, round(min(q1), 4) q1, round(min(q2), 4) median, round(min(q3), 4) q3,
    min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) low, max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) high,
    count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) outside FROM r JOIN q ON r.o_orderpriority IS NOT DISTINCT FROM q.o_orderpriority GROUP BY 1""",
)
def plot_boxes(t: Tables) -> DataFrame:
    return rounded(H.boxes(t.orders, "o_orderpriority", "o_totalprice"), 4, "q1", "median", "q3")


@query(
    "plot_density",
    """WITH r AS (SELECT l_returnflag AS label, CAST(l_quantity AS DOUBLE) v FROM lineitem WHERE l_quantity IS NOT NULL),
    t AS (SELECT label, count(*) n, stddev_samp(v) * pow(count(*), -0.2) h, min(v) a, max(v) b FROM r GROUP BY 1 HAVING stddev_samp(v) > 0),
    c AS (SELECT label, v, count(*) k FROM r GROUP BY 1, 2), p AS (SELECT unnest(range(200)) AS point),
    g AS (SELECT label, n, h, point, a - 3.0 * h + point * ((b + 3.0 * h - (a - 3.0 * h)) / 199) x FROM t, p)
    SELECT g.label, CAST(point AS INT) point, round(min(x), 6) AS "at", round(sum(k * exp(-0.5 * pow((x - v) / h, 2)) / (n * h * sqrt(2 * pi()))), 9) density
    FROM g JOIN c ON g.label IS NOT DISTINCT FROM c.label GROUP BY 1, 2""",
)
def plot_density(t: Tables) -> DataFrame:
    return rounded(rounded(H.density(t.lineitem, "l_returnflag", "l_quantity"), 6, "at"), 9, "density")


@query(
    "plot_legend",
    """WITH r AS (SELECT CAST(c_acctbal AS DOUBLE) v FROM customer WHERE c_acctbal IS NOT NULL), e AS (SELECT min(v) lo, max(v) hi FROM r),
    f AS (SELECT least(49, CAST(floor((v - lo) * 50 / (hi - lo)) AS INT)) bin, count(*) n FROM r, e GROUP BY 1),
    b AS (SELECT CAST(unnest(range(50)) AS INT) bin)
    SELECT bin, round(lo + (hi - lo) * bin / 50, 6) low, round(lo + (hi - lo) * (bin + 1) / 50, 6) high, coalesce(n, 0) n,
    CASE WHEN lo + (hi - lo) * bin / 50 < 8000 THEN CAST(0 <= lo + (hi - lo) * bin / 50 AS INT) + CAST(2500 <= lo + (hi - lo) * bin / 50 AS INT) + CAST(5000 <= lo + (hi - lo) * bin / 50 AS INT) END AS class
    FROM b CROSS JOIN e LEFT JOIN f USING (bin)""",
)
def plot_legend(t: Tables) -> DataFrame:
    return rounded(H.legend_histogram(t.customer, "c_acctbal", [0, 2500, 5000, 8000]), 6, "low", "high")


@query(
    "plot_joint",
    """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) x, CAST(l_extendedprice AS DOUBLE) y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
    e AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM r),
    k AS (SELECT least(19, CAST(floor((x - a) * 20 / (b - a)) AS INT)) x_bin, least(19, CAST(floor((y - c) * 20 / (d - c)) AS INT)) y_bin FROM r, e)
    SELECT x_bin, y_bin, count(*) n FROM k GROUP BY GROUPING SETS ((x_bin, y_bin), (x_bin), (y_bin))""",
)
def plot_joint(t: Tables) -> DataFrame:
    return H.joint_histogram(t.lineitem, "l_quantity", "l_extendedprice")


@query("plot_robust_line")
def plot_robust_line(t: Tables) -> DataFrame:
    return H.robust_line(t.lineitem, "l_quantity", "l_extendedprice")
