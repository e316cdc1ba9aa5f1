"""Queries for joins, aggregates, reshapes, windows, sets and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parzelle.operators import relational as R
from parzelle.operators.ranks import percentile_list, percentiles, ranked
from parzelle.plans.registry import Tables, query

c = F.col


@query("flt_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'O'")
def flt_range(t: Tables) -> DataFrame:
    return t.orders.where(c("o_totalprice").between(1000, 50000) & (c("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("flt_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def flt_in_list(t: Tables) -> DataFrame:
    return t.customer.where(c("c_mktsegment").isin("BUILDING", "MACHINERY") & ~c("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("flt_all_words", "SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') AND contains(text, 'of')")
def flt_all_words(t: Tables) -> DataFrame:
    return t.documents.where(F.forall(F.array(F.lit("the"), F.lit("ing"), F.lit("of")), lambda w: F.contains(c("text"), w))).select("doc_id")


@query("flt_above_mean_std", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) + 2 * stddev(o_totalprice) FROM orders)")
def flt_above(t: Tables) -> DataFrame:
    limit = t.orders.agg((F.avg("o_totalprice") + 2 * F.stddev("o_totalprice")).alias("m"))
    return t.orders.join(F.broadcast(limit), c("o_totalprice") > c("m")).select("o_orderkey")


@query("flt_duplicated_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def flt_duplicated(t: Tables) -> DataFrame:
    many = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.lineitem.join(many, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt_slice", "SELECT p_partkey, substr(p_brand, 1, 6) AS prefix FROM part WHERE substr(p_brand, 7, 1) = '1' AND length(p_name) < 14")
def flt_slice(t: Tables) -> DataFrame:
    return t.part.where((F.substring("p_brand", 7, 1) == "1") & (F.length("p_name") < 14)).select("p_partkey", F.substring("p_brand", 1, 6).alias("prefix"))


@query("jn_left", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def jn_left(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))


@query("jn_inner", "SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def jn_inner(t: Tables) -> DataFrame:
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).join(t.customer, c("c_nationkey") == c("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("jn_composite", "WITH a AS (SELECT l_partkey, l_suppkey, count(*) n FROM lineitem GROUP BY ALL) SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, a.n FROM lineitem l JOIN a ON l.l_partkey = a.l_partkey AND l.l_suppkey = a.l_suppkey WHERE a.n > 1")
def jn_composite(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.lineitem.join(a, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "n")


@query("jn_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def jn_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 100000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("jn_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def jn_anti(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("jn_null_safe", "WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) k FROM customer), b AS (SELECT n_name, nullif(n_nationkey, 3) k FROM nation) SELECT c_custkey, n_name FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def jn_null_safe(t: Tables) -> DataFrame:
    a = t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("k"))
    b = t.nation.select("n_name", F.nullif(c("n_nationkey"), F.lit(3)).alias("k2"))
    return a.join(b, c("k").eqNullSafe(c("k2")), "left").select("c_custkey", "n_name")


@query(
    "jn_outer_fold",
    """WITH a AS (SELECT c_nationkey k, count(*) customers FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey k, count(*) suppliers FROM supplier GROUP BY 1), d AS (SELECT n_nationkey k, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey > 3)
    SELECT k, coalesce(customers, 0) customers, coalesce(suppliers, 0) suppliers, coalesce(region, 0) AS region FROM a FULL JOIN b USING (k) FULL JOIN d USING (k)""",
)
def jn_outer_fold(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey < 20").groupBy(c("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(c("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    d = t.nation.where("n_nationkey > 3").select(c("n_nationkey").alias("k"), c("n_regionkey").cast("long").alias("region"))
    return R.fold_outer([a, b, d], "k")


@query(
    "jn_left_fold",
    """SELECT n_nationkey AS k, n_name, customers, suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, count(*) suppliers FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""",
)
def jn_left_fold(t: Tables) -> DataFrame:
    a = t.nation.select(c("n_nationkey").alias("k"), "n_name")
    b = t.customer.groupBy(c("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    d = t.supplier.groupBy(c("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return R.fold_left([a, b, d], "k")


@query(
    "jn_area_split",
    "WITH d AS (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) SELECT o_orderkey AS parcel, l_suppkey AS owner, round(o_totalprice / n, 6) area FROM orders LEFT JOIN d ON o_orderkey = d.l_orderkey LEFT JOIN lineitem l ON o_orderkey = l.l_orderkey",
)
def jn_area_split(t: Tables) -> DataFrame:
    parcels = t.orders.select(c("o_orderkey").alias("parcel"), c("o_totalprice").alias("area"))
    owners = t.lineitem.select(c("l_orderkey").alias("parcel"), c("l_suppkey").alias("owner"))
    return R.split_area(parcels, owners, "parcel", "area").select("parcel", "owner", F.round("area", 6).alias("area"))


@query(
    "jn_waterfall",
    """WITH s1 AS (SELECT o_custkey k, min(o_orderkey) v FROM orders WHERE o_totalprice > 150000 GROUP BY 1), s2 AS (SELECT o_custkey k, min(o_orderkey) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s3 AS (SELECT s_suppkey k, s_suppkey v FROM supplier)
    SELECT c_custkey, coalesce(s1.v, s2.v, s3.v) AS value, CASE WHEN s1.v IS NOT NULL THEN 'large' WHEN s2.v IS NOT NULL THEN 'filled' WHEN s3.v IS NOT NULL THEN 'supplier' END AS method FROM customer LEFT JOIN s1 ON c_custkey = s1.k LEFT JOIN s2 ON c_custkey = s2.k LEFT JOIN s3 ON c_custkey = s3.k""",
)
def jn_waterfall(t: Tables) -> DataFrame:
    sources = [("large", t.orders.where("o_totalprice > 150000"), "o_custkey", "o_orderkey"), ("filled", t.orders.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey"), ("supplier", t.supplier, "s_suppkey", "s_suppkey")]
    return R.waterfall(t.customer.select("c_custkey"), "c_custkey", sources)


@query(
    "jn_two_round",
    "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 1 ELSE 2 END AS round FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) OR c_nationkey IN (SELECT s_nationkey FROM supplier)",
)
def jn_two_round(t: Tables) -> DataFrame:
    right = t.supplier.select(c("s_suppkey").alias("c_custkey"), c("s_nationkey").alias("c_nationkey"))
    return R.two_rounds(t.customer.select("c_custkey", "c_nationkey"), right, "c_custkey", "c_nationkey").select("c_custkey", "c_nationkey", "round")


@query("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) quantity, round(avg(l_discount), 6) discount FROM lineitem GROUP BY ALL")
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("agg_named", "SELECT o_custkey, round(sum(o_totalprice), 2) total, min(o_totalprice) low, max(o_totalprice) high, count(DISTINCT o_orderstatus) states, round(median(o_totalprice), 4) middle, count(o_orderkey) n FROM orders GROUP BY o_custkey")
def agg_named(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.countDistinct("o_orderstatus").alias("states"), F.count("o_orderkey").alias("n"))
    middle = percentiles(t.orders, ["o_custkey"], "o_totalprice", {"middle": 0.5})
    return out.join(middle, "o_custkey").withColumn("middle", F.round("middle", 4))


@query("agg_collect", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '_' ORDER BY o_orderstatus) AS states, len(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def agg_collect(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "_").alias("states"), F.size(F.collect_set("o_orderpriority")).cast("long").alias("priorities"))


_COUNTED = "n AS (SELECT o_custkey, o_orderpriority v, count(*) n FROM orders GROUP BY ALL)"


@query("agg_mode_det", f"WITH {_COUNTED} SELECT o_custkey, v AS priority FROM n WHERE v <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) = 1")
def agg_mode_det(t: Tables) -> DataFrame:
    return R.mode(t.orders, ["o_custkey"], "o_orderpriority", "priority", unknown="5-LOW")


@query("agg_mode_all", f"WITH {_COUNTED}, b AS (SELECT * FROM n QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) = 1) SELECT o_custkey, string_agg(v, '_' ORDER BY v) AS priorities FROM b GROUP BY 1")
def agg_mode_all(t: Tables) -> DataFrame:
    return R.all_modes(t.orders, ["o_custkey"], "o_orderpriority", "priorities")


@query(
    "agg_modes_written_back",
    """WITH p AS (SELECT o_custkey, o_orderpriority v, count(*) n FROM orders GROUP BY o_custkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1),
    s AS (SELECT o_custkey, o_orderstatus v, count(*) n FROM orders GROUP BY o_custkey, o_orderstatus QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) = 1)
    SELECT o_orderkey, o.o_custkey, p.v AS o_orderpriority, s.v AS o_orderstatus FROM orders o JOIN p USING (o_custkey) JOIN s USING (o_custkey)""",
)
def agg_modes(t: Tables) -> DataFrame:
    return R.modes_of_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", ["o_orderpriority", "o_orderstatus"])


@query("agg_count_if", "SELECT o_custkey, count(*) FILTER (contains(o_orderpriority, 'URGENT')) AS urgent, count(*) FILTER (NOT contains(o_orderpriority, 'URGENT')) AS other FROM orders GROUP BY 1")
def agg_count_if(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.contains("o_orderpriority", F.lit("URGENT"))).alias("urgent"), F.count_if(~F.contains("o_orderpriority", F.lit("URGENT"))).alias("other"))


@query("agg_rollup", "WITH a AS (SELECT c_mktsegment, sum(c_acctbal) total FROM customer GROUP BY 1) SELECT c_mktsegment, round(total, 2) total, round(total / (SELECT sum(total) FROM a) * 100, 6) AS share FROM a UNION ALL SELECT 'TOTAL', round(sum(total), 2), 100.0 FROM a")
def agg_rollup(t: Tables) -> DataFrame:
    return R.with_total(t.customer, "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("agg_two_level", "WITH a AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_mktsegment, count(*) owners, round(avg(a), 4) mean_area FROM a GROUP BY 1")
def agg_two_level(t: Tables) -> DataFrame:
    a = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.sum("o_totalprice").alias("a"))
    return a.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("owners"), F.round(F.avg("a"), 4).alias("mean_area"))


def _describe_sql(column: str) -> str:
    cuts = ", ".join(f"round(quantile_cont({column}, {p}), 4) AS p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"SELECT '{column}' AS variable, count({column}) AS count, round(avg({column}), 4) AS mean, round(stddev({column}), 4) AS std, min({column})::DOUBLE AS min, {cuts}, max({column})::DOUBLE AS max FROM lineitem"


@query("agg_describe", " UNION ALL ".join(map(_describe_sql, ("l_quantity", "l_extendedprice", "l_discount"))))
def agg_describe(t: Tables) -> DataFrame:
    found = R.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("variable", "count", "min", "max", *[F.round(x, 4).alias(x) for x in ("mean", "std", "p5", "p25", "p50", "p75", "p95")])


@query("agg_skew", "SELECT c_nationkey, round(skewness(c_acctbal), 6) AS skew FROM customer GROUP BY 1")
def agg_skew(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.round(R.skew("c_acctbal"), 6).alias("skew"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg_corr", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN abs(corr({a}, {b})) >= 0.2 THEN corr({a}, {b}) END, 6) AS r FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
def agg_corr(t: Tables) -> DataFrame:
    return R.correlations(t.lineitem, _NUMBERS).select("a", "b", F.round("r", 6).alias("r"))


@query("agg_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem GROUP BY 1")
def agg_ols(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("agg_limits", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.02), 4) low, round(quantile_cont(c_acctbal, 0.98), 4) high FROM customer GROUP BY 1")
def agg_limits(t: Tables) -> DataFrame:
    return percentiles(t.customer, ["c_nationkey"], "c_acctbal", {"low": 0.02, "high": 0.98}).select("c_nationkey", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_FLAGS = ["A", "N", "R"]


@query("rsh_pivot", "SELECT l_linestatus, " + ", ".join(f"round(sum(l_quantity) FILTER (l_returnflag = '{x}'), 2) AS {x}" for x in _FLAGS) + " FROM lineitem GROUP BY 1")
def rsh_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", _FLAGS).agg(F.round(F.sum("l_quantity"), 2))


@query("rsh_xtab_pct", "SELECT c_nationkey, " + ", ".join(f"round(count(*) FILTER (c_mktsegment = '{x}') * 100.0 / count(*), 6) AS {x}" for x in ("BUILDING", "MACHINERY")) + " FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def rsh_xtab(t: Tables) -> DataFrame:
    values = ["BUILDING", "MACHINERY"]
    found = R.cross_table(t.customer.where(c("c_mktsegment").isin(values)), "c_nationkey", "c_mktsegment", values, percent=True)
    return found.select("c_nationkey", *[F.round(v, 6).alias(v) for v in values])


@query(
    "rsh_stretch",
    """WITH n AS (SELECT o_orderkey, o_totalprice, unnest(['a' || o_custkey, 'b' || o_orderkey % 3, 'b0']) AS name, unnest(['x', 'y', 'z']) AS other FROM orders), k AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) n_owners FROM n WHERE name <> 'b0')
    SELECT o_orderkey, n_owners, name, other, round(o_totalprice / n_owners, 4) AS area FROM k""",
)
def rsh_stretch(t: Tables) -> DataFrame:
    names = F.array(F.concat(F.lit("a"), c("o_custkey")), F.concat(F.lit("b"), c("o_orderkey") % 3), F.lit("b0"))
    rows = t.orders.select("o_orderkey", c("o_totalprice").alias("area"), names.alias("names"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("others"))
    return R.stretch(rows, "names", "others", "b0", ["area"]).select("o_orderkey", c("n_owners").cast("long").alias("n_owners"), "name", "other", F.round("area", 4).alias("area"))


@query("rsh_stack", "SELECT DISTINCT member FROM (SELECT 'c' || o_custkey AS member FROM orders UNION ALL SELECT 's' || l_suppkey FROM lineitem)")
def rsh_stack(t: Tables) -> DataFrame:
    return t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("member")).union(t.lineitem.select(F.concat(F.lit("s"), "l_suppkey"))).distinct()


@query("rsh_idxmax", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= l_tax THEN 'discount' ELSE 'tax' END AS largest, greatest(l_discount, l_tax) AS value FROM lineitem")
def rsh_idxmax(t: Tables) -> DataFrame:
    best = F.array_max(F.array(F.struct(c("l_discount").alias("v"), F.lit(1).alias("o"), F.lit("discount").alias("n")), F.struct(c("l_tax").alias("v"), F.lit(0).alias("o"), F.lit("tax").alias("n"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", best["n"].alias("largest"), best["v"].alias("value"))


@query("win_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def win_rank(t: Tables) -> DataFrame:
    return ranked(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_orderkey", c("k").alias("place"))


@query("win_cum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey DESC), 2) AS running, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) AS i FROM orders")
def win_cum(t: Tables) -> DataFrame:
    return ranked(t.orders, [], "o_totalprice", "o_orderkey").select("o_orderkey", F.round("run", 2).alias("running"), "i")


@query("win_ecdf", "SELECT o_orderkey, round(row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) / (SELECT count(*) FROM orders), 6) AS share FROM orders")
def win_ecdf(t: Tables) -> DataFrame:
    return ranked(t.orders, [], "o_totalprice", "o_orderkey").select("o_orderkey", F.round(c("i") / c("n"), 6).alias("share"))


@query("win_eqwidth_pct", "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) k, count(*) OVER (PARTITION BY c_nationkey) n FROM customer) SELECT c_custkey, CAST(CASE WHEN n = 1 THEN 50 ELSE greatest(1, ceil(100 * (k - 1) / (n - 1))) END AS INT) AS pct FROM r")
def win_eqwidth(t: Tables) -> DataFrame:
    from parzelle.operators.concentration import rank_percent

    return ranked(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_custkey", rank_percent(c("k"), c("n")).cast("int").alias("pct"))


@query("win_qcut", "WITH e AS (SELECT quantile_cont(o_totalprice, [i / 20.0 FOR i IN range(1, 20)]) q FROM orders) SELECT o_orderkey, CAST(1 + len(list_filter(q, lambda x: x < o_totalprice)) AS INT) AS bin FROM orders, e")
def win_qcut(t: Tables) -> DataFrame:
    edges = percentile_list(t.orders, [], "o_totalprice", [i / 20.0 for i in range(1, 20)])  # one row
    return t.orders.join(F.broadcast(edges)).select("o_orderkey", (F.size(F.filter("cuts", lambda x: x < c("o_totalprice"))) + 1).alias("bin"))


@query("win_group_count", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer")
def win_group_count(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "n")


@query("srt_topk", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def srt_topk(t: Tables) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("r", F.row_number().over(order)).where("r <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("srt_max_ties", "SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) = 1")
def srt_max_ties(t: Tables) -> DataFrame:
    low = t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("o_orderpriority"))
    return t.orders.join(low, ["o_custkey", "o_orderpriority"], "left_semi").select("o_custkey", "o_orderkey")


@query("srt_chunks", "WITH d AS (SELECT DISTINCT c_name FROM customer) SELECT c_name, row_number() OVER (ORDER BY c_name) AS place, CAST(floor((row_number() OVER (ORDER BY c_name) - 1) / 100) + 1 AS BIGINT) AS chunk FROM d")
def srt_chunks(t: Tables) -> DataFrame:
    return R.chunks(t.customer, "c_name", 100)


@query("set_union", "SELECT c_nationkey AS k, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(c("c_nationkey").alias("k"), c("c_mktsegment").alias("segment")).unionByName(t.supplier.select(c("s_nationkey").alias("k")), allowMissingColumns=True)


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("prj_masked_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE lower(o_orderpriority) END AS label, round(o_totalprice / 10000, 6) AS ha FROM orders")
def prj_masked(t: Tables) -> DataFrame:
    label = F.when(c("o_totalprice") > 200000, "large").when(c("o_orderstatus") == "F", "done").otherwise(F.lower("o_orderpriority"))
    return t.orders.select("o_orderkey", label.alias("label"), F.round(c("o_totalprice") / 10000, 6).alias("ha"))


@query("prj_mapped", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS mapped, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS kept FROM orders")
def prj_mapped(t: Tables) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("filled"), F.lit("O"), F.lit("open"))
    found = F.try_element_at(names, c("o_orderstatus"))
    return t.orders.select("o_orderkey", found.alias("mapped"), F.coalesce(found, "o_orderstatus").alias("kept"))


@query("prj_unpivot", "SELECT c_custkey, 'balance' AS variable, round(c_acctbal, 2) AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
def prj_unpivot(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.round("c_acctbal", 2).alias("balance"), c("c_nationkey").cast("double").alias("nation"))
    return rows.unpivot(["c_custkey"], ["balance", "nation"], "variable", "value")


@query("jsn_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("jsn_nested", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":{\"customers\":' || n || ',\"segments\":[' || segments || ']}', ',' ORDER BY n_name) || '}' AS nations FROM (SELECT n_regionkey, n_name, count(*) AS n, string_agg(DISTINCT '\"' || c_mktsegment || '\"', ',' ORDER BY '\"' || c_mktsegment || '\"') AS segments FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def jsn_nested(t: Tables) -> DataFrame:
    """A JSON object of objects for each region: of its nations, of which there are few."""
    rows = t.nation.join(t.customer, c("n_nationkey") == c("c_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    entry = F.struct("n_name", F.struct("customers", "segments").alias("v"))
    return rows.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("nations"))


@query("jsn_nested_read", "SELECT n_regionkey, n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def jsn_nested_read(t: Tables) -> DataFrame:
    whole = jsn_nested(t).select("n_regionkey", F.explode(F.from_json("nations", "map<string,struct<customers:bigint,segments:array<string>>>")).alias("n_name", "v"))
    return whole.select("n_regionkey", "n_name", c("v.customers").alias("customers"))


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_event_windows(t: Tables) -> DataFrame:
    from parzelle.streaming.windows import windowed_sums

    return windowed_sums(t.events, "ts", "event_type", "value").withColumn("total", F.round("total", 4))
