"""Concentration and inequality of holdings per unit.

One pass over all units: holdings are summed by owner, ranked in two levels (see ranks), and every measure is a sum over
ranked rows, so no unit's vector is ever in one place and a unit may be the whole table. Units with a null id are left
out; null areas don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.lineage import durable
from parzelle.operators.ranks import at_percentile, bucket, known, ranked, ranked_any

PERCENTILES = {"p40": 0.40, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def owner_areas(df: DataFrame, unit: str, area: str, owner: str) -> DataFrame:
    return df.where(F.col(unit).isNotNull() & F.col(owner).isNotNull()).groupBy(F.col(unit).alias("unit"), F.col(owner).alias("owner")).agg(F.sum(area).alias("area"))


def _share(column: Column) -> Column:
    return F.try_divide(column, F.max("tot")) * 100


def measures(df: DataFrame, unit: str, area: str, owner: str) -> DataFrame:
    """unit, num_owners, total_area and all measures; owners 1 to 5 and ratios of the largest."""
    # summed once and ranked once; both tables, a row for each owner of a unit, are read more than once
    rows = durable(ranked_any(durable(owner_areas(df, unit, area, owner)), ["unit"], "area", "owner"))
    cuts = rows.groupBy("unit").agg(*[at_percentile(p, "area").alias(c) for c, p in PERCENTILES.items()], (F.sum("area") / F.count("area")).alias("mu"))
    rows = rows.join(cuts, "unit")
    x, n, tot, mu = F.col("area"), F.col("n"), F.col("tot"), F.col("mu")

    def area_if(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, x)), F.lit(0.0))

    s = x / tot
    aggs = {
        "num_owners": F.count(F.lit(1)),
        "total_area": F.sum(x),
        "gini_coeff": F.try_divide(2 * F.sum(F.col("i") * x), F.max(n) * F.max(tot)) - (F.max(n) + 1) / F.max(n),
        "hhi": F.sum(s * s) * 10000,
        "rosenbluth_index": F.try_divide(F.lit(1.0), 2 * F.sum(F.col("k") * s) - 1),
        "theil_index": F.sum(F.when(x > 0, s * F.ln(s * n)).otherwise(0.0)),
        "palma_v1": F.try_divide(area_if(x > F.col("p99")), area_if(x < F.col("p40"))),
        "palma_v2": F.try_divide(area_if(x > F.col("p99")), area_if(x < F.col("p90"))),
        "palma_v3": F.try_divide(area_if(x > F.col("p95")), area_if(x < F.col("p40"))),
        "share_p100": _share(area_if(x >= F.col("p99"))),
        "share_p95_99": _share(area_if((x >= F.col("p95")) & (x < F.col("p99")))),
        "share_v19": _share(area_if((x >= F.col("p90")) & (x < F.col("p95")))),
        "share_m50": _share(area_if((x >= F.col("p40")) & (x < F.col("p90")))),
        "share_b40": _share(area_if(x < F.col("p40"))),
        "_m": F.sum((x < mu).cast("long")),
        "_lm": area_if(x < mu),
        "_a": F.sum((x == mu).cast("long")),
        "_la": area_if(x == mu),
        "_xm": F.max(F.when(x < mu, x)),
        "_xm1": F.min(F.when(x >= mu, x)),
        "_mu": F.max(mu),
        "_n": F.max(n),
        "_tot": F.max(tot),
    }
    for k in (1, 3, 4, 5):
        aggs[f"cr{k}"] = F.round(_share(area_if(F.col("k") <= k)), 2)
    for k in (1, 2, 3):
        aggs[f"share{k}"] = F.round(_share(area_if(F.col("k") == k)), 2)
    for k in (1, 2, 3, 4, 5):
        aggs[f"owner{k}"] = F.coalesce(F.max(F.when(F.col("k") == k, F.col("owner").cast("string"))), F.lit("None"))
    out = rows.groupBy("unit").agg(*[c.alias(name) for name, c in aggs.items()])
    delta = (F.col("_mu") - F.col("_xm")) / (F.col("_xm1") - F.col("_xm"))
    apart = (F.col("_m") + delta) / F.col("_n") + (F.col("_lm") + delta * F.col("_xm1")) / F.col("_tot")
    equal = (F.col("_m") + F.col("_a") / 2) / F.col("_n") + (F.col("_lm") + F.col("_la") / 2) / F.col("_tot")
    out = out.withColumn("lac", F.when(F.col("_a") > 0, equal).otherwise(apart))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def theil_parts(df: DataFrame, unit: str, area: str, owner: str, klass: str) -> DataFrame:
    """Theil index of owner-class holdings: total, between classes, within, and the share between."""
    rows = df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit"), F.col(owner).alias("owner"), F.col(klass).alias("klass")).agg(F.sum(area).alias("area"))
    x_ln = F.when(F.col("area") > 0, F.col("area") * F.ln("area")).otherwise(0.0)
    by_class = rows.groupBy("unit", "klass").agg(F.sum("area").alias("a"), F.count(F.lit(1)).alias("n"), F.sum(x_ln).alias("l"))
    whole = Window.partitionBy("unit")
    by_class = by_class.withColumns({"tot": F.sum("a").over(whole), "all": F.sum("n").over(whole)})
    share = F.col("a") / F.col("tot")
    out = by_class.groupBy("unit").agg((F.sum("l") / F.max("tot") - F.ln(F.max("tot") / F.max("all"))).alias("theil_index"), F.sum(F.when(F.col("a") > 0, share * F.ln(share * F.col("all") / F.col("n"))).otherwise(0.0)).alias("theil_bg"))
    return out.withColumns({"theil_wg": F.col("theil_index") - F.col("theil_bg"), "theil_bs": F.try_divide("theil_bg", "theil_index")})


def lorenz(df: DataFrame, unit: str, area: str, owner: str) -> DataFrame:
    """unit, i, population, share: the points of each unit's Lorenz curve, from 0, 0."""
    rows = ranked(df, [unit], area, owner).select(unit, "i", (F.col("i") / F.col("n")).alias("population"), F.try_divide("run", "tot").alias("share"))
    zero = F.lit(0.0)
    return rows.unionByName(df.where(F.col(area).isNotNull()).select(unit).distinct().select(unit, F.lit(0).cast("long").alias("i"), zero.alias("population"), zero.alias("share")))


def weighted(df: DataFrame, unit: str, value: str, weight: str, tie: str) -> DataFrame:
    """Gini, HHI and Lorenz asymmetry of values with weights; no unit is sorted in one task.

    The Gini coefficient is a sum over neighbours in the order of the values, x and w being running sums of value times
    weight and of weight: x[i] * w[i-1] - x[i-1] * w[i] = value[i] * weight[i] * w[i-1] - weight[i] * x[i-1]. Running
    sums are those within a bucket plus the buckets before.
    """
    part = known(df, value).withColumn("_b", bucket(F.col(value))).withColumn("_x", F.col(value) * F.col(weight))
    whole = Window.partitionBy(unit)
    totals = part.groupBy(unit, "_b").agg(F.sum(weight).alias("_bw"), F.sum("_x").alias("_bx"), F.sum(value).alias("_bv"))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(unit, "_b", F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_w0"), F.coalesce(F.sum("_bx").over(before), F.lit(0)).alias("_x0"), F.sum("_bw").over(whole).alias("_w"), F.sum("_bx").over(whole).alias("_tx"), F.sum("_bv").over(whole).alias("_t"))
    inside = Window.partitionBy(unit, "_b").orderBy(value, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = part.withColumns({"_iw": F.coalesce(F.sum(weight).over(inside), F.lit(0)), "_ix": F.coalesce(F.sum("_x").over(inside), F.lit(0))}).join(totals, [unit, "_b"])
    x, w, mu = F.col(value), F.col(weight), F.col("_tx") / F.col("_w")
    rows = rows.withColumns({"_pw": F.col("_iw") + F.col("_w0"), "_px": F.col("_ix") + F.col("_x0"), "_mu": mu})
    below, equal, above = x < F.col("_mu"), x == F.col("_mu"), x >= F.col("_mu")
    some = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    out = rows.groupBy(F.col(unit).alias("unit")).agg(
        F.try_divide(F.sum(F.col("_x") * F.col("_pw") - w * F.col("_px")), F.max("_tx") * F.max("_w")).alias("gini"),
        (F.sum(F.pow(x / F.col("_t"), 2) * w) * 10000).alias("hhi"),
        F.max("_mu").alias("_mu"), F.max("_w").alias("_w"), F.max("_tx").alias("_tx"),
        some(below, w).alias("_m"), some(below, F.col("_x")).alias("_l"), some(equal, w).alias("_a"), some(equal, F.col("_x")).alias("_la"),
        F.max(F.when(below, x)).alias("_xm"), F.min(F.when(above, x)).alias("_xm1"),
    )
    delta = (F.col("_mu") - F.col("_xm")) / (F.col("_xm1") - F.col("_xm"))
    apart = (F.col("_m") + delta) / F.col("_w") + (F.col("_l") + delta * F.col("_xm1")) / F.col("_tx")
    tied = (F.col("_m") + F.col("_a") / 2) / F.col("_w") + (F.col("_l") + F.col("_la") / 2) / F.col("_tx")
    return out.select("unit", "gini", "hhi", F.when(F.col("_a") > 0, tied).otherwise(apart).alias("lac"))


def rank_percent(k: Column, n: Column) -> Column:
    """Equal-width percentile of a rank, 1 to 100; a sole owner is 50."""
    return F.when(n == 1, F.lit(50)).otherwise(F.greatest(F.lit(1), F.ceil(100 * (k - 1) / (n - 1)).cast("int")))


def class_shares(df: DataFrame, unit: str, area: str, owner: str, klass: str, classes: list[str], percents: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """For each class and top percentage of owners: share of the unit's area and number of owners. An owner's class in a unit is the smallest it has there."""
    rows = df.groupBy(F.col(unit).alias("unit"), F.col(owner).alias("owner")).agg(F.sum(area).alias("area"), F.min(klass).alias("klass"))
    rows = ranked(rows.where(F.col("unit").isNotNull()), ["unit"], "area", "owner").withColumn("pct", rank_percent(F.col("k"), F.col("n")))
    aggs = []
    for c in classes:
        for p in percents:
            inside = (F.col("klass") == c) & (F.col("pct") <= p)
            aggs.append((F.coalesce(F.sum(F.when(inside, F.col("area"))), F.lit(0.0)) / F.max("tot") * 100).alias(f"share_{c}_sh{p}"))
            aggs.append(F.count(F.when(inside, 1)).alias(f"count_{c}_sh{p}"))
    return rows.groupBy("unit").agg(*aggs)


def class_counts(df: DataFrame, unit: str, area: str, owner: str, klass: str, classes: list[str], tops: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """For each class: how many of the largest 1, 3, 5 owners belong to it."""
    rows = df.groupBy(F.col(unit).alias("unit"), F.col(owner).alias("owner")).agg(F.sum(area).alias("area"), F.min(klass).alias("klass"))
    rows = ranked(rows.where(F.col("unit").isNotNull()), ["unit"], "area", "owner")
    return rows.groupBy("unit").agg(*[F.count(F.when((F.col("klass") == c) & (F.col("k") <= t), 1)).alias(f"count_{c}_top{t}") for c in classes for t in tops])


def compare(a: DataFrame, b: DataFrame, key: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Both tables' columns with suffixes, their difference and relative increase."""
    left = a.select(key, *[F.col(c).alias(f"{c}_{names[0]}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}_{names[1]}") for c in columns])
    out = left.join(right, key, "left")
    for c in columns:
        x, y = F.col(f"{c}_{names[0]}"), F.col(f"{c}_{names[1]}")
        out = out.withColumns({f"{c}_diff": F.round(y - x, 3), f"{c}_incr": F.round(F.try_divide(y, x) - 1, 3)})
    return out


def moving_window(df: DataFrame, area: str, owner: str, col: str, row: str, columns: list[str], least_cells: int = 9, least_values: int = 3) -> DataFrame:
    """Each cell's mean of the measures of the up to nine windows of 3 x 3 cells around it.

    Window ids follow from the cell by arithmetic, one for each of nine shifts. Windows with fewer than least_cells
    populated cells are left out; a cell needs least_values values of a measure, else that is null.
    """
    from parzelle.operators.spatial import window_ids

    held = durable(df.groupBy(F.col(col).alias("col"), F.col(row).alias("row"), F.col(owner).alias("owner")).agg(F.sum(area).alias("area")))
    cells = window_ids(held.select("col", "row").distinct(), "col", "row")
    full = cells.groupBy("window").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= least_cells)
    found = measures(window_ids(held, "col", "row").join(full.select("window"), "window", "left_semi"), "window", "area", "owner")
    back = cells.join(found.withColumnRenamed("unit", "window"), "window")
    return back.groupBy("col", "row").agg(*[F.when(F.count(c) >= least_values, F.avg(c)).alias(c) for c in columns])
