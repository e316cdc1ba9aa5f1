"""Ranks, running sums, percentiles and places of groups of any size.

A window over a whole group sorts it in one task. Here a group is dealt into buckets that follow the order of the
value; ranks and sums within a bucket are added to what the buckets before hold, of which there are few. Rows of a group
that share one value are one bucket. Where that makes a bucket too large, ranked_by_ranges() takes over: sampled
boundaries of group, value and tie cut even a run of equal values. percentiles() counts each value once.
places() numbers rows by any columns through sampled ranges, which Spark sorts one by one.

Null and NaN values have no rank and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.lineage import durable

#: Rows of a bucket that a task ranks; with more the boundaries are sampled.
BUCKET_ROWS = 1_000_000
#: Up to so many percentiles are aggregates of one pass by group.
FEW_SHARES = 8
#: Buckets to a doubling of the value.
PER_DOUBLING = 64


def bucket(value: Column) -> Column:
    """Grows with the value; any sign."""
    size = F.floor(F.log2(F.abs(value)) * PER_DOUBLING) + 80_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def known(df: DataFrame, value: str) -> DataFrame:
    """The rows whose value is neither null nor NaN."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group with the linearly interpolated percentile at each share, by name; without groups one row, of nulls if there is no value."""
    cuts = percentile_list(df, group, value, list(shares.values()))
    return cuts.select(*group, *[F.get("cuts", F.lit(i)).alias(name) for i, name in enumerate(shares)])


def percentile_list(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """group, cuts: the linearly interpolated percentiles at the shares, as an array. Equal values are counted together, then dealt into buckets; only the values at the ranks that are needed go on."""
    counted = known(df.select(*group, F.col(value).cast("double").alias(value)), value).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    # dealt by group and bucket once: totals of buckets and running sums within them come from the same shuffle
    counted = counted.withColumn("_b", bucket(F.col(value))).repartition(*group, "_b")
    totals = counted.groupBy(*group, "_b").agg(F.sum("_c").alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)})
    up = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = counted.withColumn("_upto", F.sum("_c").over(up))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
    rows = within.alias("x").join(totals.alias("y"), same & (F.col("x._b") == F.col("y._b"))).select("x.*", "y.n", "y._before")
    last = F.col("_upto") + F.col("_before")
    place = lambda s: (F.col("n") - 1) * s
    hit = lambda k: (last - F.col("_c") <= k) & (k < last)
    if len(shares) <= FEW_SHARES:
        at = lambda k: F.max(F.when(hit(k), F.col(value)))
        one = lambda s: at(F.floor(place(s))) + (at(F.ceil(place(s))) - at(F.floor(place(s)))) * F.max(place(s) - F.floor(place(s)))
        return rows.groupBy(*group).agg(F.array(*[one(F.lit(float(s))) for s in shares]).alias("cuts"))
    each = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s, i: F.struct(i.alias("i"), (place(s) - F.floor(place(s))).alias("part"), F.when(hit(F.floor(place(s))), F.col(value)).alias("low"), F.when(hit(F.ceil(place(s))), F.col(value)).alias("high")))
    some = F.explode(F.filter(each, lambda x: x["low"].isNotNull() | x["high"].isNotNull()))
    found = rows.select(*group, some.alias("_p")).select(*group, "_p.*").groupBy(*group, "i").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("part").alias("part"))
    cut = F.struct("i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("v"))
    return found.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["v"]).alias("cuts"))


def places(df: DataFrame, *columns: str) -> DataFrame:
    """Adds place (from 1) in the order of the columns. Ranges between sampled boundaries are sorted each for itself; a range's first place is the count of rows before it."""
    dealt = durable(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_m", F.monotonically_increasing_id()))
    part, within = F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each range
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_p", part).join(F.broadcast(counts), "_p").select(*df.columns, (within + F.col("_before") + 1).cast("long").alias("place"))


def ranked(df: DataFrame, group: list[str], value: str, tie: str, summed: str | None = None) -> DataFrame:
    """Adds i (1 = smallest), k (1 = largest, ties by `tie` ascending), n, tot and run (sum up to and with i) of the value, or of another column."""
    summed = summed or value
    part = known(df, value).withColumn("_b", bucket(F.col(value)))
    totals = part.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(summed).alias("_t"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        "_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_t_before": F.coalesce(F.sum("_t").over(before), F.lit(0.0)),
        "n": F.sum("_n").over(whole),
        "tot": F.sum("_t").over(whole),
    })
    up = Window.partitionBy(*group, "_b").orderBy(F.col(value), F.col(tie).desc())
    within = part.withColumns({"_i": F.row_number().over(up), "_run": F.sum(summed).over(up.rowsBetween(Window.unboundedPreceding, 0))})
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
    out = within.alias("x").join(totals.alias("y"), same & (F.col("x._b") == F.col("y._b")))
    i = F.col("_i") + F.col("_n_before")
    return out.select("x.*", "y.n", "y.tot", i.cast("long").alias("i"), (F.col("n") - i + 1).cast("long").alias("k"), (F.col("_run") + F.col("_t_before")).alias("run")).drop("_b", "_i", "_run")


def ranked_by_ranges(df: DataFrame, group: list[str], value: str, tie: str, summed: str | None = None) -> DataFrame:
    """As ranked(), for groups with any number of equal values: rows are sorted in ranges of group, value and tie, whose boundaries are sampled; a group's rows in a range are numbered, and the ranges before, one row each, give the offset."""
    summed = summed or value
    order = [*[F.col(g) for g in group], F.col(value), F.col(tie).desc()]
    dealt = durable(known(df, value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    up = Window.partitionBy(*group, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({"_i": F.count(F.lit(1)).over(up), "_run": F.sum(summed).over(up)})
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(summed).alias("_t"))
    totals = totals.withColumns({"_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_t_before": F.coalesce(F.sum("_t").over(before), F.lit(0.0)), "n": F.sum("_n").over(whole), "tot": F.sum("_t").over(whole)})
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
    out = within.alias("x").join(totals.alias("y"), same & (F.col("x._p") == F.col("y._p")))
    i = F.col("_i") + F.col("_n_before")
    return out.select(*[F.col(f"x.{c}") for c in df.columns], "y.n", "y.tot", i.cast("long").alias("i"), (F.col("n") - i + 1).cast("long").alias("k"), (F.col("_run") + F.col("_t_before")).alias("run"))


def ranked_any(df: DataFrame, group: list[str], value: str, tie: str, summed: str | None = None) -> DataFrame:
    """ranked(), or with very many equal values in a group ranked_by_ranges(). Reads the table once to tell, so it should be a stored one."""
    most = known(df, value).groupBy(*group, bucket(F.col(value)).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return (ranked_by_ranges if most > BUCKET_ROWS else ranked)(df, group, value, tie, summed)


def at_percentile(p: float, value: str) -> Column:
    """Aggregate over ranked rows: the linearly interpolated percentile."""
    place = (F.col("n") - 1) * F.lit(p)
    low = F.max(F.when(F.col("i") == F.floor(place) + 1, F.col(value)))
    high = F.max(F.when(F.col("i") == F.ceil(place) + 1, F.col(value)))
    share = F.max(place - F.floor(place))
    return low + (high - low) * share
