"""Joins, aggregates, reshapes and windows that land-register tables need beyond single built-in calls.

Null keys: grouping drops them where stated; joins that must match null with null say so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.ranks import known, percentiles, places


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def split_area(parcels: DataFrame, owners: DataFrame, key: str, area: str, tasks: int | None = None) -> DataFrame:
    """Each parcel's area divided by its number of owner rows, in the whole owner table; without an owner the area is null. tasks: to how many tasks parcels are dealt, else Spark chooses."""
    if tasks:
        owners = owners.repartition(tasks, key)
    counts = owners.groupBy(key).agg(F.count(F.lit(1)).alias("n_owners"))
    joined = parcels.join(counts, key, "left").join(owners, key, "left")
    return joined.withColumn(area, F.try_divide(F.col(area), F.col("n_owners")))


def waterfall(rows: DataFrame, key: str, sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Adds value and method of the first source that has the key. Sources: (method, frame, its key, its value); of a source's rows with one key the smallest value counts."""
    found = [f.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(v).alias("_v")).select("_k", "_v", F.lit(i).alias("_p"), F.lit(name).alias("_m")) for i, (name, f, k, v) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, found).groupBy("_k").agg(F.min(F.struct("_p", "_v", "_m")).alias("_best"))
    return rows.join(best, rows[key] == best["_k"], "left").select(*rows.columns, F.col("_best._v").alias("value"), F.col("_best._m").alias("method"))


def two_rounds(left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """Exact match on the first key; what found none, on the second. Adds round."""
    one = left.join(right.select(first).distinct(), first, "left_semi").withColumn("round", F.lit(1))
    two = left.join(right.select(first).distinct(), first, "left_anti").join(right.select(second).distinct(), second, "left_semi").withColumn("round", F.lit(2))
    return one.unionByName(two)


def fold_outer(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of all on the key, missing numbers as 0."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames).fillna(0)


def fold_left(frames: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), frames)


def mode(df: DataFrame, keys: list[str], value: str, out: str, unknown: str | None = None) -> DataFrame:
    """Most frequent value for each key, the smallest of equally frequent ones; nulls and the unknown value don't count."""
    rows = df.where(F.col(value).isNotNull())
    if unknown is not None:
        rows = rows.where(F.col(value) != unknown)
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col("_v").alias("v")))["v"].alias(out))


def all_modes(df: DataFrame, keys: list[str], value: str, out: str, joint: str = "_") -> DataFrame:
    """All most frequent values, in order, joined."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    top = counted.groupBy(*keys).agg(F.max("_n").alias("_n"))
    best = counted.join(top, [*keys, "_n"])
    return best.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_v")), joint).alias(out))


def modes_of_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column replaced by its mode within the key; one pass over all columns."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select(key, "x.c", "x.v")
    wide = mode(long, [key, "c"], "v", "m").groupBy(key).pivot("c", columns).agg(F.first("m"))
    return df.drop(*columns).join(wide, key, "left").select(*df.columns)


def with_total(df: DataFrame, key: str, value: str, label: str = "TOTAL") -> DataFrame:
    """Sum and percentage for each key, and the grand total as a row. Null keys are dropped."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total"))
    both = rows.rollup(key).agg(F.sum("total").alias("total"), F.grouping(key).alias("_g"))
    all_ = Window.partitionBy(F.lit(0))
    whole = F.max(F.when(F.col("_g") == 1, F.col("total"))).over(all_)
    return both.select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key).cast("string")).alias(key), "total", (F.try_divide(F.col("total"), whole) * 100).alias("share"))


def level_statistics(df: DataFrame, levels: list[str], area: str, parcel: str, owner: str) -> DataFrame:
    """For each value of each level: owners, mean area and parcels of an owner, total area. Level and value are columns."""
    long = df.select(owner, parcel, area, F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in levels])).alias("x")).select("x.*", owner, parcel, area)
    by_owner = long.where(F.col("value").isNotNull()).groupBy("level", "value", owner).agg(F.sum(area).alias("a"), F.count(parcel).alias("p"))
    return by_owner.groupBy("level", "value").agg(F.count(F.lit(1)).alias("owners"), F.avg("a").alias("mean_area"), F.avg("p").alias("mean_parcels"), F.sum("a").alias("total_area"))


def skew(value: str) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def describe(df: DataFrame, columns: list[str], percents: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row for each column: count, mean, std, min, percentiles, max. Null and NaN values don't count."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = known(df.select(stack.alias("x")).select("x.*"), "v")
    out = long.groupBy("variable").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    cuts = percentiles(long, ["variable"], "v", {f"p{round(p * 100)}": p for p in percents})
    return out.join(cuts, "variable").select("variable", "count", "mean", "std", "min", *[f"p{round(p * 100)}" for p in percents], "max")


def correlations(df: DataFrame, columns: list[str], least: float = 0.2) -> DataFrame:
    """Long correlation matrix; weak ones are null."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.a", "x.b", F.when(F.abs("x.r") >= least, F.col("x.r")).alias("r"))


def cross_table(df: DataFrame, row: str, column: str, values: list, percent: bool = False) -> DataFrame:
    """Counts of pairs, 0 where there is none; as percentages of the row if asked for."""
    out = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)
    if not percent:
        return out
    names = [c for c in out.columns if c != row]
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in names])
    return out.select(row, *[(F.try_divide(F.col(f"`{c}`") * 100.0, total)).alias(c) for c in names])


def stretch(df: DataFrame, names: str, others: str, drop: str, areas: list[str]) -> DataFrame:
    """A row for each name of a list column with the entry of the other list at its place; a name to drop goes with its entry; areas are divided by the names that stay."""
    zipped = F.filter(F.arrays_zip(F.col(names).alias("name"), F.col(others).alias("other")), lambda x: x["name"] != drop)
    # by way of a generator, behind which the lists are not computed anew for each use
    held = df.select("*", F.explode(F.array(zipped)).alias("_z")).withColumn("n_owners", F.size("_z"))
    held = held.withColumns({a: F.try_divide(F.col(a), F.col("n_owners")) for a in areas})
    return held.select(*[c for c in df.columns if c not in (names, others)], "n_owners", F.inline("_z"))


def top_words(df: DataFrame, key: str, text: str, stop: DataFrame, n: int, longer_than: int = 2) -> DataFrame:
    """key, words: the most frequent words of each key's texts without stop words (a column word), joined by |; ties go to the alphabet."""
    words = df.select(key, F.explode(F.split(F.lower(F.col(text)), " ")).alias("word")).where(F.length("word") > longer_than).join(F.broadcast(stop), "word", "left_anti")
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), "word"))).where(F.col("_r") <= n)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "word"))), lambda x: x["word"]), "|").alias("words"))


def transposed(df: DataFrame, key: str, values: list) -> DataFrame:
    """Columns become rows (variable) and the key's values columns; the table has a row for each key."""
    numbers = [c for c in df.columns if c != key]
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in numbers])).alias("x")).select(key, "x.*")
    return long.groupBy("variable").pivot(key, values).agg(F.first("v"))


def natural(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all columns that both tables have."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables have no column in common")
    return left.join(right, keys, how)


def looked_up(df: DataFrame, key: str, names: DataFrame, names_key: str, value: str, out: str) -> DataFrame:
    """A column from a dictionary table, null where it has no entry; of a key's entries the smallest. Spark sends the dictionary to all tasks if it is small."""
    one = names.groupBy(F.col(names_key).alias("_k")).agg(F.min(value).alias(out))
    return df.join(one, F.col(key) == F.col("_k"), "left").drop("_k")


def in_given_order(df: DataFrame, column: str, values: list, then: str) -> DataFrame:
    """place: rows by a list of values, others after them, then by another column."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    rank = F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(values) + 1)).otherwise(at)
    return places(df.withColumn("_o", rank), "_o", column, then).drop("_o")


def every_unit(df: DataFrame, key: str, units: DataFrame) -> DataFrame:
    """A row for each unit, with 0 where the table has none."""
    return units.select(key).distinct().join(df, key, "left").fillna(0)


def processed_half(df: DataFrame, done: Column, first, second) -> DataFrame:
    """Rows that a condition holds for go through one function, all others through another; both halves together again."""
    is_done = F.coalesce(done, F.lit(False))
    return first(df.where(is_done)).unionByName(second(df.where(~is_done)), allowMissingColumns=True)


def repeated(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """repeated: 0 for the first row of each key in the order, 1 for those after it."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return df.alias("x").join(first.alias("y"), same).select("x.*", (~F.struct(*[F.col(f"x.{o}") for o in order]).eqNullSafe(F.col("y._f"))).cast("int").alias("repeated"))


def joined(df: DataFrame, key: str, value: str, joint: str, most: int = 10_000) -> DataFrame:
    """key, n, names: the distinct values of each key, in order, joined. A key with more than `most` has null, so no row grows without bound; its values are the table's rows."""
    each = df.where(F.col(value).isNotNull()).select(key, value).distinct()
    sizes = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    names = each.join(sizes.where(F.col("n") <= most).select(key), key, "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), joint).alias("names"))
    return sizes.join(names, key, "left")


def chunks(df: DataFrame, column: str, size: int = 1000) -> DataFrame:
    """Distinct values in order, numbered in chunks of a fixed size. Values are dealt by sampled ranges, so no task sorts them all."""
    return places(df.where(F.col(column).isNotNull()).select(column).distinct(), column).withColumn("chunk", (F.floor((F.col("place") - 1) / size) + 1).cast("long"))
