"""The tables behind reports: a frame of parcels, owners and networks, and what is read from it.

Everything is group-bys over one frame, so it stays lazy and distributed; shares divide by one-row or one-row-a-class
sums. A holder's class is the smallest it has. Null holders are left out; unknown distances are a class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.functions.text import bin_of
from parzelle.operators.ranks import percentile_list, percentiles, places
from parzelle.operators.relational import describe, split_area
from parzelle.operators.projection import geodesic

# Classes of owners and their short names, in the order of the figures.
SHORT = {"nCONETW": "nCN", "aCONETW": "aCN", "PUBLIC": "PU", "CHURCH": "RE", "noagPR": "nPR", "agriPR": "aPR", "a_siCOMP": "aSC", "siCOMP": "nSC", "NONPRO": "OTH"}
# Edges of distance classes in km.
DISTANCES = [0, 10, 25, 50, 250]
UNKNOWN = "unkown"
#: Owner rows of a task that joins and groups by parcel, about; and at most, where that would take more than MANY tasks.
TASK_ROWS, MOST_ROWS = 500_000, 4_000_000
#: Up to so many tasks rows are shuffled as they come (spark.shuffle.sort.bypassMergeThreshold); for more, each writer sorts in memory what it has read.
MANY = 200


def distance_class(distance: Column) -> Column:
    return F.coalesce(bin_of(distance, DISTANCES, UNKNOWN), F.lit(UNKNOWN))


def distance_classes() -> list[str]:
    return [*(f"{a:g}-{b:g}" for a, b in zip(DISTANCES, DISTANCES[1:], strict=False)), f">{DISTANCES[-1]:g}", UNKNOWN]


def mapped(column: Column, names: dict[str, str], other: Column | None = None) -> Column:
    """A dictionary applied to a column; what it doesn't have becomes `other`, else null."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)
    return found if other is None else F.coalesce(found, other)


def with_distances(df: DataFrame, between=geodesic) -> DataFrame:
    """km from the parcel to its owner, and to the ultimate owner; without a place of that one, the former. between: geodesic, on the ellipsoid, or haversine, on the sphere."""
    at = lambda a: (F.col(f"{a}_lat"), F.col(f"{a}_lon"))
    own = between(*at("parcel"), *at("owner"))
    return df.withColumns({"distance": own, "mcomp_dist": F.coalesce(between(*at("parcel"), *at("mother")), own)})


def frame(parcels: DataFrame, owners: DataFrame, info: DataFrame, community: str, fill: str = "noagPR", between=geodesic, rows: int | None = None) -> DataFrame:
    """A row for each parcel and owner: the parcel's area split evenly, in ha; distances; what is known of the community; a missing class is filled.

    rows: how many owner rows there are, or at most. Parcels are then dealt to tasks by rows, so that what a task sorts to
    group by parcel, as holders() does, is bounded for tables of any size; else Spark merges tasks by the bytes it
    shuffles, of which there are few."""
    tasks = rows and max(owners.sparkSession.sparkContext.defaultParallelism, min(MANY, -(-rows // TASK_ROWS)), -(-rows // MOST_ROWS))
    if tasks:  # what is known of communities comes first, since joining it later would deal the rows by community
        owners = owners.join(info, community, "left")
    out = with_distances(split_area(parcels, owners, "parcel", "area", tasks), between).withColumn("area", F.col("area") / 10000)
    if not tasks:
        out = out.join(info, community, "left")
    known = [x for x in info.columns if x != community]
    out = out.select(community, *[x for x in out.columns if x != community and x not in known], *known)
    return out.withColumn("category", F.coalesce("category", F.lit(fill))).drop("n_owners", *[f"{a}_{x}" for a in ("parcel", "owner", "mother") for x in ("lat", "lon")])


def holders(df: DataFrame, holder: str, distance: str, more: list[str] = ()) -> DataFrame:
    """holder, category, area, num_plots, avg_dist, min_dist, max_dist, range_dist, dist_class: first by parcel, then by holder."""
    by = df.where(F.col(holder).isNotNull()).groupBy(F.col(holder).alias("holder"), "parcel").agg(F.sum("area").alias("area"), F.min("category").alias("category"), F.avg(distance).alias("d"), *[F.min(c).alias(c) for c in more])
    out = by.groupBy("holder").agg(F.sum("area").alias("area"), F.min("category").alias("category"), F.count("parcel").alias("num_plots"), F.avg("d").alias("avg_dist"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"), *[F.min(c).alias(c) for c in more])
    return out.withColumns({"range_dist": F.col("max_dist") - F.col("min_dist"), "dist_class": distance_class(F.col("avg_dist"))})


def share_of(column: str, *by: str) -> Column:
    """Per cent of a sum over all rows, or over those with the same `by`. For grouped rows, of which there are few."""
    return F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*(by or [F.lit(0)])))) * 100


def reindexed(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Exactly a row for each label, with its place in the order; null where there was none."""
    order = df.sparkSession.createDataFrame(list(enumerate(labels, 1)), f"ord int, {key} string")
    return order.join(df, key, "left")


def distance_shares(df: DataFrame, levels: dict[str, tuple[str, str]]) -> DataFrame:
    """level, dist_class, area, share of the level's area; all classes at each level."""
    parts = []
    for level, (holder, distance) in levels.items():
        found = holders(df, holder, distance).groupBy("dist_class").agg(F.sum("area").alias("area"))
        parts.append(reindexed(found, "dist_class", distance_classes()).select(F.lit(level).alias("level"), "dist_class", F.coalesce("area", F.lit(0.0)).alias("area")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.withColumn("share", share_of("area", "level"))


def class_profile(df: DataFrame, holder: str, distance: str) -> DataFrame:
    """For each class: owners, mean plots, mean and median distance, area and its share."""
    h = holders(df, holder, distance)
    out = h.groupBy("category").agg(F.count(F.lit(1)).alias("owners"), F.avg("num_plots").alias("mean_plots"), F.avg("avg_dist").alias("mean_dist"), F.sum("area").alias("area"))
    middle = percentiles(h, ["category"], "avg_dist", {"median_dist": 0.5})
    return out.join(middle, "category", "left").withColumn("share", share_of("area"))


def distance_heat(df: DataFrame, holder: str, distance: str) -> DataFrame:
    """For each class, and ALL of them: per cent of its holders in each distance class, 0 where there is none."""
    # each holder counts twice in one pass; a union would work on the frame once for each side
    both = holders(df, holder, distance).select(F.explode(F.array("category", F.lit("ALL"))).alias("category"), "dist_class")
    n = F.count(F.lit(1))
    return both.groupBy("category").agg(n.alias("holders"), *[(F.count(F.when(F.col("dist_class") == c, 1)) * 100.0 / n).alias(c) for c in distance_classes()])


def network_summary(df: DataFrame, categories: list[str], holder: str, distance: str, columns: list[str], more: list[str]) -> DataFrame:
    """Descriptive statistics of the networks of some classes."""
    return describe(holders(df.where(F.col("category").isin(categories)), holder, distance, more), columns)


def network_indicators(df: DataFrame, categories: list[str], owner: str, community: str) -> DataFrame:
    """variable, value: how many networks, owners, people and companies; area; mean distances and their difference."""
    rows = df.where(F.col("category").isin(categories))
    by_owner = rows.groupBy(owner).agg(F.avg("distance").alias("d"), F.max((F.col("level1") == 1).cast("int")).alias("p"), F.max((F.col("level1") == 2).cast("int")).alias("c"), F.sum("area").alias("a"))
    by_net = rows.groupBy(community).agg(F.avg("mcomp_dist").alias("d"))
    one = by_owner.agg(F.count(owner).alias("owners"), F.sum("p").alias("people"), F.sum("c").alias("companies"), F.sum("a").alias("area"), F.avg("d").alias("d1"))
    two = by_net.agg(F.count(community).alias("networks"), F.avg("d").alias("d2"))
    both = one.join(F.broadcast(two))  # one row each
    values = {"no. networks": "networks", "no. owners aggr1": "owners", "no. people": "people", "no. companies": "companies", "area": "area", "mean distance aggr1": "d1", "mean distance aggr2": "d2"}
    each = [F.struct(F.lit(k).alias("variable"), F.col(v).cast("double").alias("value")) for k, v in values.items()]
    return both.select(F.inline(F.array(*each, F.struct(F.lit("distance increase").alias("variable"), (F.col("d2") - F.col("d1")).alias("value")))))


def origin_statistics(df: DataFrame, holder: str, state: str, origins: dict[str, str]) -> DataFrame:
    """origin, holders, area and shares of both; a holder's state is the smallest it has; states without an origin are left out."""
    own = df.where(F.col(holder).isNotNull()).groupBy(holder).agg(F.min(state).alias("state"), F.sum("area").alias("area"))
    out = own.select(mapped(F.col("state"), origins).alias("origin"), "area").where("origin IS NOT NULL").groupBy("origin").agg(F.count(F.lit(1)).alias("holders"), F.sum("area").alias("area"))
    return out.withColumns({"share_holders": share_of("holders"), "share_area": share_of("area")})


def state_shares(df: DataFrame, category: str, state: str) -> DataFrame:
    """Area of one class by state, and its share."""
    return df.where(F.col("category") == category).groupBy(state).agg(F.sum("area").alias("area")).withColumn("share", share_of("area"))


def class_communities(df: DataFrame, community: str) -> DataFrame:
    """Area of each community inside each class, and its share of the class."""
    out = df.groupBy("category", community).agg(F.sum("area").alias("area"))
    whole = out.groupBy("category").agg(F.sum("area").alias("_w"))
    return out.join(whole, "category").select("category", community, "area", (F.col("area") / F.col("_w") * 100).alias("share"))


def area_ranking(df: DataFrame, key: str, exclude: list[str] = ()) -> DataFrame:
    """Holders by area: place, area, share, cumulative share, farms, parcels, states (joined, each once). Classes to exclude are left out, also of the total."""
    rows = df.where(~F.col("category").isin(list(exclude))) if exclude else df
    out = rows.groupBy(key).agg(F.sum("area").alias("area"), F.countDistinct("farm").alias("farms"), F.count(F.lit(1)).alias("parcels"), F.array_join(F.array_sort(F.collect_set("state")), "_").alias("states"), F.min("category").alias("category"))
    ranks = places(out.withColumn("_d", -F.col("area")), "_d", key)
    parts = ranks.withColumn("_c", F.floor((F.col("place") - 1) / 1024))
    totals = parts.groupBy("_c").agg(F.sum("area").alias("_a"))
    before = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_a").over(before), F.lit(0.0)), "_all": F.sum("_a").over(Window.partitionBy(F.lit(0)))})
    run = Window.partitionBy("_c").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_r", F.sum("area").over(run)).join(totals, "_c")
    return out.select("place", key, "category", "area", "farms", "parcels", "states", (F.col("area") / F.col("_all") * 100).alias("share"), ((F.col("_r") + F.col("_before")) / F.col("_all") * 100).alias("cum_share"))


def leading_classes(counts: DataFrame, shares: DataFrame, unit: str, classes: list[str]) -> DataFrame:
    """For each unit the class of its largest owner (of several the last in the list), the class with most area (the first), and that share."""
    top = F.coalesce(*[F.when(F.col(f"count_{c}_top1") == 1, F.lit(c)) for c in reversed(classes)])
    both = counts.join(shares, unit)
    best = F.greatest(*[F.col(f"share_{c}_sh100") for c in classes])
    main = F.coalesce(*[F.when(F.col(f"share_{c}_sh100") == best, F.lit(c)) for c in classes])
    return both.select(unit, top.alias("top_class"), main.alias("main_class"), best.alias("main_share"))


def metric_histogram(df: DataFrame, metric: str, area: str, least: float, bins: int, limits: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """bin, low, high, n: of units of at least that area, in equal bins between two percentiles; what lies outside counts at the ends; empty bins are 0."""
    rows = df.where((F.col(area) >= least) & F.col(metric).isNotNull())
    cut = percentiles(rows, [], metric, {"lo": limits[0], "hi": limits[1]}).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor(F.try_divide(F.col(metric) - F.col("lo"), F.col("w"))).cast("int") + 1))
    found = rows.join(F.broadcast(cut)).groupBy(F.coalesce(at, F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = cut.select("lo", "w", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("lo") + F.col("bin") * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_and_std(df: DataFrame, digits: dict[str, int], label: str) -> DataFrame:
    """variable, mean, std and both as text, rounded by column."""
    aggs = [F.struct(F.lit(c).alias("variable"), F.round(F.avg(c), d).alias(f"mean_{label}"), F.round(F.stddev(c), d).alias(f"std_{label}"), F.format_string(f"%.{d}f ±(%.{d}f)", F.round(F.avg(c), d), F.round(F.stddev(c), d)).alias(f"text_{label}")) for c, d in digits.items()]
    rows = [df.agg(x.alias("x")).select("x.*") for x in aggs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def change_table(a: DataFrame, b: DataFrame, digits: dict[str, int], names: tuple[str, str]) -> DataFrame:
    """Mean and standard deviation of measures at two levels side by side, and the change of the mean."""
    left, right = mean_and_std(a, digits, names[0]), mean_and_std(b, digits, names[1])
    return left.join(right, "variable").withColumn("diff", F.col(f"mean_{names[1]}") - F.col(f"mean_{names[0]}"))


def class_lorenz(df: DataFrame, holder: str, bins: int = 100) -> DataFrame:
    """bin, category, share, cum_share: owners in equally many bins by area (quantile edges), the area of each class in a bin, and up to it, in per cent of all."""
    own = df.where(F.col(holder).isNotNull()).groupBy(holder).agg(F.sum("area").alias("area"), F.min("category").alias("category"))
    cuts = percentile_list(own, [], "area", [i / bins for i in range(1, bins)])  # one row
    part = own.join(F.broadcast(cuts)).select("category", "area", (F.size(F.filter("cuts", lambda x: x < F.col("area"))) + 1).alias("bin"))
    by = part.groupBy("bin", "category").agg(F.sum("area").alias("a"))
    run = Window.partitionBy("category").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("a").over(Window.partitionBy(F.lit(0)))
    return by.select("bin", "category", (F.col("a") / whole * 100).alias("share"), (F.sum("a").over(run) / whole * 100).alias("cum_share"))


def range_mix(metrics: DataFrame, classes: DataFrame, unit: str, metric: str, edges: list[float], klass: str, labels: list[str]) -> DataFrame:
    """range, units, and per cent of its units for each class."""
    rows = metrics.select(unit, bin_of(F.col(metric), edges, "none").alias("range")).join(classes.select(unit, F.col(klass).alias("c")), unit)
    n = F.count(F.lit(1))
    return rows.groupBy("range").agg(n.alias("units"), *[(F.count(F.when(F.col("c") == x, 1)) * 100.0 / n).alias(x) for x in labels])


def over_touched(held: DataFrame, metrics: DataFrame, holder: str, unit: str, metric: str) -> DataFrame:
    """For each holder: smallest, mean and largest value of a measure over the units in which it has land."""
    return held.select(holder, unit).distinct().join(metrics.select(unit, metric), unit).groupBy(holder).agg(F.count(F.lit(1)).alias("units"), F.min(metric).alias("low"), F.avg(metric).alias("mean"), F.max(metric).alias("high"))


def led_by(windows: DataFrame, owner: str, name: str, window: str) -> DataFrame:
    """Windows of all nine versions whose largest owner is a certain one, with the version."""
    return windows.where(F.col(owner) == name).withColumn("version", F.substring(window, 1, 3))
