"""The tables behind charts: boxes, densities, legend and joint histograms, robust lines. Null and NaN values don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.ranks import known, percentiles


def boxes(df: DataFrame, category: str, value: str, reach: float = 1.5) -> DataFrame:
    """A row for each category: n, quartiles, whiskers (the outermost values within reach times the quartiles' distance of
    the box), and how many values lie outside."""
    rows = known(df.select(F.col(category).alias("_k"), F.col(value).cast("double").alias("v")), "v")
    cuts = percentiles(rows, ["_k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    fences = cuts.withColumn("_lo", F.col("q1") - reach * (F.col("q3") - F.col("q1"))).withColumn("_hi", F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    met = rows.join(fences.withColumnRenamed("_k", "_c"), F.col("_k").eqNullSafe(F.col("_c")))
    inside = F.col("v").between(F.col("_lo"), F.col("_hi"))
    v = lambda f: f(F.when(inside, F.col("v")))
    return met.groupBy(F.col("_k").alias(category)).agg(F.count(F.lit(1)).alias("n"), F.min("q1").alias("q1"), F.min("q2").alias("median"), F.min("q3").alias("q3"), v(F.min).alias("low"), v(F.max).alias("high"), F.count_if(~inside).alias("outside"))


def density(df: DataFrame, label: str, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """label, point (from 0), at, density: Gaussian kernel density of each label's values on a grid that reaches `cut`
    bandwidths beyond them; the bandwidth is the deviation times n to the power of -1/5. Labels whose values don't differ
    have none. Equal values are counted first; then only sums for each point are shuffled."""
    rows = known(df.select(F.col(label).alias("label"), F.col(value).cast("double").alias("v")), "v")
    counts = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.stddev("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most")).where("sd > 0")
    width = total.withColumn("h", F.col("sd") * F.pow("total", F.lit(-0.2))).withColumn("first", F.col("least") - cut * F.col("h"))
    width = width.withColumn("step", (F.col("most") + cut * F.col("h") - F.col("first")) / (points - 1)).select(F.col("label").alias("_l"), "total", "h", "first", "step")
    met = counts.join(width, F.col("label").eqNullSafe(F.col("_l"))).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("first") + F.col("point") * F.col("step")
    kernel = F.exp(-0.5 * F.pow((at - F.col("v")) / F.col("h"), F.lit(2.0)))
    scale = F.col("total") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi())
    return met.groupBy("label", "point").agg(F.min(at).alias("at"), F.sum(F.col("n") * kernel / scale).alias("density"))


def _bin(value: str, lo: Column, hi: Column, bins: int) -> Column:
    """From 0; the last bin holds the largest value too. Where all values are equal, all are in the first."""
    at = F.floor(F.try_divide((F.col(value) - lo) * bins, hi - lo)).cast("int")
    return F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0)))


def legend_histogram(df: DataFrame, value: str, breaks: list[float], bins: int = 50) -> DataFrame:
    """bin (from 0), low, high, n, class: equal bins from the smallest to the largest value. A bin's class (from 0) is the
    number of breaks that its lower edge has reached; beyond the last break null. Empty bins are 0; without values no rows."""
    rows = known(df.select(F.col(value).cast("double").alias("v")), "v")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    found = rows.join(F.broadcast(ends)).groupBy(_bin("v", F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins
    reached = sum(((F.lit(float(b)) <= edge(F.col("bin"))).cast("int") for b in breaks), F.lit(0))
    out = every.join(found, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), reached.alias("class"))
    return out.withColumn("class", F.when(F.col("class") < len(breaks), F.col("class")))


def joint_histogram(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """x_bin, y_bin, n: counts of pairs in equal bins of both columns, and the margins, where the other column's bin is null.
    Rows with both values count; bins without any are left out."""
    rows = known(known(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x"), "y")
    ends = rows.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cells = rows.join(F.broadcast(ends)).select(*[_bin(c, F.col(f"lo{c}"), F.col(f"hi{c}"), bins).alias(f"{c}_bin") for c in "xy"])
    counted = cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct("x_bin", "y_bin"), F.struct("x_bin", F.lit(None).cast("int").alias("y_bin")), F.struct(F.lit(None).cast("int").alias("x_bin"), "y_bin"))
    return counted.select(F.explode(sides).alias("s"), "n").groupBy("s.x_bin", "s.y_bin").agg(F.sum("n").alias("n"))


#: Residuals of over so many scales weigh less; the scale is the median absolute residual over this normal quantile.
HUBER, NORMAL = 1.345, 0.6744897501960817


#: Bins to a doubling, or to an interval, when a median is looked for; up to so many rows of it are ordered in one task.
BINS, ORDERED = 4096, 100_000


def _middle(rows: DataFrame, value: Column, n: int, most: int = ORDERED) -> float:
    """The exact median of n values from 0 on. Bins that follow the order are counted, and the ones that hold the middle
    ranks are cut into bins again, until few rows are left; only these are ordered, equal ones as one."""
    held = rows.select(value.alias("v"))
    low, high = (n - 1) // 2, n // 2
    first, running = Window.partitionBy(F.lit(0)), (Window.unboundedPreceding, 0)
    holds = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    left, bin_of = n + 1, F.coalesce(F.floor(F.log2("v") * BINS), F.lit(-(2**40)))
    while True:
        bins = held.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        middle = bins.withColumn("upto", F.sum("n").over(first.orderBy("b").rowsBetween(*running))).where(holds(low) | holds(high))
        lo, hi, now, before = middle.agg(F.min("lo"), F.max("hi"), F.sum("n"), F.min(F.col("upto") - F.col("n"))).first()
        low, high = low - before, high - before
        held = rows.select(value.alias("v")).where(F.col("v").between(lo, hi))
        if lo == hi or now <= most or now == left:
            break
        left, bin_of = now, F.floor((F.col("v") - lo) / (hi - lo) * BINS)
    counts = held.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(first.orderBy("v").rowsBetween(*running)))
    one, two = counts.agg(*[F.max(F.when(holds(k), F.col("v"))) for k in (low, high)]).first()
    return one + (two - one) * 0.5


def robust_line(df: DataFrame, x: str, y: str, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """One row: n, intercept, slope, scale of a line fitted by reweighted least squares with Huber's weights, from the plain
    one on. Each round is a sum and an exact median over all rows, which are kept in memory or on the executors' disks until the end
    and aren't shuffled; only these few numbers come to the driver. With fewer
    than two different x, slope and intercept are null. A line through over half of the rows has scale 0 and is kept."""
    rows = known(known(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x"), "y").persist()
    try:
        found = _robust(rows, rounds, tolerance)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([found], "n long, intercept double, slope double, scale double")


def _robust(rows: DataFrame, rounds: int, tolerance: float) -> tuple[int, float | None, float | None, float | None]:
    n, mx, my = rows.agg(F.count(F.lit(1)), F.avg("x"), F.avg("y")).first()

    def fit(w: Column) -> tuple[float, float] | None:
        dx, dy = F.col("x") - F.lit(mx), F.col("y") - F.lit(my)
        s, sx, sy, sxx, sxy = rows.agg(*[F.sum(w * e) for e in (F.lit(1.0), dx, dy, dx * dx, dx * dy)]).first()
        d = s * sxx - sx * sx
        if d <= 1e-12 * s * sxx:
            return None
        slope = (s * sxy - sx * sy) / d
        return (sy - slope * sx) / s + my - slope * mx, slope

    line = fit(F.lit(1.0)) if n else None
    if line is None:
        return n, None, None, None
    scale = None
    for _ in range(rounds):
        off = F.abs(F.col("y") - F.lit(line[0]) - F.lit(line[1]) * F.col("x"))
        scale = _middle(rows, off, n) / NORMAL
        if not scale:
            break
        new = fit(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(HUBER * scale), off), F.lit(1.0))))
        if new is None:
            break
        moved = max(abs(a - b) / (abs(b) + tolerance) for a, b in zip(new, line, strict=True))
        line = new
        if moved < tolerance:
            break
    return n, *line, scale
