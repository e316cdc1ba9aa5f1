"""Ordered funnels: how many attempts of a client reach each step of a sequence of kinds in time, and how fast.

Built-in DataFrame functions only. The rows are distinct (client, kind, time). Since no step can lie more than `within`
after the first one, a row needs to see only so far ahead. So a client's rows are dealt into spans of time, each with a
copy of the rows that begin the next span, and a window over (client, span) gives each row the next row of each kind: its
frame is the range from one microsecond following to the end. (It is ordered by falling time, so that the frame grows row
by row and Spark keeps one running minimum instead of going through the frame again for each row.) A client that holds a
third of all rows is thus many windows, which hold what happens in an hour.

Steps are chained by equi-joins on client, kind and time: the row that a step is at knows the next row of the kind that
follows. Times of equal length are counted before they are ranked, and ranks are found in two windows, one over ranges
of lengths and one inside the range that holds the rank, so the times of a very active client meet in no task either.

Cases. Rows with a null client, kind or time are left out, and so are kinds that no funnel names. Equal rows count once.
Rows of one client and time don't follow each other; the exclusion holds at the time of the next step, not at that of the
one before. Ties between times are equal values, of which any has the rank. An empty table, or one without any first
step, gives no rows. Only the three columns are read, so others can have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampNTZType

from parzelle.llm.common import durable

SECOND = 1_000_000
#: A span of time is so many times as long as a funnel may take.
SPAN = 12
#: Times are ranked in ranges of 2 to this many microseconds: 300 seconds are 18,311 ranges of 16,384 values.
RANGE_BITS = 14


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: str


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; of a time without a zone, as its clock shows them, whatever zone the session has."""
    c = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * SECOND + (F.extract(F.lit("SECOND"), c) * SECOND).cast("long")


def following(rows: DataFrame, kinds: int, within: int) -> DataFrame:
    """The distinct rows client, kind (0, 1, ...), t, each with next_0, next_1, ...: when the client's next row of each kind comes, as far as it may be within reach."""
    span = F.lit(SPAN * within)
    of = lambda t: F.floor(t / span).cast("long")
    spans = F.explode(F.array_distinct(F.array(of(F.col("t")), of(F.col("t") - within)))).alias("span")
    # dealt before the windows' columns are made, so that all steps share this shuffle
    dealt = rows.select("client", "kind", "t", spans).repartition("client", "span")
    after = Window.partitionBy("client", "span").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    seen = dealt.select("*", *[F.min(F.when(F.col("kind") == k, F.col("t"))).over(after).alias(f"next_{k}") for k in range(kinds)])
    return seen.where(of(F.col("t")) == F.col("span")).drop("span")


def attempts(rows: DataFrame, funnels: list[Funnel], code: dict[str, int], within: int) -> DataFrame:
    """A row for each attempt that reaches step 2: funnel, client, d2 ... dn, the microseconds that each step reached took from the one before, else null."""
    seen = following(rows, len(code), within)
    longest = max(len(f.steps) for f in funnels)

    def step(n: int) -> DataFrame:
        """Rows that may be step n of a funnel, and how long it takes from them to step n + 1, if it can be reached."""
        ways = []
        for f in funnels:
            if len(f.steps) > n:
                then, bad = F.col(f"next_{code[f.steps[n]]}"), F.col(f"next_{code[f.excluding]}")
                free = (then - F.col("t") <= within) & ~F.coalesce(bad <= then, F.lit(False))
                ways.append(F.when((F.col("kind") == code[f.steps[n - 1]]) & free, F.struct(F.lit(f.name).alias("funnel"), (then - F.col("t")).alias("to"))))
        return seen.select("client", "kind", "t", F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("way")).select("way.funnel", "client", "kind", "t", "way.to")

    kind_of = lambda n: F.coalesce(*[F.when(F.col("funnel") == f.name, F.lit(code[f.steps[n - 1]])) for f in funnels if len(f.steps) >= n])
    held = step(1).select("funnel", "client", F.col("t").alias("start"), F.col("t").alias("last"), F.col("to").alias("d2"))
    for n in range(2, longest):
        # an attempt that has ended has no kind, and so meets no row; its time still spreads it over the tasks
        d = F.col(f"d{n}")
        at_step = held.withColumns({"last": F.col("last") + F.coalesce(d, F.lit(0)), "kind": F.when(d.isNotNull(), kind_of(n))})
        met = at_step.join(step(n).withColumnRenamed("t", "last"), ["funnel", "client", "kind", "last"], "left")
        held = met.select(*held.columns, F.when(F.col("last") + F.col("to") - F.col("start") <= within, F.col("to")).alias(f"d{n + 1}"))
    return held.drop("start", "last")


def ranked_times(counted: DataFrame, percent: int) -> DataFrame:
    """funnel, client, step, n, time: the ceil(percent * n / 100)-th smallest time of each step."""
    group = ["funnel", "client", "step"]
    part = F.shiftright("d", RANGE_BITS).alias("part")
    upto = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    coarse = counted.groupBy(*group, part).agg(F.sum("c").alias("c"))
    coarse = coarse.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
    rank = F.expr(f"(n * {percent} + 99) div 100") - (F.col("upto") - F.col("c"))
    coarse = coarse.withColumn("rank", rank).where("rank between 1 and c").select(*group, "part", "n", "rank")
    fine = counted.withColumn("part", F.shiftright("d", RANGE_BITS)).join(coarse, [*group, "part"])
    within = Window.partitionBy(*group, "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("upto", F.sum("c").over(within))
    return fine.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).select(*group, "n", F.col("d").alias("time"))


def count(df: DataFrame, funnels: list[Funnel], within: int = 300 * SECOND, percent: int = 25, client: str = "client_id", kind: str = "kind", time: str = "arrived_at") -> DataFrame:
    """A row for each funnel and client with attempts: n1 ... nn attempts that reach each step, deepest, t2 ... tn the
    percentile of each step's times in microseconds, same_depth the clients of this funnel that get as deep."""
    if len({f.name for f in funnels}) < len(funnels) or not all(len(f.steps) > 1 for f in funnels):
        raise ValueError("funnels need different names and two steps at least")
    if not 0 < percent <= 100:
        raise ValueError("percent must lie above 0, and at 100 at most")
    longest = max(len(f.steps) for f in funnels)
    code = {k: i for i, k in enumerate(sorted({k for f in funnels for k in (*f.steps, f.excluding)}))}
    coded = F.coalesce(*[F.when(F.col(f"`{kind}`") == k, F.lit(i).cast("byte")) for k, i in code.items()])
    rows = df.select(F.col(f"`{client}`").alias("client"), coded.alias("kind"), micros(df, time).alias("t")).dropna().distinct()
    # every first step is an attempt; it takes no time
    begun = F.filter(F.array(*[F.when(F.col("kind") == code[f.steps[0]], F.lit(f.name)) for f in funnels]), lambda x: x.isNotNull())
    first = rows.select("client", F.explode(begun).alias("funnel")).groupBy("funnel", "client").agg(F.count(F.lit(1)).alias("c"))
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"d{n}").alias("d")) for n in range(2, longest + 1)])
    later = attempts(rows, funnels, code, within).select("funnel", "client", F.explode(F.filter(steps, lambda x: x["d"].isNotNull())).alias("x"))
    counted = later.groupBy("funnel", "client", "x.step", "x.d").agg(F.count(F.lit(1)).alias("c")).unionByName(first.select("funnel", "client", F.lit(1).alias("step"), F.lit(0).cast("long").alias("d"), "c"))
    times = ranked_times(durable(counted), percent)
    n_of = lambda n: F.coalesce(F.sum(F.when(F.col("step") == n, F.col("n"))), F.lit(0)).alias(f"n{n}")
    t_of = lambda n: F.max(F.when(F.col("step") == n, F.col("time"))).alias(f"t{n}")
    found = durable(times.groupBy("funnel", "client").agg(*[n_of(n) for n in range(1, longest + 1)], F.max("step").alias("deepest"), *[t_of(n) for n in range(2, longest + 1)]))
    # a row for each funnel and depth
    depths = found.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    return found.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", F.col("client").alias(client), *[f"n{n}" for n in range(1, longest + 1)], "deepest", *[f"t{n}" for n in range(2, longest + 1)], "same_depth")
