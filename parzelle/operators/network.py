"""Company networks: edges, components, ultimate owners, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.lineage import table as durable
from parzelle.operators.relational import joined


def share_number(text: Column) -> Column:
    """Share as written in a register: a comma is a decimal point, >x is a little more than x, WO and MO are whole and majority ownership; what names no number is null."""
    number = F.replace(F.regexp_replace(text, "[>\\s]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text == "WO", 98.09999).when(text == "MO", 50.09999).when(F.startswith(text, F.lit(">")), number + 0.09999).otherwise(number)


def strong_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges with at least that share, and weaker ones that stand for control by a manager or board; each once. Without a threshold all; else unknown shares are dropped."""
    if not threshold:
        return edges.distinct()
    control = (F.col("ismanager") == "yes") | (F.col("function") == "Vorstand")
    return edges.where((F.col("share") >= threshold) | ((F.col("share") < threshold) & control)).distinct()


#: A key with over this share of all rows is hot; there are fewer than a thousand.
HOT = 1 / 1000
#: Parts that the rows of a hot key are dealt into.
PARTS = 64


def hot_keys(df: DataFrame, key: str, total: int) -> DataFrame:
    """The keys with over a thousandth of `total` rows, in column hot."""
    return df.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT * total).select("hot")


def join_salted(rows: DataFrame, table: DataFrame, key: str, own: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table that has each key once (in column own). Rows of hot keys are dealt by another column into parts, each of which meets a copy of the key's row. hot: fewer than a thousand rows, sent to all."""
    few = F.broadcast(hot)
    dealt = rows.join(few, F.col(key) == F.col("hot"), "left").withColumn("_s", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    spread = table.join(few, F.col(own) == F.col("hot"), "left").withColumn("_t", F.explode(copies)).drop("hot")
    return dealt.join(spread, (F.col(key) == F.col(own)) & (F.col("_s") == F.col("_t")), how).drop("_s", "_t")


def _followed(rows: DataFrame, table: DataFrame, key: str, by: str, hot_rows: int) -> DataFrame:
    """Rows whose key is replaced by the component of that node in the table, if it has one. With over hot_rows rows, keys of very many rows are joined in parts."""
    on = table.select(F.col("node").alias("_k"), F.col("component").alias("_to"))
    total = rows.count()
    met = join_salted(rows, on, key, "_k", hot_keys(rows, key, total), by, "left") if total > hot_rows else rows.join(on, F.col(key) == F.col("_k"), "left")
    return met.withColumn(key, F.coalesce("_to", key)).select(*rows.columns)


def _begun(e: DataFrame, within: DataFrame, hot_rows: int) -> DataFrame:
    """Edges (a, b) between the components that their ends have already; each once, so all edges from one node into one component are one."""
    half = durable(_followed(e, within, "b", "a", hot_rows).distinct())
    return _followed(half, within, "a", "b", hot_rows)


def _widened(within: DataFrame, found: DataFrame, hot_rows: int) -> DataFrame:
    """All nodes with what their components became; found: node, component of components and of nodes that were in none."""
    found = durable(found)
    old = _followed(within.select("node", "component"), found, "component", "node", hot_rows)
    return old.unionByName(found.join(within.select("node"), "node", "left_anti"))


def components(edges: DataFrame, left: str, right: str, hot_rows: int = 1_000_000, within: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node), by randomised contraction: each round every node goes to the neighbour, or
    itself, of the least hash, and edges are drawn between where their ends went. Hashes differ by round, so a fixed share
    of the nodes is expected to go each round, chains included, and later rounds work on what is left of the edges only.
    Each round ends in a checkpoint. At the end the places are followed back from the last round to the first.

    within: node, component (stored) of other edges that count too. Ends that have a component there begin at it, so only
    what the edges add is worked on.

    With over hot_rows edges, nodes of very many edges, and places that very many nodes went to, are joined in parts, so
    that neither a hub nor a giant component is one task's work."""
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))
    if within is not None:
        return _widened(within, components(_begun(e, within, hot_rows), "a", "b", hot_rows), hot_rows)
    e = durable(e.select(*ends("a", "b")).distinct())
    total = e.count()
    large = total > hot_rows

    def joined_by(rows: DataFrame, table: DataFrame, key: str, own: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
        return join_salted(rows, table, key, own, hot, by, how) if large else rows.join(table, F.col(key) == F.col(own), how)

    went: list[DataFrame] = []
    while total or not went:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(went)), c).alias("h"), F.col(c).alias("v"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count(F.lit(1)).alias("_n"))
        at = durable(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("place"), "_n"))
        hubs = at.where(F.col("_n") > HOT * total).select(F.col("node").alias("hot"))
        to = lambda p: at.select(F.col("node").alias(f"_{p}"), F.col("place").alias(f"{p}_place"))
        moved = joined_by(joined_by(e, to("a"), "a", "_a", hubs, "b"), to("b"), "b", "_b", hubs, "a")
        e = durable(moved.where("a_place <> b_place").select(*ends("a_place", "b_place")).distinct())
        total = e.count()
        went.append(at.select("node", "place"))
    found = went.pop()
    hot = lambda df: hot_keys(df, "place", df.count()) if large else None
    for before in reversed(went):
        on = found.select(F.col("node").alias("_k"), F.col("place").alias("_to"))
        found = durable(joined_by(before, on, "place", "_k", hot(before), "node", "left").select("node", F.coalesce("_to", "place").alias("place")))
    least = found.groupBy(F.col("place").alias("_k")).agg(F.min("node").alias("component"))
    return joined_by(found, least, "place", "_k", hot(found), "node").select("node", "component")


def ultimate_owners(edges: DataFrame, component: str, left: str, right: str) -> DataFrame:
    """component, owner. Targets of "mother company" edges that are no source of one; else, without such edges, targets of the largest share; else all targets. Several are joined."""
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    mothers = edges.where(F.col("function") == "mother company")
    sources = mothers.select(F.col(component).alias("_c"), plain(left).alias("_s")).distinct()
    top = mothers.join(sources, (mothers[component] == sources["_c"]) & (plain(right) == sources["_s"]), "left_anti").select(component, F.col(right).alias("o"), F.lit(0).alias("p"))
    circle = mothers.groupBy(component).agg(F.min(right).alias("o")).select(component, "o", F.lit(1).alias("p"))
    others = edges.where(F.coalesce(F.col("function"), F.lit("")) != "subsidiary")
    most = others.groupBy(component).agg(F.max("share").alias("share"))
    largest = others.join(most, [component, "share"]).select(component, F.col(right).alias("o"), F.lit(2).alias("p"))
    rest = edges.select(component, F.col(right).alias("o"), F.lit(3).alias("p"))
    found = top.unionByName(circle).unionByName(largest).unionByName(rest)
    best = found.groupBy(component).agg(F.min("p").alias("p"))
    return joined(found.join(best, [component, "p"]), component, "o", " AND ").select(component, F.col("names").alias("owner"))


def depth(edges: DataFrame, component: str, left: str, right: str) -> DataFrame:
    """1 + the number of different sources that are also targets in their component."""
    targets = edges.select(component, F.col(right).alias(left)).distinct()
    inner = edges.select(component, left).distinct().join(targets, [component, left], "left_semi")
    counted = inner.groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    return edges.select(component).distinct().join(counted, component, "left").select(component, (F.coalesce("n", F.lit(0)) + 1).alias("depth"))


def members(edges: DataFrame, component: str, left: str, right: str) -> DataFrame:
    return edges.select(component, F.explode(F.array(left, right)).alias("member")).where("member IS NOT NULL").distinct()


def in_several(edges: DataFrame, component: str, left: str, right: str) -> DataFrame:
    """Members of more than one component: how many and which."""
    held = members(edges, component, left, right).where(F.col(component).isNotNull())
    return joined(held.withColumn(component, F.col(component).cast("string")), "member", component, "|").where("n > 1").withColumnRenamed("names", "components")


def bridge(held: DataFrame, member: str, component: str) -> DataFrame:
    """component, merged: components that share a member become the smallest of them."""
    low = held.groupBy(member).agg(F.min(component).alias("b"))
    pairs = held.join(low, member).select(F.col(component).alias("a"), "b").distinct()
    return components(pairs, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("merged"))


def preferred_sources(rows: DataFrame) -> DataFrame:
    """The relations (company, connection, attribute, distance) that each company's sources leave: all shareholders (CSH);
    the national parent (KMn) only of a company without CSH; the global parent (KMg) only if it is another than the parent
    found so far, the farthest shareholder or the national one; a company is no parent of itself; all of the other
    sources. Of several parents of a kind the smallest decides, and all are kept or none. Each company's parents are one row of an aggregate, which
    the relations of parents alone are joined with, so a company's other relations stay where they are."""
    of = lambda a, x: F.when(F.col("attribute") == a, x)
    parent = F.col("attribute").isin("KMn", "KMg")
    least = lambda a: F.min(of(a, F.col("connection")))
    nearest = F.min(of("CSH", F.struct((-F.col("distance")).alias("d"), F.col("connection").alias("c"))))["c"]
    known = rows.where(F.col("attribute").isin("CSH", "KMn", "KMg")).groupBy(F.col("company").alias("_company")).agg(nearest.alias("_csh"), least("KMn").alias("_kmn"), least("KMg").alias("_kmg"))
    met = rows.where(parent).join(known, F.col("company") == F.col("_company"))
    other = lambda x: F.col(x).cast("string") != F.col("company").cast("string")
    of_nation = (F.col("attribute") == "KMn") & F.col("_csh").isNull() & other("_kmn")
    of_world = (F.col("attribute") == "KMg") & other("_kmg") & ~F.col("_kmg").eqNullSafe(F.coalesce("_csh", "_kmn"))
    taken = met.where(of_nation | of_world)
    return rows.where(~parent).unionByName(taken.select(*rows.columns))


def merged_relations(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each company and connection: attribute of the first kind in the order, largest share, manager if any says so, a location if any has one."""
    rank = F.coalesce(*[F.when(F.col("attribute") == a, F.lit(i)) for i, a in enumerate(order)], F.lit(len(order)))
    return rows.groupBy("company", "connection").agg(F.min(F.struct(rank.alias("r"), F.col("attribute")))["attribute"].alias("attribute"), F.max("share").alias("share"), F.max(F.when(F.col("ismanager") == "yes", "yes").otherwise("no")).alias("ismanager"), F.max(F.when(F.length("location") > 0, F.col("location"))).alias("location"))


def chain_edges(rows: DataFrame, company: str, level: str, name: str) -> DataFrame:
    """From a company's ranked holders to edges of neighbouring levels."""
    order = Window.partitionBy(company).orderBy(level, name)
    return rows.select(company, level, F.col(name).alias("conn_left"), F.lead(name).over(order).alias("conn_right")).where("conn_right IS NOT NULL")
