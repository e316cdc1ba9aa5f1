"""From register entries to edges: lists of holders and managers, persons, names, and the networks they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.operators.lineage import stored
from parzelle.operators.network import components, members, share_number
from parzelle.operators.ranks import places
from parzelle.operators.relational import mode
from parzelle.operators.spatial import of_all

# How register entries mark persons, what managers' titles look like, and words of companies.
SALUTATIONS = ["mr", "mrs"]
TITLES = ["hr. ", "frau ", "dr. ", "dipl.-kfm. ", "dipl.-volkswirt ", "naturwissenschaften "]
TITLE_MARKS = ["hr.", "frau", "dr.", "dipl.-kfm.", "dipl.-volkswirt", "naturwissenschaften"]
COMPANY_MARKS = ["mbh", "gesellschaft"]
PERSON, COMPANY = "Person", "Unternehmen"


def salutation(name: Column) -> tuple[Column, Column]:
    """The name without a leading salutation, and whether it is a person or a company."""
    first = F.substring_index(name, " ", 1)
    person = first.isin(SALUTATIONS) & F.contains(name, F.lit(" "))
    return F.when(person, F.substr(name, F.length(first) + 2)).otherwise(name), F.when(person, PERSON).otherwise(COMPANY)


def manager_kind(name: Column, titled: Column) -> Column:
    """Person or company, from the list of names with titles: a title makes a person; a manager who isn't on the list is a company by its words."""
    bare = lambda x: _without(x, TITLES)
    own = F.get(F.filter(titled, lambda x: bare(x) == name), F.lit(0))
    marked = _any(own, TITLE_MARKS)
    return F.when(own.isNotNull(), F.when(marked, PERSON).otherwise(COMPANY)).otherwise(F.when(_any(name, COMPANY_MARKS), COMPANY).otherwise(PERSON))


def _without(text: Column, terms: list[str]) -> Column:
    for t in terms:
        text = F.replace(text, F.lit(t), F.lit(""))
    return text


def _any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def _lines(column: str) -> Column:
    return F.split(F.col(column), "\n")


OUT = ["company", "connection", "attribute", "distance", "share", "ismanager", "person", "function", "location"]


def relation_rows(df: DataFrame, company: str, names: str, attribute: str, function: Column | None = None, shares: str | None = None, managers: str | None = None, locations: str | None = None, functions: str | None = None, upward: bool = False, distance: int = 1) -> DataFrame:
    """A row for each line of a company's list of names, with the entry at its place in the parallel lists. upward: the
    list climbs to the ultimate owner, so the first name is the farthest and the last the nearest. A distance below 0
    marks subsidiaries. Rows without a list are left out; shorter lists give nulls, locations empty texts."""
    lists = {"name": _lines(names), "share": _lines(shares) if shares else None, "man": _lines(managers) if managers else None, "loc": _lines(locations) if locations else None, "fun": _lines(functions) if functions else None}
    held = {k: v for k, v in lists.items() if v is not None}
    n = F.size(held["name"])
    at = lambda k: F.get(held[k], F.col("i")) if k in held else F.lit(None).cast("string")
    each = df.where(F.col(names).isNotNull()).select(F.col(company).alias("company"), *[F.col(c) for c in dict.fromkeys(x for x in (names, shares, managers, locations, functions) if x)], F.posexplode(held["name"]).alias("i", "line"))
    plain, person = salutation(F.col("line"))
    return each.select(
        "company",
        F.trim(plain).alias("connection"),
        F.lit(attribute).alias("attribute"),
        (n - F.col("i") if upward else F.lit(distance)).cast("int").alias("distance"),
        share_number(F.trim(at("share"))).alias("share"),
        at("man").alias("ismanager"),
        person.alias("person"),
        (function if function is not None else at("fun")).alias("function"),
        F.coalesce(F.trim(at("loc")), F.lit("")).alias("location"),
    )


def manager_rows(df: DataFrame, company: str, names: str, titled: str, functions: str, locations: str) -> DataFrame:
    """Managers: share 0, the function says whether they manage, persons are told by titles."""
    rows = relation_rows(df, company, names, "MAN", functions=functions, locations=locations).drop("person", "share", "ismanager")
    kinds = df.select(F.col(company).alias("company"), _lines(titled).alias("titled")).dropDuplicates(["company"])
    out = rows.join(kinds, "company", "left").withColumns({"share": F.lit(0.0), "ismanager": F.col("function"), "person": manager_kind(F.col("connection"), F.coalesce("titled", F.array().cast("array<string>")))})
    return out.select(*OUT)


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges: from the company to its holder for a positive distance, from the subsidiary to the company for a negative
    one; a holder's location is a suffix of the name. Chains (CSH) go step by step: each name to the next farther one."""
    order = Window.partitionBy("company").orderBy("distance", "connection")
    chain = relations.where(F.col("attribute") == "CSH").withColumn("_from", F.coalesce(F.lag("connection").over(order), F.col("company")))
    name = lambda c: F.when(F.length("location") > 0, F.concat_ws("_", c, "location")).otherwise(F.col(c))
    rest = relations.where((F.col("attribute") != "CSH") & (F.col("distance") != 0))
    below = F.col("distance") < 0
    more = ["share", "ismanager", "function", "attribute", F.col("person").alias("isperson")]
    up = rest.where(~below).select(F.col("company").alias("conn_left"), name("connection").alias("conn_right"), *more)
    down = rest.where(below).select(F.col("connection").alias("conn_left"), name("company").alias("conn_right"), *more)
    steps = chain.select(F.col("_from").alias("conn_left"), F.col("connection").alias("conn_right"), *more)
    return steps.unionByName(up).unionByName(down)


def unified_persons(relations: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    """Within a company: a person 'given family-other' becomes 'given family' if the latter stands there too; then a table of corrections."""
    words = F.split("connection", " ")
    short = F.concat_ws(" ", F.get(words, F.lit(0)), F.substring_index(F.element_at(words, -1), "-", 1))
    double = (F.col("person") == PERSON) & F.contains(F.element_at(words, -1), F.lit("-"))
    known = relations.where(F.col("person") == PERSON).select(F.col("company").alias("_c"), F.col("connection").alias("_n")).distinct()
    rows = relations.withColumn("_s", F.when(double, short))
    joined = rows.join(known, (rows["company"] == known["_c"]) & (rows["_s"] == known["_n"]), "left")
    name = F.coalesce("_n", "connection")
    if corrections:
        name = F.when(F.col("person") == PERSON, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in corrections.items() for x in p]), name), name)).otherwise(name)
    return joined.withColumn("connection", F.trim(name)).select(*relations.columns)


def located_names(edges: DataFrame, component: str, left: str = "conn_left", right: str = "conn_right", person: str = "isperson") -> DataFrame:
    """Within a component a person's bare name becomes the one with a location that contains it, the last in order of
    several; equal edges then count once. Bare names meet the longer ones through their first word."""
    people = edges.where(F.col(person) == PERSON).select(component, F.col(right).alias("n")).distinct()
    bare, full = people.where(~F.contains("n", F.lit("_"))), people.where(F.contains("n", F.lit("_"))).withColumnRenamed("n", "full")
    words = full.withColumn("w", F.explode(F.array_distinct(F.split(F.regexp_replace("full", "_", " "), " "))))
    best = bare.withColumn("w", F.substring_index("n", " ", 1)).join(words, [component, "w"]).where(F.contains("full", F.col("n"))).groupBy(component, F.col("n").alias(right)).agg(F.max("full").alias("_full"))
    return edges.join(best, [component, right], "left").withColumn(right, F.coalesce("_full", right)).select(*edges.columns).distinct()


def community_of(edges: DataFrame, name: str, component: str, left: str, right: str) -> DataFrame:
    """Components of a name: where it is a left end, else a right end, else part of an end."""
    rank = F.when(F.col(left) == name, 1).when(F.col(right) == name, 2).when(F.contains(left, F.lit(name)) | F.contains(right, F.lit(name)), 3)
    found = edges.select(component, rank.alias("r")).where("r IS NOT NULL").distinct()
    best = found.agg(F.min("r").alias("r"))
    return found.join(F.broadcast(best), "r").select(component, F.col("r").alias("how")).distinct()


def owner_communities(rows: DataFrame, owner: str, community: str, first: int = 9999) -> DataFrame:
    """Each owner's most frequent community in all its rows, also those without one; owners without any are numbered from `first`, in order of their names."""
    best = mode(rows.where(F.col(owner).isNotNull()), [owner], community, "_c")
    alone = rows.where(F.col(owner).isNotNull()).select(owner).distinct().join(best, owner, "left_anti")
    numbered = places(alone, owner).select(owner, (F.col("place") + (first - 1)).cast("string").alias("_n"))
    return rows.join(best, owner, "left").join(numbered, owner, "left").withColumn(community, F.coalesce(F.col("_c").cast("string"), "_n")).select(*rows.columns)


def members_report(edges: DataFrame, land: DataFrame, component: str, left: str, right: str, owner: str, area: str) -> DataFrame:
    """For each component its members, whether they are persons, and the area and parcels that they have, if any. land: owner, area, a row for each parcel."""
    kind = edges.select(F.col(right).alias("member"), F.col("isperson")).where("member IS NOT NULL").groupBy("member").agg(F.max("isperson").alias("kind"))
    held = land.groupBy(F.col(owner).alias("member")).agg(F.sum(area).alias("area"), F.count(F.lit(1)).alias("parcels"))
    return members(edges, component, left, right).join(kind, "member", "left").join(held, "member", "left").select(component, "member", F.coalesce("kind", F.lit(COMPANY)).alias("kind"), "area", F.coalesce("parcels", F.lit(0)).alias("parcels"))


def owner_matches(people: DataFrame, owners: DataFrame, company: str, person: str, family: str, given: str, owner: str, address: str, area: str) -> DataFrame:
    """For each person of a company the land owners with the same family name whose given name contains the person's
    first given name (up to a hyphen): how many, the largest area, and their names with addresses. owners: owner,
    address, family, given, area. Very common names make long lists: they are rows with a number, not one list."""
    p = people.where(F.col(company).isNotNull() & F.col(person).isNotNull()).select(company, person, F.col(family).alias("f"), F.substring_index(given, "-", 1).alias("_g")).where(F.length("_g") > 0)
    o = owners.select(F.col(family).alias("f"), F.col(given).alias("_given"), F.concat_ws("_", owner, address).alias("match"), F.col(area).alias("area"))

    def numbered(pairs: DataFrame, *by: str) -> DataFrame:
        largest = pairs.groupBy(*by).agg(F.max("area").alias("max_area"), F.count(F.lit(1)).alias("matches"))
        order = Window.partitionBy(*by).orderBy("match", "area")
        return pairs.withColumn("nr", F.row_number().over(order)).join(largest, list(by)).select(*by, "nr", "match", "max_area", "matches")

    like = F.contains("_given", F.col("_g"))
    rows = p.groupBy(company, person).agg(F.count(F.lit(1)).alias("_n"), F.min("f").alias("f"), F.min("_g").alias("_g"))
    # one name: its owners are numbered once for all persons of that name, and bundles of both meet
    names = rows.where("_n = 1").select("f", "_g").distinct()
    known = numbered(names.join(o, "f").where(like), "f", "_g").withColumnsRenamed({"f": "_r_f", "_g": "_r_g"})
    met = known.select("_r_f", "_r_g").distinct().select(F.col("_r_f").alias("f"), F.col("_r_g").alias("_g"), "_r_f", "_r_g")
    single = of_all(met, rows.where("_n = 1").drop("_n"), known, ("f", "_g"), ("_r_f", "_r_g"))
    # several names, or a name given twice: the owners of all of them are numbered for that person
    several = p.join(rows.where("_n > 1").select(company, person), [company, person])
    out = [company, person, "nr", "match", "max_area", "matches"]
    return single.select(*out).unionByName(numbered(several.join(o, "f").where(like).select(company, person, "match", "area"), company, person).select(*out))


def hierarchy(edges: DataFrame, left: str, right: str, share: str, thresholds: tuple[float, ...], control: Column) -> DataFrame:
    """Edges with community_0, and for each threshold community_T: 'component_nr' of the strong edges inside it, numbered
    in the order of their smallest nodes; null where the edge is too weak. Strong: at least that share, or control.

    What is strong at a threshold is so at all lower ones. So from the highest on, each level's components begin at those
    of the level before, and each edge is worked on at one level only."""
    e, _ = stored(edges)
    strong = lambda t: F.coalesce((F.col(share) >= t) | control, F.lit(False))
    levels: dict[float, DataFrame] = {}
    found, taken = None, F.lit(False)
    for t in sorted(set(thresholds), reverse=True):
        found, _ = stored(components(e.where(strong(t) & ~taken), left, right, within=found))
        levels[t], taken = found, strong(t)
    whole, _ = stored(components(e.where(~taken), left, right, within=found))
    nodes = whole.withColumnRenamed("component", "community_0")
    for t, sub in levels.items():
        # a component's number inside community_0: its place among all, less the place of the first one there
        inside = whole.select(F.col("node").alias("_c"), F.col("component").alias("c0"))
        order = places(sub.select(F.col("component").alias("_c")).distinct().join(inside, "_c"), "c0", "_c")
        first = order.groupBy("c0").agg(F.min("place").alias("_f"))
        label = order.join(first, "c0").select("_c", F.concat_ws("_", "c0", (F.col("place") - F.col("_f") + 1).cast("string")).alias(f"_l{t:g}"))
        of = sub.join(label, F.col("component") == F.col("_c")).select("node", f"_l{t:g}")
        nodes = nodes.join(of, "node", "left")
    nodes, _ = stored(nodes)
    out = e.join(nodes.withColumnRenamed("node", left), left)
    return out.withColumns({f"community_{t:g}": F.when(strong(t), F.col(f"_l{t:g}")) for t in thresholds}).drop(*[f"_l{t:g}" for t in levels])
