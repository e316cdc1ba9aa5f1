"""Work that grows with the input only, and is dealt to many tasks."""

from pyspark.sql import functions as F

from parzelle.operators import network as N, register as G, reports as P, spatial as S
from parzelle.plans import reports as L
from parzelle.plans.registry import Tables
from parzelle.queries import queries


def test_components_store_less_each_round(spark, monkeypatch):
    stored, durable = [], N.durable

    def counting(df):
        out = durable(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(N, "durable", counting)
    chain = spark.range(1, 1000).select(F.format_string("n%04d", "id").alias("a"), F.format_string("n%04d", F.col("id") + 1).alias("b"))
    extra = spark.createDataFrame([("x", "x"), ("z", "y"), (None, "y")], "a string, b string")
    found = {r["node"]: r["component"] for r in N.components(chain.unionByName(extra), "a", "b").collect()}
    assert len(found) == 1003 and {v for k, v in found.items() if k[0] == "n"} == {"n0001"}
    assert (found["x"], found["y"], found["z"]) == ("x", "y", "y")
    assert stored[0] == 1001 and stored[2] < stored[0]
    assert max(stored) <= 1003  # all labels and twice the edges were stored each time before


def test_owner_matches_of_one_name_are_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 3)
    people = [("c%d" % (k % 5), "p%d" % k, "f%d" % (k % 2), ("an", "max", "eva-maria")[k % 3]) for k in range(30)]
    people += [("c0", "p0", "f1", "max"), ("c1", "p1", "f1", "max"), ("c1", "p1", "f1", "max"), (None, "p", "f1", "an"), ("c9", "p9", None, "an"), ("c9", "p8", "f1", "")]
    owners = [("o%d" % k, "a%d" % (k % 4), "f%d" % (k % 3), ("anna", "maxim", "eva", "jo")[k % 4], float(k) if k % 7 else None) for k in range(60)]
    p = spark.createDataFrame(people, "company string, person string, family string, given string")
    o = spark.createDataFrame(owners, "owner string, address string, family string, given string, area double")
    got = G.owner_matches(p, o, "company", "person", "family", "given", "owner", "address", "area")
    want = {}
    for company, person, family, given in people:
        name = given.split("-")[0]
        hits = [(f"{w}_{a}", area) for w, a, f, g, area in owners if company and f == family and name and name in g]
        want[company, person] = want.get((company, person), []) + hits
    rows = set()
    for (company, person), hits in want.items():
        most = max((a for _, a in hits if a is not None), default=None)
        for i, (match, _) in enumerate(sorted(hits, key=lambda h: (h[0], -1 if h[1] is None else h[1]))):
            rows.add((company, person, i + 1, match, most, len(hits)))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows) and set(found) == rows
    plan = got._jdf.queryExecution().toString()
    assert "explode" in plan.lower()  # each person's owners were sorted and numbered anew before


def test_raw_entries_are_dealt(spark):
    found = queries()["own_from_raw"](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_frames_of_holders_are_dealt_by_rows(spark, monkeypatch):
    whole = sorted(queries()["rep_distance_heat"](spark, "/root/testdata/sf0.001").collect(), key=str)
    monkeypatch.setattr(P, "TASK_ROWS", 100, raising=False)
    heat = queries()["rep_distance_heat"](spark, "/root/testdata/sf0.001")
    assert ", 60), REPARTITION_BY_NUM" in heat._jdf.queryExecution().executedPlan().toString()  # as many tasks as a shuffle has before, or fewer
    assert sorted(heat.collect(), key=str) == whole
    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large
    try:
        frame = L.dealt(t)
        assert frame.columns == L.report(t).columns and sorted(map(str, frame.collect())) == sorted(map(str, L.report(t).collect()))
        sizes = [r["count"] for r in frame.where("owner IS NOT NULL").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("count"), F.max("number_people"), F.sum("area")).collect()]
        assert sum(sizes) == t.lineitem.count() and max(sizes) < 200
        for most, tasks in ((100_000, 20), (200, 30)):  # more rows in a task rather than more than MANY tasks, up to a bound
            monkeypatch.setattr(P, "MANY", 20)
            monkeypatch.setattr(P, "MOST_ROWS", most)
            assert L.dealt(t).rdd.getNumPartitions() == tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heat_works_on_the_frame_once(spark):
    heat = queries()["rep_distance_heat"](spark, "/root/testdata/sf0.001")
    assert heat._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4  # 8 before: orders, lineitem, supplier, nation twice


def test_heat_counts_each_holder_in_its_class_and_in_all(spark):
    rows = [("a", 1, 1.0, "x", 5.0), ("a", 1, 1.0, "w", 25.0), ("a", 2, 1.0, "x", None), ("b", 1, 1.0, "x", 400.0), ("c", 1, 1.0, None, 0.0), ("d", 1, 1.0, "ALL", 11.0), (None, 1, 1.0, "x", 5.0)]
    df = spark.createDataFrame(rows, "owner string, parcel long, area double, category string, distance double")
    found = {r["category"]: tuple(r)[1:] for r in P.distance_heat(df, "owner", "distance").collect()}
    one = lambda k: (1, *(100.0 if i == k else 0.0 for i in range(6)))
    assert found == {"w": one(1), "x": one(4), None: one(5), "ALL": (5, 0.0, 60.0, 0.0, 0.0, 20.0, 20.0)}  # d is in ALL by its own class, too
