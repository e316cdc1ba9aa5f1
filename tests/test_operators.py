import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.functions import similarity, text as T
from parzelle.operators import classify, concentration as C, matching as M, network as N, relational as R, spatial as S
from parzelle.operators import ranks
from parzelle.operators.ranks import percentile_list, percentiles, places, ranked, ranked_any, ranked_by_ranges
from parzelle.sources import tables
from parzelle.streaming.windows import run_to_table, windowed_sums


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    v = lambda f, x: value(spark, f(F.col("t")), t=x)
    assert v(lambda t: T.drop_parts_with_word(t, "geb."), "muster, anna, geb. beispiel, weg 1, 11111 ort") == "muster, anna, weg 1, 11111 ort"
    assert [v(T.postcode, x) for x in ("hauptstr 1, 14467 stadt", "weg 2, 8001 ort", "ohne", "14467 münchen")] == ["14467", "8001", "", "14467"]
    assert [v(T.street, x) for x in ("hauptstr 1a, 14467 stadt", "weg 17, x", "ohne")] == ["hauptstr 1a", "weg 17", ""]
    assert [v(T.city, x) for x in ("hauptstr 1, 14467 stadt", "ohne")] == ["stadt", ""]
    assert [v(T.birth_date, x) for x in ("muster, anna, * 1950-01-02, weg 1", "muster")] == [" 1950-01-02", None]
    assert [v(lambda t: T.has_word(t, ["py"]), x) for x in ("python", "a,py b")] == [False, True]
    assert v(lambda t: T.has_any(t, ["py"]), "python") is True
    assert v(T.clean_addresses, "Haupt-Straße 1, 14467 Ort_hauptstrasse 1, 14467 ort_unbekannt_1 ort") == "haupt str 1, 14467 ort"
    assert v(T.clean_addresses, "unbekannt") == "unbekannt"
    assert v(lambda t: T.drop_word_and_next(t, "ot"), "stadt ot dorf mitte") == "stadt  mitte"
    assert v(lambda t: T.drop_street_word(t, ["weg"]), "gut hof birkenweg") == "gut hof "
    assert v(T.owners, "Muster, Anna, geb. Alt, * 1950-01-02, Weg 1, 11111 Ort\nHof GmbH") == ["muster, anna, * 1950-01-02", "hof gmbh"]
    assert v(T.owners, "  ") == ["unbekannt"]
    assert v(T.without_titles, "Hr. Dr. Max Muster") == "max muster"
    assert [v(T.age, x) for x in ("1950-01-02", "* 19500102", "no date", None)] == [70, 70, -9999, -9999]


def test_share_numbers(spark):
    found = [value(spark, N.share_number(F.col("t")), t=x) for x in ("12,5", ">50", "WO", "MO", "n.v.", None)]
    assert found[:2] == [12.5, pytest.approx(50.09999)] and found[2:] == [98.09999, 50.09999, None, None]


def test_classes(spark):
    names = {"Hof GmbH & Co. KG": "gmco", "Gut UG & Co KG": "ugco", "Acker AG und Co KG": "agco", "Hof & Co": "andco", "Muster, Max": "priv", "Max * 1950": "priv", "abc": "unbek", "Berliner Stadtgüter GmbH": "land", "Kirche": "kirch", "Stadt X": "gem", "A, GbR": "gbr", "Python eG": "eg"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = dict(df.select("n", classify.class_id(classify.normalised(F.col("n")))).collect())
    assert found == {n: classify.CLASS_IDS[k] for n, k in names.items()}


def test_similarity():
    assert similarity.winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro("", "a") == 0 and similarity.jaro("a", "a") == 1
    assert similarity.token_set_ratio("hof gmbh muster", "muster hof gmbh") == 100
    assert similarity.token_set_ratio("hof gmbh", "hof gmbh berlin") == 100

    def common(a, b):
        """Letters of the longest common stretch, the first in a and then in b, and of those to both sides of it."""
        n, i, j = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, 1 + min(len(a) - i, len(b) - j)) if a[i : i + n] == b[j : j + n]), default=(0, 0, 0))
        return n and n + common(a[:-i], b[:-j]) + common(a[n - i :], b[n - j :])

    def slow(a, b):
        return round(200 * common(a, b) / (len(a) + len(b)))

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(2))
        assert similarity.ratio(a, b) == slow(a, b)


def gini(x):
    return sum(abs(a - b) for a in x for b in x) / (2 * len(x) * sum(x))


@pytest.mark.parametrize("areas", [[1.0] * 4, [5.0], [1.0, 3.0], [1.0, 2.0, 3.0, 100.0], [2.0, 2.0, 2.0, 7.0, 1.5]])
def test_measures_of_small_units(spark, areas):
    df = spark.createDataFrame([("u", i, a) for i, a in enumerate(areas)] + [(None, 1, 9.0)], "unit string, owner long, area double")
    m = C.measures(df, "unit", "area", "owner").collect()
    assert len(m) == 1
    m, n, tot = m[0], len(areas), sum(areas)
    assert m["gini_coeff"] == pytest.approx(gini(areas), abs=1e-12)
    assert m["hhi"] == pytest.approx(sum((a / tot) ** 2 for a in areas) * 10000)
    assert m["theil_index"] == pytest.approx(sum(a / tot * math.log(a / tot * n) for a in areas), abs=1e-12)
    assert sum(m[c] for c in ("share_p100", "share_p95_99", "share_v19", "share_m50", "share_b40")) == pytest.approx(100)
    assert m["cr1"] <= m["cr3"] <= m["cr4"] <= m["cr5"] and m["owner5"] == ("None" if n < 5 else "4")
    if len(set(areas)) == 1:
        assert m["lac"] == pytest.approx(1) and m["rosenbluth_index"] == pytest.approx(1 / n)


def test_ranks_of_any_numbers(spark):
    r = random.Random(2)
    values = [r.choice([-1, 1]) * 10 ** r.uniform(-6, 9) for _ in range(500)] + [0.0] * 5 + [7.0] * 20
    rows = ranked(spark.createDataFrame(list(enumerate(values)), "id long, x double"), [], "x", "id").orderBy("i").collect()
    assert [row["x"] for row in rows] == sorted(values) and [row["i"] for row in rows] == list(range(1, len(values) + 1))
    assert rows[-1]["run"] == pytest.approx(sum(values)) and all(row["i"] + row["k"] == len(values) + 1 for row in rows)


def test_ranks_and_percentiles_leave_out_what_is_no_number(spark):
    values = [5.0, float("nan"), 0.5, None, 1.0, 1.0, 1.0, -3.0, 0.0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    known = sorted(v for v in values if v is not None and v == v)
    rows = ranked(df, [], "x", "id").orderBy("i").collect()
    assert [r["x"] for r in rows] == known
    shares = [0.0, 0.02, 0.3, 0.5, 0.77, 1.0]
    found = percentile_list(df, [], "x", shares).collect()[0]["cuts"]
    assert found == pytest.approx(list(np.quantile(known, shares)))
    groups = df.unionByName(df.withColumn("x", F.col("x") * 2)).withColumn("g", F.when(F.col("id") % 2 == 0, "e"))
    two = {r["g"]: r["cuts"] for r in percentile_list(groups, ["g"], "x", shares).collect()}
    for g, k in (("e", 0), (None, 1)):
        part = [v * f for i, v in enumerate(values) for f in (1, 2) if i % 2 == k and v is not None and v == v]
        assert two[g] == pytest.approx(list(np.quantile(part, shares)))
    assert [tuple(r) for r in percentiles(df.where("id < 0"), [], "x", {"a": 0.1, "b": 0.9}).collect()] == [(None, None)]
    assert percentiles(groups.where("id < 0"), ["g"], "x", {"a": 0.1}).count() == 0


def test_places_of_names_that_begin_alike(spark):
    names = [f"Customer#{i:09d}" for i in range(15_000)]
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, len(names))], "n string")
    found = places(df, "n")
    assert [r["n"] for r in found.orderBy("place").collect()] == names and found.agg(F.min("place"), F.max("place")).first()[:] == (1, 15_000)
    # sampled ranges, none with most of the rows
    parts = df.repartitionByRange(4, "n").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 7_000


def test_weighted_measures_against_sorting(spark):
    r = random.Random(8)
    rows = [(u, i, r.choice([0.0, 1.0, r.uniform(0, 1e6)]), float(r.randrange(1, 6))) for u in "ab" for i in range(60)]
    found = {x["unit"]: x for x in C.weighted(spark.createDataFrame(rows, "u string, id long, x double, w double"), "u", "x", "w", "id").collect()}
    for u in "ab":
        each = sorted((x, i, w) for k, i, x, w in rows if k == u)
        cw, cx = np.cumsum([w for _, _, w in each]), np.cumsum([x * w for x, _, w in each])
        assert found[u]["gini"] == pytest.approx(sum(cx[1:] * cw[:-1] - cx[:-1] * cw[1:]) / cx[-1] / cw[-1], abs=1e-12)
        total = sum(x for x, _, _ in each)
        assert found[u]["hhi"] == pytest.approx(sum((x / total) ** 2 * w for x, _, w in each) * 10000)


def test_joined_names_of_large_groups_are_null(spark):
    df = spark.createDataFrame([("a", f"n{i}") for i in range(5)] + [("b", "x"), ("b", "x"), ("c", None)], "k string, v string")
    assert {r["k"]: (r["n"], r["names"]) for r in R.joined(df, "k", "v", "|", 4).collect()} == {"a": (5, None), "b": (1, "x")}


def test_rank_percent(spark):
    pct = lambda k, n: spark.range(1).select(C.rank_percent(F.lit(k), F.lit(n)).alias("v")).first()["v"]
    assert [pct(1, 1), pct(1, 2), pct(2, 2), pct(2, 101), pct(101, 101)] == [50, 1, 100, 1, 100]


def test_area_split_and_stretch(spark):
    parcels = spark.createDataFrame([(1, 100.0), (2, 10.0)], "p long, area double")
    owners = spark.createDataFrame([(1, x) for x in "abcd"], "p long, owner string")
    assert sorted((r["p"], r["owner"], r["area"]) for r in R.split_area(parcels, owners, "p", "area").collect() if r["p"] == 1) == [(1, x, 25.0) for x in "abcd"]
    assert R.split_area(parcels, owners, "p", "area").where("p = 2 and area is null").count() == 1
    rows = spark.createDataFrame([(90.0, ["a", "(mehrere)", "b"], ["x", "y", "z"])], "area double, names array<string>, others array<string>")
    assert [tuple(r) for r in R.stretch(rows, "names", "others", "(mehrere)", ["area"]).collect()] == [(45.0, 2, "a", "x"), (45.0, 2, "b", "z")]


def test_canonical_names_against_a_loop(spark):
    r = random.Random(3)
    words = ["hof", "gut", "muster", "acker", "wiese", "gmbh", "kg"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(120)})
    freq = {n: r.randrange(1, 6) for n in names}
    want = {}
    for i, n in enumerate(names):
        group = [n] + [m for m in names[i + 1 : i + 20] if similarity.token_set_ratio(n, m) > 80]
        want[n] = max(group, key=lambda m: (freq[m], -names.index(m)))
    found = M.canonical_names(spark.createDataFrame(list(freq.items()), "name string, n long"), "name", "n", 80)
    assert {row["name"]: row["canonical"] for row in found.collect()} == want


def test_networks(spark):
    e = spark.createDataFrame([("a", "b", 60.0, "no", "mother company"), ("b", "c", 60.0, "no", "mother company"), ("x", "y", 30.0, "no", "holder"), ("x", "z", 70.0, "no", "holder"), ("m", "n", 1.0, "yes", "holder"), ("p", "q", None, "yes", "holder")], "a string, b string, share double, ismanager string, function string")
    assert N.strong_edges(e, 50).count() == 4 and N.strong_edges(e, 0).count() == 6
    labels = N.components(e, "a", "b")
    found = e.join(labels.withColumnRenamed("node", "a"), "a")
    owner = {r["component"]: r["owner"] for r in N.ultimate_owners(found, "component", "a", "b").collect()}
    assert owner["a"] == "c" and owner["x"] == "z"
    assert {r["component"]: r["depth"] for r in N.depth(found, "component", "a", "b").collect()}["a"] == 2
    held = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("t", "c3"), ("u", "c2"), ("u", "c4")], "m string, k string")
    assert dict(N.bridge(held, "m", "k").collect()) == {"c1": "c1", "c2": "c1", "c3": "c3", "c4": "c1"}


def test_long_chains_are_one_component(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(150)]
    random.Random(4).shuffle(edges)
    found = N.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert len(found) == 151 and {r["component"] for r in found} == {"0000"}


def test_places(spark):
    km = spark.range(1).select(S.haversine(F.lit(52.5), F.lit(13.4), F.lit(48.1), F.lit(11.6)).alias("v"), S.haversine(F.lit(95.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("w")).first()
    assert km["v"] == pytest.approx(505, abs=3) and km["w"] is None
    point = spark.createDataFrame([("POINT (13.5 -52)",), ("junk",), (None,)], "t string").select(*S.point_of(F.col("t"))).collect()
    assert [tuple(p) for p in point] == [(13.5, -52.0), (None, None), (None, None)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", 1.5), (2, None, float("nan"))], "a long, b string, c double")
    tables.write_csv(tables.without_nan(df), str(tmp_path / "t.csv"), encoding="ISO-8859-1")
    back = tables.read_table(spark, str(tmp_path / "t.csv"), "a long, b string, c double", sep=";", encoding="ISO-8859-1")
    assert sorted(map(tuple, back.collect())) == [(1, "ä", 1.5), (2, None, None)]
    assert tables.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b", "c"]
    (tmp_path / "d.json").write_text('{"x": "1", "y": {"z": 2}}')
    assert dict(tables.lookup(spark, str(tmp_path / "d.json")).collect()) == {"x": "1", "y": '{"z":2}'}
    names = spark.createDataFrame([(f"n{i % 25:02d}",) for i in range(60)], "n string")
    tables.write_chunks(names, "n", str(tmp_path / "chunks"), 10)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == ["chunk=1", "chunk=2", "chunk=3"]
    (tmp_path / "w.txt").write_text("und\nab\nacker\n")
    assert sorted(r[0] for r in tables.word_list(spark, str(tmp_path / "w.txt"), ["extra"]).collect()) == ["acker", "extra", "und"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xls")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run_to_table(windowed_sums(stream, "ts", "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    done = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r["start"], r["event_type"]): r["n"] for r in windowed_sums(events, "ts", "event_type", "value").collect()}
    assert done and done.items() <= whole.items()


def test_mappings_are_followed_to_the_end(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(100)]  # a chain that ends at c100
    pairs += [("z2", "z0"), ("z0", "z1"), ("z1", "z2"), ("a0", "z1"), ("a1", "a0")]  # a cycle, and names that lead into it
    pairs += [("s", "s"), ("n0", "n1"), ("n1", None)]
    random.Random(5).shuffle(pairs)
    found = M.resolved(spark.createDataFrame(pairs, "x string, y string"), "x", "y").collect()
    want = {f"c{i:03d}": "c100" for i in range(100)} | dict.fromkeys(["z0", "z1", "z2", "a0", "a1"], "z0") | {"s": "s", "n0": "n1", "n1": None}
    assert len(found) == len(pairs) and {r["old"]: r["new"] for r in found} == want


def test_bridge_query_reads_all_rows(spark, tmp_path):
    from parzelle.queries import queries

    rows = [(1, 11, 1.0), (1, 12, 48.0), (2, 12, 50.0), (2, 13, 49.0), (3, 14, 7.0), (3, 15, 50.0), (4, 16, 3.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["component"]: r["merged"] for r in queries()["gra_bridge"](spark, str(tmp_path)).collect()}
    assert found == {"11": "11", "12": "11", "13": "11", "14": "14", "15": "14", "16": "16"}


def test_sources_of_relations_by_company(spark):
    """Every set of sources, with parents that are equal, different, or the company itself, against a loop over companies."""
    kinds = ["CSH", "KMn", "KMg", "ATE", "TGS", "TGS2", "MAN"]
    rows, want = [], set()
    for i in range(2 ** len(kinds)):
        for variant, (national, world) in enumerate([("n", "g"), ("n", "n"), ("far", "far"), ("self", "g"), ("self", "self")]):
            me = f"c{i}_{variant}"
            has = [k for j, k in enumerate(kinds) if i >> j & 1]
            own = {"CSH": [("near", 1), ("far", 2)], "KMn": [(national, 1)], "KMg": [(world, 1)]}
            of = {k: [(me if n == "self" else n, d) for n, d in own.get(k, [("near", 0), (k, 0)])] for k in has}
            rows += [(me, n, k, d, float(len(k)), "yes" if k == "TGS" else "no", "ort" if k == "MAN" else "") for k in has for n, d in of[k]]
            kept, mother = [], None
            if "CSH" in has:
                kept, mother = of["CSH"], "far"
            elif "KMn" in has:
                mother = of["KMn"][0][0]
                kept = of["KMn"] if mother != me else []
            kept = [(n, "CSH" if "CSH" in has else "KMn") for n, _ in kept]
            if "KMg" in has and of["KMg"][0][0] not in (mother, me):
                kept.append((of["KMg"][0][0], "KMg"))
            for k in ("ATE", "TGS", "TGS2", "MAN"):
                for n, _ in of.get(k, []):
                    if n not in [x for x, _ in kept]:
                        kept.append((n, k))
            want |= {(me, n, k) for n, k in kept}
    df = spark.createDataFrame(rows, "company string, connection string, attribute string, distance int, share double, ismanager string, location string")
    found = N.merged_relations(N.preferred_sources(df), kinds).collect()
    assert {(r["company"], r["connection"], r["attribute"]) for r in found} == want and len(found) == len(want)
    near = {r["company"]: r for r in found if r["connection"] == "near"}
    assert near["c127_0"]["share"] == 4.0 and near["c127_0"]["ismanager"] == "yes" and near["c127_0"]["location"] == "ort"


def test_ranks_with_very_many_equal_values(spark, monkeypatch):
    rows = [(g, float(v), f"t{t:05d}") for t, (g, v) in enumerate([(i % 3 if i % 5 else None, 7 if i % 4 else i % 11 - 3) for i in range(3000)])] + [(1, None, "x"), (1, float("nan"), "y")]
    df = spark.createDataFrame(rows, "g long, v double, t string").repartition(5)
    plain = lambda d: {(r["g"], r["t"]): (r["i"], r["k"], r["n"], round(r["tot"], 6), round(r["run"], 6)) for r in d.collect()}
    want = plain(ranked(df, ["g"], "v", "t"))
    assert len(want) == 3000 and plain(ranked_by_ranges(df, ["g"], "v", "t")) == want
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    assert plain(ranked_any(df, ["g"], "v", "t")) == want
    assert plain(ranked_by_ranges(df.drop("g"), [], "v", "t").withColumn("g", F.lit(0))) == plain(ranked(df.drop("g"), [], "v", "t").withColumn("g", F.lit(0)))
    # rows of one value lie in several ranges
    same = spark.range(40_000).select(F.lit(1.0).alias("v"), F.col("id").alias("t"))
    order = [F.col("v"), F.col("t").desc()]
    sizes = [r["count"] for r in same.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 15_000


def test_measures_read_their_input_once(spark):
    """What is read more than once is stored: no plan goes back to the parcels."""
    parcels = spark.range(2000).select((F.col("id") % 3).alias("u"), (F.col("id") % 50).alias("o"), (F.col("id") % 17 + 1.5).alias("a"), (F.col("id") % 9 + 1).alias("x"), (F.col("id") % 7 + 1).alias("y"))
    for df in (C.measures(parcels, "u", "a", "o"), C.moving_window(parcels, "a", "o", "x", "y", ["cr1"])):
        assert "Range (" not in df._jdf.queryExecution().executedPlan().toString()


def test_components_with_hubs_and_a_giant(spark):
    """Hubs and a giant component, joined in parts, give the labels of the plain joins."""
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 404)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(40)] + [(290, 402), (None, 3), (5, None), (3000, 3000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    plain = lambda d: {x["node"]: x["component"] for x in d.collect()}
    want = plain(N.components(df, "a", "b"))
    assert plain(N.components(df, "a", "b", hot_rows=0)) == want and want[404] == 0 and want[3000] == 3000
    hot = N.hot_keys(df, "a", len(edges)).collect()
    assert 0 in {x["hot"] for x in hot}
