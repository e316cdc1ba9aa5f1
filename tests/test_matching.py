"""Scores of names, fuzzy joins against all pairs, classes of hand-picked names."""

import random

import pytest
from pyspark.sql import functions as F

from parzelle.functions import similarity, text as T
from parzelle.operators import classify, matching as M
from parzelle.queries import queries

SF = "/root/testdata/sf0.001"


def test_scores_of_fixed_pairs():
    assert similarity.ratio("this is a test", "this is a test!") == 97
    assert similarity.partial_ratio("this is a test", "this is a test!") == 100
    assert similarity.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 91
    assert similarity.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert similarity.token_sort_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 84
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert similarity.weighted_ratio("cowboys", "Dallas Cowboys") == 90
    assert similarity.weighted_ratio("new york jets", "New York Jets") == 100
    assert similarity.weighted_ratio("a", "a very long name of more than eight times") == 60
    assert similarity.weighted_ratio("", "x") == similarity.weighted_ratio("ä", "ä") == 0


def names(seed, n):
    r = random.Random(seed)
    parts = ["muster", "mustermann", "hof", "gut", "gmbh", "kg", "anna", "max", "agrar", "acker", "a"]
    return [" ".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(n)]


def test_bound_of_jaro_winkler():
    """Never below the score, so no pair is lost; and it rules out nearly all pairs that aren't alike."""
    r = random.Random(12)
    texts = names(3, 150) + ["".join(r.choices("abcdeäöü 🙂", k=r.randrange(0, 12))) for _ in range(150)] + ["martha", "marhta", "dixon", "dicksonx", ""]
    pairs = [(a, b) for a in texts for b in texts]
    bound = similarity.winkler_bound([a for a, _ in pairs], [b for _, b in pairs])
    scores = [similarity.winkler(a, b) for a, b in pairs]
    assert all(s <= x + 1e-9 for s, x in zip(scores, bound, strict=True))
    alike, scored = sum(s >= 0.93 for s in scores), sum(x >= 0.93 for x in bound)
    assert alike <= scored < 0.05 * len(pairs)


def test_jaro_winkler_from_a_threshold(spark):
    rows = [(a, b) for a in names(4, 30) + [None, ""] for b in names(5, 30) + [None, ""]]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(similarity.jaro_winkler_from(0.8)(F.col("a"), F.col("b")).alias("v"), "a", "b").collect()
    for r in found:
        want = similarity.winkler(r["a"], r["b"]) if None not in (r["a"], r["b"]) else 0
        assert r["v"] == (pytest.approx(want) if want >= 0.8 else None)


@pytest.mark.parametrize("patterns", [50_000, 7])
def test_parts_of_names_by_automata(spark, monkeypatch, patterns):
    monkeypatch.setattr(M, "PATTERNS", patterns)
    people = [(f, x) for f, x in zip(["an", "max", "eva", "Hof", None] * 8, ["muster", "hof", "GUT", "a", "x", "kg", "", None, "ack", "er m"] * 4, strict=True)]
    texts = [*names(7, 60), "Muster GmbH an", None, ""]
    found = M.parts_containing(spark.createDataFrame(people, "f string, l string"), spark.createDataFrame([(t,) for t in texts], "n string"), "f", "l", "n")
    want = {(f, x, t) for f, x in people for t in texts if f is not None and x and t is not None and x.lower() in t.lower() and f.lower() in t.lower()}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


@pytest.mark.parametrize("block", [5000, 3])
def test_best_in_block_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    left = [(i, i % 3, n, 85 if i % 2 else 70) for i, n in enumerate(names(1, 80))] + [(900, None, "hof", 70), (901, 0, None, 70)]
    right = [(i % 3, n) for i, n in enumerate(names(2, 80))] + [(0, None), (None, "hof")]
    a, b = spark.createDataFrame(left, "id long, k long, name string, least long"), spark.createDataFrame(right, "k long, name string")

    def want(score, limit, strict):
        out = {}
        for i, k, n, least in left:
            found = sorted((-score(n, m), m) for j, m in set(right) if k is not None and j == k and n and m)
            s, m = found[0] if found else (0, None)
            ok = m is not None and (-s > limit(least) if strict else -s >= limit(least))
            out[i] = (m, -s) if ok else (None, None)
        return out

    got = M.best_in_block(a, b, "k", "name", "least", similarity.weighted, strict=True).collect()
    assert {r["id"]: (r["match"], r["score"]) for r in got} == want(similarity.weighted_ratio, lambda x: x, True)
    exact = lambda x, y: round(similarity.winkler(x, y), 9)
    got = M.best_in_block(a, b, "k", "name", 0.93, lambda x, y: F.round(similarity.jaro_winkler(x, y), 9), shortest=0.65).collect()
    assert {r["id"]: (r["match"], r["score"]) for r in got} == want(exact, lambda _: 0.93, False)


@pytest.mark.parametrize(("name", "strict"), [("jn_block_weighted", False), ("jn_accept_by_class", True)])
def test_weighted_queries_against_all_pairs(spark, name, strict):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size", "p_name").collect()
    found = {r["p_partkey"]: (r["match"], r["score"]) for r in queries()[name](spark, SF).collect()}
    for p in parts:
        if p["p_partkey"] % 2:
            continue
        scored = sorted({(-similarity.weighted_ratio(p["p_name"], q["p_name"]), q["p_name"]) for q in parts if q["p_partkey"] % 2 and q["p_size"] == p["p_size"]})
        least = 85 if not strict or p["p_partkey"] % 4 == 0 else 70
        ok = scored and (-scored[0][0] > least if strict else -scored[0][0] >= least)
        assert found.pop(p["p_partkey"]) == ((scored[0][1], -scored[0][0]) if ok else (None, None))
    assert not found


def test_forward_window_query_against_a_loop(spark):
    counts = {r["p_name"]: r["count"] for r in spark.read.parquet(f"{SF}/part.parquet").groupBy("p_name").count().collect()}
    order = sorted(counts)
    found = {r["name"]: r["canonical"] for r in queries()["win_fwd20"](spark, SF).collect()}
    for i, n in enumerate(order):
        group = [n] + [m for m in order[i + 1 : i + 20] if similarity.token_set_ratio(n, m) > 70]
        assert found[n] == max(group, key=lambda m: (counts[m], -order.index(m)))


def test_classes_of_fixed_names(spark):
    """Independent of the rules' table: names and the classes that they should have."""
    want = {
        "Müller, Anna": "priv", "Muster, Max * 1950-01-02": "priv", "Acker GmbH": "gmbh", "Acker GmbH & Co. KG": "gmco", "Hof AG & Co KG": "agco", "Gut UG (haftungsbeschränkt) & Co KG": "ugco", "Feld und Co": "andco",
        "Agrargenossenschaft Dorf eG": "eg", "Landwirtschaft Dorf KG": "kg", "Acker AG": "ag", "Muster GbR": "gbr", "Meier OHG": "ohg", "Hof UG": "ug", "Agri Holding": "lim", "Holz SE": "se", "Kirchgemeinde Dorf": "kirch", "Evangelische Pfarre": "kirch",
        "Sportverein Dorf": "ev", "Naturschutzbund": "ev", "Stiftung Wald": "stift", "BVVG Bodenverwertungs- und -verwaltungs GmbH": "bvvg", "Land Brandenburg": "land", "Landkreis Dorf": "land", "Bundesrepublik Deutschland": "bund", "Gemeinde Dorf": "gem",
        "Stadt Potsdam": "gem", "Wasserverband Süd": "zweck", "Eigentum des Volkes": "verg", "unbekannt": "unbek", "Erbengemeinschaft nach Muster": "erben", "gemeinnützige Hof GmbH": "gemeinn", "Berliner Stadtgüter GmbH": "land", "irgendwer": "unbek",
    }
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", classify.normalised(F.col("n")).alias("c")).select("n", classify.class_id(F.col("c")).alias("k")).collect()
    names_of = {v: k for k, v in classify.CLASS_IDS.items()}
    assert {r["n"]: names_of[r["k"]] for r in rows} == want


def test_text_functions_take_nulls_and_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), (",",), ("_",), ("(a[*", ), ("x, y_z, q und r",)], "t string")
    t = F.col("t")
    one, two = T.shortest_two(t)
    cols = [T.addresses_of(t, t), T.without_nobility(t, ["von"]), T.drop_word_and_next(t, ["bei", "ot"]), one, two, T.padded_postcode(t), *T.separated(t, 3), T.rule_chain(t, [("a", "b")]), F.array_join(T.by_length(F.split(t, " ")), " ")]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
    assert len(rows) == 7 and all(x is None or isinstance(x, str) for r in rows for x in r)
    assert rows[5][0] == T.NO_ADDRESS and tuple(rows[6][6:9]) == ("x", "y_z", "q und r")
