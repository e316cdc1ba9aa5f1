import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.llm import nearcopies
from similar import closure, jaccard, wanted

SF = "/root/testdata/sf0.001"


def edited(seed, groups, members):
    """Texts of 240 words (similarity to the first 0.88 at least); members of a group differ from its first in a few words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    out = {}
    for g in range(groups):
        base = [word() for _ in range(240)]
        for m in range(members):
            text = list(base)
            for _ in range(m % 4):
                text[r.randrange(240)] = word()
            out[g * members + m] = " ".join(text)
    return out


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)


def classes(df, **kw):
    rows = nearcopies.near_copies(df, **kw).collect()
    return {r["doc_id"]: r["component_id"] for r in rows}


def test_table_against_all_pairs(spark, docs, plain):
    assert classes(docs) == wanted(plain)


@pytest.mark.parametrize(("hot", "chunk"), [(20_000, 2_000_000), (7, 2000), (2, 500)])
def test_hot_groups_lose_no_link(spark, hot, chunk):
    texts = edited(3, 6, 25)
    found = classes(table(spark, texts), hot=hot, chunk=chunk)
    assert found == wanted(texts)
    assert len(set(found.values())) == 6


def test_estimate_is_near_the_similarity():
    r = np.random.default_rng(5)
    for union in (5, 6, 10, 17, 40, 200, 1500):
        for share, want in ((0.1, False), (0.8, True), (0.9, True)):
            u = r.integers(0, 2**64, size=union, dtype=np.uint64)
            shared = round(union * share)
            a, b = np.unique(u[: shared + (union - shared) // 2]), np.unique(np.concatenate([u[:shared], u[shared + (union - shared) // 2 :]]))
            (x, kx), (y, ky) = nearcopies.sketch(a), nearcopies.sketch(b)
            assert not want or len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.75
            assert bool(nearcopies.alike(x, y, float(len(a)), float(len(b)), 0.8)) is want
            assert not want or (kx == ky).any()


def test_forest_spans_the_classes_of_a_group():
    texts = edited(9, 5, 30)
    found = [nearcopies.describe(t.encode(), 5, 42) for t in dict.fromkeys(texts.values())]
    prints = np.stack([np.frombuffer(f[3], np.uint64) for f in found])
    sizes = np.array([f[1] for f in found])
    a, b = nearcopies.forest(prints, sizes, 0.8)
    pairs = [(i, j) for i, j in combinations(range(len(found)), 2) if nearcopies.alike(prints[i], prints[j], float(sizes[i]), float(sizes[j]), 0.8)]
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= set(pairs)
    want = closure(range(len(found)), pairs)
    assert closure(range(len(found)), zip(a.tolist(), b.tolist(), strict=True)) == want
    assert len(a) == len(found) - len(set(want.values()))


def test_exact_forest_spans_the_classes():
    r = random.Random(4)
    for _ in range(50):
        sets = [np.array(sorted(r.sample(range(14), r.randrange(1, 14))), np.uint64) for _ in range(r.randrange(2, 30))]
        a, b = nearcopies.exact_forest(sets, 0.8)
        plain_sets = {i: set(x.tolist()) for i, x in enumerate(sets)}
        want = closure(plain_sets, [(i, j) for i, j in combinations(plain_sets, 2) if jaccard(plain_sets[i], plain_sets[j]) >= 0.8])
        assert closure(plain_sets, zip(a, b, strict=True)) == want
        assert len(a) == len(sets) - len(set(want.values()))


def test_odd_rows(spark, odd, none):
    rows = nearcopies.near_copies(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert found == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9}
    assert sorted((r["component_id"] for r in rows if r["doc_id"] is None), key=str) == [2, None]
    assert nearcopies.near_copies(none).count() == 0
    with pytest.raises(ValueError):
        nearcopies.near_copies(odd, similarity=0)


def test_words_and_case(spark):
    texts = {1: "a b c", 2: "A  b\tC", 3: "a b", 4: "\xa0a b c"}
    assert classes(table(spark, texts)) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_an_id_with_several_texts(spark):
    import corpus_pipeline

    rows = [(3, "y y2 y3 y4 y5 y6"), (9, "x x2 x3 x4 x5 x6"), (9, "y y2 y3 y4 y5 y6"), (10, "y y2 y3 y4 y5 y6"), (11, "x x2 x3 x4 x5 x6")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(docs).collect())
    assert found == [(3, 3), (9, 3), (9, 9), (10, 3), (11, 9)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [3, 9]


def kept(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())


def test_each_class_keeps_one_row_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    x, y, z = (" ".join(k + w for w in words) for k in "xyz")
    short = "y y2 y3 y4 y5 y6"
    # the class of x is headed by 9, whose shorter text is of another class
    assert kept(spark, [(3, short), (9, x), (9, short), (11, x)]) == [(3, short), (9, x)]
    # many texts under one id, and a repeated row
    many = [(7, f"{a} {x}"[:80] + str(a) * 9) for a in range(12)]
    assert kept(spark, [*many, many[0]]) == sorted(many)
    # an id that heads two classes; the like text of 3 ties y to itself alone, not to x
    assert kept(spark, [(3, y + " end"), (9, y), (9, x), (11, x), (12, x + " end")]) == [(3, y + " end"), (9, x)]
    assert kept(spark, [(9, y), (9, x), (11, x + " end"), (12, y + " end"), (13, z)]) == sorted([(9, x), (9, y), (13, z)])
    # one class, its head with two texts of it
    assert len(kept(spark, [(9, x), (9, x + " end"), (10, x)])) == 1


def test_classes_of_an_id_with_several_texts(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    df = spark.createDataFrame([(3, y + " end"), (9, y), (9, x), (11, x)], "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.near_copies(df).collect())) == [(3, 3), (9, 3), (9, 9), (11, 9)]


def test_rows_without_an_id_and_clashing_columns(spark):
    import corpus_pipeline

    x, y, z = (" ".join(f"{k}{i}" for i in range(60)) for k in "xyz")
    rows = [(None, x), (None, x), (None, x + " end"), (5, y), (None, y), (None, z), (None, None), (7, ""), (None, z)]
    docs = spark.createDataFrame([(i, t, "keep", 3, "s", "w", i) for i, t in rows], "doc_id long, text string, _nth string, nth int, which string, id string, HELD long").repartition(4)
    found = corpus_pipeline.near_dedup(spark, docs, SF)
    assert found.columns == docs.columns
    found = found.collect()
    assert all(r["_nth"] == "keep" and r["nth"] == 3 and r["which"] == "s" and r["id"] == "w" for r in found)
    texts = {(r["doc_id"], r["text"]) for r in found}
    assert len(found) == len(texts) == 4
    assert {(5, y), (7, ""), (None, z)} <= texts and (texts - {(5, y), (7, ""), (None, z)}) < {(None, x), (None, x + " end")}
    # each text is in a class of which exactly one text is kept
    classes = wanted(dict(enumerate(t for _, t in rows)))
    assert len(set(classes.values())) == 4
    # classes: a null id names one only where nobody has an id
    ids = {(r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()}
    assert ids == {(None, None), (5, 5), (None, 5), (7, 7), (None, 7)}


def test_a_row_repeated_very_often(spark):
    x = " ".join(f"x{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("1 AS doc_id").withColumn("text", F.lit(x)).union(spark.createDataFrame([(2, x + " end"), (3, "other")], "doc_id long, text string"))
    rows = nearcopies.heads(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 3]
