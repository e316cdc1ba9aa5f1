import random

import pytest

from parzelle.llm import crowds, hamming, nearcopies
from similar import closure, wanted
from test_nearcopies import classes, edited, table


def drifting(seed, steps, edits):
    """Each text differs from the one before in a few words: neighbours are near, the ends are not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    text = [word() for _ in range(200)]
    out = {}
    for i in range(steps):
        out[i] = " ".join(text)
        for _ in range(edits):
            text[r.randrange(200)] = word()
    return out


def of_one_group(spark, texts, cap):
    rows = spark.createDataFrame([(1, n, len(t.split()), t) for n, t in texts.items()], "g long, node long, weight long, text string").repartition(3)
    none = spark.createDataFrame([], "a long, b long")
    found = crowds.links(rows.select("g", "node", "weight"), rows.select("node", "text"), nearcopies.Sets(5, 0.8), cap, none)
    return [(r["a"], r["b"]) for r in found.collect()]


@pytest.mark.parametrize(("steps", "edits", "cap"), [(40, 2, 10**6), (40, 5, 600), (30, 12, 3000)])
def test_chains_of_near_texts(spark, steps, edits, cap):
    texts = drifting(steps * edits, steps, edits)
    assert closure(texts, of_one_group(spark, texts, cap)) == wanted(texts)


def test_strangers_and_copies_in_one_group(spark):
    r = random.Random(8)
    texts = edited(5, 2, 20) | {100 + i: " ".join(str(r.random()) for _ in range(50)) for i in range(30)}
    links = of_one_group(spark, texts, 900)
    assert closure(texts, links) == wanted(texts)
    assert all(a != b for a, b in links)


def test_pairs_of_a_crowd_are_few(spark):
    """A hundred copies of one text, each with a word of its own, link by references alone."""
    texts = {i: " ".join([f"w{k}" for k in range(120)] + [f"own{i}"]) for i in range(100)}
    links = of_one_group(spark, texts, 1000)
    assert len(set(closure(texts, links).values())) == 1
    assert len(links) <= crowds.REFERENCES * len(texts)


def test_prints_of_crowded_bands(spark):
    texts = edited(11, 3, 40) | {500 + i: t for i, t in drifting(2, 30, 6).items()}
    assert classes(table(spark, texts), hot=5, chunk=1500) == wanted(texts)


def test_shared():
    r = random.Random(1)
    import numpy as np

    for _ in range(200):
        x, y = (sorted(r.sample(range(30), r.randrange(1, 25))) for _ in "xy")
        assert nearcopies.shared(np.array(x, np.uint64), np.array(y, np.uint64)) == len(set(x) & set(y))


def test_nothing(spark):
    rows = spark.createDataFrame([], "g long, node long, weight long, text string")
    known = spark.createDataFrame([(1, 2)], "a long, b long")
    found = crowds.links(rows.select("g", "node", "weight"), rows.select("node", "text"), nearcopies.Sets(5, 0.8), 10, known)
    assert [tuple(x) for x in found.collect()] == [(1, 2)]
    assert hamming.components(found).count() == 2
