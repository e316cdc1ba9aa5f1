"""Components inside components: each edge is worked on once, and rounds start from true sizes."""

import random

import pytest
from pyspark.sql import functions as F

from parzelle.operators import network, register

SCHEMA = "a string, b string, share double, ismanager string"


def least_of(edges):
    """Each node's smallest reachable one, by hand."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    return {x: top(x) for x in up}


def drawn(seed):
    r = random.Random(seed)
    rows = [(f"c{r.randrange(60):02}", f"s{r.randrange(70):02}", r.choice([None, 5.0, 20.0, 30.0, 70.0, 3.0, 1.0]), r.choice(["yes", *["no"] * 7])) for _ in range(110)]
    return [*rows, ("c90", "c90", 60.0, "no"), ("c91", None, 99.0, "no"), (None, "s91", 99.0, "no"), ("c05", None, 99.0, "no"), ("c92", "s92", 3.0, "no")]


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_hierarchy_by_hand(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(network.components, "__defaults__", (hot_rows, None))
    rows = drawn(3)
    strong = lambda t: [r for r in rows if (r[2] is not None and r[2] >= t) or r[3] == "yes"]
    whole_edges = lambda some: [r[:2] for r in some if r[0] is not None and r[1] is not None]
    whole = least_of(whole_edges(rows))
    labels = {}
    for t in (15, 25, 50):
        found = least_of(whole_edges(strong(t)))
        inside = {}
        for low in sorted(set(found.values())):
            inside.setdefault(whole[low], []).append(low)
        labels[t] = {x: f"{whole[low]}_{inside[whole[low]].index(low) + 1}" for x, low in found.items()}
    want = sorted((str(r[:2]), whole[r[0]], *[labels[t].get(r[0]) if r in strong(t) else None for t in (15, 25, 50)]) for r in rows if r[0] in whole)
    got = register.hierarchy(spark.createDataFrame(rows, SCHEMA), "a", "b", "share", (15, 25, 50), F.col("ismanager") == "yes").collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((str((g.a, g.b)), g.community_0, g.community_15, g.community_25, g.community_50) for g in got), key=key) == sorted(want, key=key)


def test_each_edge_is_worked_on_once(spark, monkeypatch):
    seen = []

    def counted(edges, *more, **named):
        seen.append(edges.count())
        return network.components(edges, *more, **named)

    monkeypatch.setattr(register, "components", counted)
    rows = drawn(4)
    register.hierarchy(spark.createDataFrame(rows, SCHEMA), "a", "b", "share", (15, 25, 50), F.col("ismanager") == "yes")
    assert sum(seen) <= len(rows)


def test_rounds_start_from_true_sizes(spark):
    """A chain takes many rounds; the estimate for the last of them must not have gone on multiplying."""
    chain = spark.range(100).select(F.format_string("n%04d", "id").alias("a"), F.format_string("n%04d", F.col("id") + 1).alias("b"))
    found = network.components(chain, "a", "b")
    assert {r.component for r in found.collect()} == {"n0000"}
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
