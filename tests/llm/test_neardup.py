import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from parzelle.llm import hamming, neardup, queries
from similar import wanted

SF = "/root/testdata/sf0.001"


def slow_print(text, words=4):
    parts = text.encode().lower().split()
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius=4):
    """id -> smallest id reachable, from all pairs."""
    root = {i: i for i, _ in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in prints}


def test_query_against_all_pairs(spark, plain):
    prints = [(i, slow_print(t)) for i, t in plain.items()]
    want = slow_classes(prints)
    rows = queries.op10_simhash_neardup(spark, SF).collect()
    assert len(rows) == len(plain)
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (p, want[i]) for i, p in prints}


def test_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert found[1]["component_id"] == found[5]["component_id"] == 1
    assert {found[i]["fp"] for i in (2, 3, 4)} == {0} and {found[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fp"] == 0] == [2]
    assert neardup.near_duplicates(none).count() == 0


def chains(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 30)):
            out.add(x)
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
    return sorted(out)


@pytest.mark.parametrize(("hot", "extra"), [(100_000, 2), (5, 2), (3, 1), (100_000, 3)])
def test_links_join_the_same_classes_as_all_pairs(spark, hot, extra):
    prints = chains(hot + extra, 400) + [(1 << 60) | i for i in range(60)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {tuple(x) for x in hamming.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, extra, hot).collect()}
    bits = {s: p for s, p in zip(signed, prints, strict=True)}
    assert all((bits[a] ^ bits[b]).bit_count() <= 4 for a, b in found)
    want = slow_classes(list(zip(prints, prints, strict=True)))
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        x, y = top(bits[a]), top(bits[b])
        root[max(x, y)] = min(x, y)
    assert {p: top(p) for p in prints} == want


def test_forest_spans_classes():
    prints = chains(11, 600)
    a, b = hamming.forest(np.array(prints, np.uint64), 4, hamming.references())
    classes = slow_classes(list(zip(prints, prints, strict=True)))
    assert len(a) == len(prints) - len(set(classes.values()))
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True))


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(12)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    r.shuffle(edges)
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += near[x]
    found = [tuple(x) for x in hamming.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(found) == len(want) and dict(found) == want
    assert hamming.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, odd, none, docs, plain):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).schema.names == odd.schema.names
        assert stage(spark, none, SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    classes = wanted(plain)
    assert {r["doc_id"] for r in kept.collect()} == set(classes.values())
    kept = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 6, 7, 8, 9]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here"]
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= set(classes.values())


def test_near_dedup_redone(spark):
    """Executors may be lost: what is computed twice must come out the same."""
    prints = spark.createDataFrame([(i, i % 50) for i in range(500)], "doc_id long, fp long")
    first = sorted(map(tuple, neardup.classes(prints.repartition(5)).collect()))
    assert first == sorted(map(tuple, neardup.classes(prints.repartition(3)).collect()))
