"""Ordered funnels against a loop over each client's rows, and the plan of the query."""

import datetime
import math
import random
from collections import Counter, defaultdict

import pytest

from parzelle.llm import funnels, queries
from parzelle.llm.queries import FUNNELS

EPOCH = datetime.datetime(1970, 1, 1)
NAMES = ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]


def plain(rows, defs, within):
    """rows (client, kind, microseconds); what the contract says, step by step."""
    by = defaultdict(set)
    for c, k, t in rows:
        if c is not None and k is not None and t is not None:
            by[c].add((t, k))
    found, depth = {}, Counter()
    for f in defs:
        for c, events in by.items():
            events = sorted(events)
            times = defaultdict(list)
            for t, k in events:
                if k != f.steps[0]:
                    continue
                times[1].append(0)
                last = t
                for n, kind in enumerate(f.steps[1:], 2):
                    then = min((u for u, x in events if x == kind and u > last), default=None)
                    if then is None or then - t > within or any(x == f.excluding and last < u <= then for u, x in events):
                        break
                    times[n].append(then - last)
                    last = then
            if times:
                deepest = max(times)
                depth[f.name, deepest] += 1
                quarter = [sorted(times[n])[math.ceil(25 * len(times[n]) / 100) - 1] if times[n] else None for n in (2, 3, 4)]
                found[f.name, c] = (*(len(times[n]) for n in (1, 2, 3, 4)), deepest, *quarter)
    return {key: (*row, depth[key[0], row[4]]) for key, row in found.items()}


def events(seed, n, step):
    rnd = random.Random(seed)
    rows, t = [], 1_704_067_200_000_000
    for _ in range(n):
        t += rnd.choice([0, 1, step, step, step, 3 * step, 90 * step])
        rows.append((rnd.choice([1, 1, 1, 2, 3, None, -4]), rnd.choice(["view", "view", "click", "click", "purchase", "signup", "error", None, "other"]), rnd.choice([t] * 20 + [None])))
    return rows + rows[: n // 10]


def rows_of(df):
    assert df.columns == NAMES
    out = [tuple(r) for r in df.collect()]
    assert len({r[:2] for r in out}) == len(out)
    return {r[:2]: r[2:] for r in out}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("seed,step", [(1, 4_000_000), (2, 11_234_567), (3, 1)])
def test_funnels_equal_a_loop(spark, seed, step, kind):
    rows = events(seed, 600, step)
    df = spark.createDataFrame([(c, k, None if t is None else EPOCH + datetime.timedelta(microseconds=t), 1, 2, "x") for c, k, t in rows], f"client_id long, kind string, arrived_at {kind}, t int, span int, client string").repartition(3)
    found = rows_of(funnels.count(df, FUNNELS))
    assert found == plain(rows, FUNNELS, 300_000_000)
    assert any(r[3] for r in found.values())


def test_percentiles_of_many_lengths(spark):
    """Lengths over several ranges, in which the rank is found first."""
    rnd = random.Random(8)
    rows = []
    for i in range(2000):
        t = i * 1_000_000_000
        rows += [(7, "view", t), (7, "click", t + rnd.choice([5, 16_384, 16_383, rnd.randrange(1, 200_000_000)]))]
    df = spark.createDataFrame([(c, k, EPOCH + datetime.timedelta(microseconds=t)) for c, k, t in rows], "client_id long, kind string, arrived_at timestamp_ntz")
    two = [funnels.Funnel("T", ("view", "click"), "error")]
    for percent in (1, 25, 50, 100):
        got = funnels.count(df, two, percent=percent).first()
        lengths = sorted(b[2] - a[2] for a, b in zip(rows[::2], rows[1::2], strict=True))
        assert (got["n1"], got["n2"], got["t2"]) == (2000, 2000, lengths[math.ceil(percent * 2000 / 100) - 1])


def test_no_rows_and_bad_parameters(spark):
    none = spark.createDataFrame([], "client_id long, kind string, arrived_at timestamp_ntz")
    assert funnels.count(none, FUNNELS).collect() == []
    for bad in ([funnels.Funnel("A", ("view",), "error")], FUNNELS + FUNNELS):
        with pytest.raises(ValueError):
            funnels.count(none, bad)


def test_query_runs_no_python_and_deals_the_busiest_client_by_time(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_funnels(spark, sf).count() > 0
    rows = spark.createDataFrame([(1, 0, i * 1_000_000) for i in range(50_000)], "client long, kind byte, t long")
    plan = funnels.following(rows, 2, 300_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" in plan and "hashpartitioning(client" in plan and "span" in plan
