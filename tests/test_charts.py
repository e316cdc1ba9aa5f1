import numpy as np
import pytest

from pyspark.sql import functions as F

from parzelle.operators import charts


def plain_line(x, y):
    """Huber's line by reweighted least squares, in numpy."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x))
    for _ in range(200):
        b = np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * y))
        off = np.abs(y - a @ b)
        w = np.minimum(1.0, charts.HUBER * np.median(off) / charts.NORMAL / np.maximum(off, 1e-300))
    return b


def test_robust_line(spark):
    r = np.random.default_rng(3)
    x = r.uniform(0, 50, 300)
    y = 4 + 2.5 * x + r.normal(0, 1, 300)
    y[:30] += 200
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (2.0, None), (float("nan"), 3.0)], "x double, y double")
    found = charts.robust_line(df, "x", "y").first()
    assert found["n"] == 300
    assert [found["intercept"], found["slope"]] == pytest.approx(plain_line(x, y).tolist(), rel=1e-5)
    assert abs(found["slope"] - 2.5) < 0.05


def test_robust_line_of_few(spark):
    make = lambda rows: charts.robust_line(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert tuple(make([])) == (0, None, None, None)
    assert tuple(make([(1.0, 2.0), (1.0, 3.0)])) == (2, None, None, None)
    assert tuple(make([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)])) == pytest.approx((3, 1.0, 2.0, 0.0), abs=1e-9)


@pytest.mark.parametrize("most", [100_000, 5])
def test_middle(spark, most):
    r = np.random.default_rng(5)
    for values in ([0.0], [1.0, 2.0], [0.0] * 50 + [3.0] * 50, r.exponential(3, 301).tolist(), (1e6 + r.uniform(0, 1, 300)).tolist(), [0.0, 0.0, *r.integers(0, 9, 400).astype(float).tolist()]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert charts._middle(df, df.x, len(values), most) == np.median(values)


def test_robust_line_keeps_its_rows(spark, monkeypatch):
    """Rounds read kept rows through the narrowing median, never a shuffle of all of them."""
    seen = []
    ordered = charts._middle
    monkeypatch.setattr(charts, "_middle", lambda rows, *more: seen.append(rows.is_cached) or ordered(rows, *more))
    df = spark.range(2000).select((F.col("id") % 50).alias("x"), F.sqrt("id").alias("y"))
    assert charts.robust_line(df, "x", "y").first()["n"] == 2000
    assert seen and all(seen)


def test_boxes(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 7.0), ("b", None), (None, 1.0)], "k string, v double")
    found = {r["k"]: tuple(r)[1:] for r in charts.boxes(df, "k", "v").collect()}
    assert found == {"a": (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1), "b": (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0), None: (1, 1.0, 1.0, 1.0, 1.0, 1.0, 0)}


def test_density_has_area_one(spark):
    values = np.random.default_rng(4).normal(10, 3, 200)
    df = spark.createDataFrame([("a", v) for v in values.tolist()] + [("one", 5.0), ("same", 2.0), ("same", 2.0)], "k string, v double")
    rows = sorted(charts.density(df, "k", "v").collect(), key=lambda r: r["point"])
    assert {r["label"] for r in rows} == {"a"} and len(rows) == 200
    at, d = (np.array([r[c] for r in rows]) for c in ("at", "density"))
    assert np.trapezoid(d, at) == pytest.approx(1, abs=0.01)
    h = values.std(ddof=1) * 200**-0.2
    want = np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).sum(axis=1) / (200 * h * np.sqrt(2 * np.pi))
    assert np.allclose(d, want)


def test_histograms_of_odd_tables(spark):
    none = spark.createDataFrame([], "v double, w double")
    assert charts.legend_histogram(none, "v", [1]).count() == 0
    assert charts.joint_histogram(none, "v", "w").count() == 0
    assert charts.boxes(none, "v", "w").count() == 0
    same = spark.createDataFrame([(3.0, 4.0), (3.0, 4.0), (None, 4.0)], "v double, w double")
    assert sorted(tuple(r) for r in charts.legend_histogram(same, "v", [5], 2).select("bin", "n").collect()) == [(0, 2), (1, 0)]
    assert sorted((tuple(r) for r in charts.joint_histogram(same, "v", "w").collect()), key=str) == [(0, 0, 2), (0, None, 2), (None, 0, 2)]


def test_legend_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    values = np.arange(11.0)
    n, edges = np.histogram(values, bins=5)
    rows = sorted(charts.legend_histogram(df, "v", [4.0, 7.0, 10.0], 5).collect())
    assert [r["n"] for r in rows] == n.tolist() and [r["low"] for r in rows] == edges[:-1].tolist()
    assert [r["class"] for r in rows] == [0, 0, 1, 1, 2]
