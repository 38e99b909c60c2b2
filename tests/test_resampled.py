"""Smooth densities against direct kernel sums, and intervals over resampled subjects against refits."""

import math

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators import associate, draws as dr, models


def test_density_is_the_kernel_sum_of_binned_draws(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=400), "b": rng.gamma(2.0, 3.0, 150), "two": np.array([0.0, 1.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("same", 2.0)] * 5 + [("one", 1.0), ("a", None)]
    got = dr.smooth_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points=200, draws_bound=1000).toPandas()
    assert set(got["g"]) == set(groups)
    for g, values in groups.items():
        some = got[got["g"] == g].sort_values("point")
        q = np.quantile(values, [0.25, 0.75])
        h = 0.9 * min(values.std(ddof=1), (q[1] - q[0]) / 1.34) * len(values) ** -0.2
        assert np.allclose(some["bandwidth"], h)
        x = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 200)
        assert np.allclose(some["x"], x)
        at = (values - x[0]) / (x[1] - x[0])
        weight = np.zeros(202)
        np.add.at(weight, np.floor(at).astype(int), 1 - (at - np.floor(at)))
        np.add.at(weight, np.floor(at).astype(int) + 1, at - np.floor(at))
        binned = [(weight[:200] * np.exp(-0.5 * ((x - v) / h) ** 2)).sum() / (len(values) * h * math.sqrt(2 * math.pi)) for v in x]
        assert np.allclose(some["density"], binned, atol=1e-10)
        direct = np.array([np.exp(-0.5 * ((values - v) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi)) for v in x])
        assert np.abs(some["density"] - direct).max() < 0.01 * direct.max()
        assert abs(np.trapezoid(some["density"], x) - 1) < 0.02


def test_density_of_nothing(spark):
    assert dr.smooth_density(spark.createDataFrame([], "g string, v double"), ["g"], "v", draws_bound=10).count() == 0


def test_resampled_interval_equals_refits_on_weighted_rows(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in range(25):
        shift = rng.normal()
        for _ in range(int(rng.integers(1, 12))):
            a = float(rng.normal() + shift)
            rows.append((f"s{s}", a, float(0.6 * a + rng.normal()), 3.0))
    rows += [(None, 0.5, 0.1, 3.0), (None, 1.5, 2.1, 3.0), ("s1", None, 1.0, 3.0), ("s2", 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "s string, a double, b double, c double")
    got = {(r["x"], r["y"]): r for r in associate.correlate_resampled(df, [("a", "b"), ("b", "a"), ("a", "c")], "s", 40).collect()}
    weights = {r["s"]: np.array(r["_w"]) for r in models.cluster_weights(df, "s", 40, 16).collect()}
    table = [(s, a, b) for s, a, b, _ in rows if a is not None and b is not None]
    a, b = (np.array([t[i] for t in table]) for i in (1, 2))
    w = np.array([weights[t[0]] for t in table], float)

    def r_of(weight):
        da, db = a - (weight * a).sum() / weight.sum(), b - (weight * b).sum() / weight.sum()
        return (weight * da * db).sum() / math.sqrt((weight * da * da).sum() * (weight * db * db).sum())

    refits = [r_of(w[:, k]) for k in range(1, 41)]
    for pair in (("a", "b"), ("b", "a")):
        r = got[pair]
        assert r["n"] == len(table) and r["replicates"] == 40 and abs(r["estimate"] - np.corrcoef(a, b)[0, 1]) < 1e-12
        assert np.allclose([r["lower"], r["upper"]], np.quantile(refits, [0.025, 0.975]))
    assert got["a", "c"]["estimate"] is None and got["a", "c"]["replicates"] == 0


def test_resampled_plan_aggregates_once(spark):
    df = spark.range(200).select((F.col("id") % 9).alias("s"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    assert associate.correlate_resampled(df, [("a", "b")], "s", 300).first()["replicates"] == 300
    assert associate.correlate_resampled(df.where("false"), [("a", "b")], "s", 3).count() == 0
