"""Predictions that stay arrays: their quantiles, contrasts and replicated outcomes are those of one row per draw."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.hashes import unit_numbers
from cohortloom.operators import draws, mixed
from cohortloom.plans import ranking

INF = float("inf")


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
@pytest.mark.parametrize("limits", [{}, {"KEPT_VALUES": 0}, {"CELLS": 64, "DENSE": 1}, {"COUNTED": 50}])
def test_quantiles_of_arrays_are_those_of_their_values(spark, monkeypatch, by, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranking, name, value)
    rng = np.random.default_rng(5)
    rows = [(("a", "b", None)[i % 3], i % 2, [float(v) for v in rng.normal(i % 3, 1e-3, 40)]) for i in range(90)]
    rows += [("c", 0, [0.0, -0.0, None, INF, -INF]), ("c", 1, []), ("d", 0, None), ("e", 0, [None]), ("f", 1, [1.5, float("nan")])]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>")
    probs = [0.975, 0.0, 0.5, 1.0, 0.025]
    bound = 1 if not by else None
    found = {tuple(r[b] for b in by): (r["n"], r["quantiles"]) for r in ranking.quantile_arrays(df, by, "v", probs, bound).collect()}
    long = df.select(*by, F.explode("v").alias("v"))
    wanted = {tuple(r[b] for b in by): (r["n"], r["quantiles"]) for r in ranking.quantile_arrays(long, by, "v", probs, bound).collect()}
    assert found.keys() == wanted.keys() and wanted
    for k, (n, q) in wanted.items():
        assert found[k][0] == n and np.array_equal(found[k][1], q, equal_nan=True)


def test_a_ribbon_of_packed_predictions_keeps_no_row_per_draw(spark):
    """Every prediction was a row of its own, stored and met with its bracket."""
    packed = spark.createDataFrame([("m", 0, 0.5, [0.1, 0.2, 0.3]), ("m", 0, 0.5, [0.4])], "model string, point int, x double, fitted array<double>")
    scales = spark.createDataFrame([("m", 1.0, 2.0)], "model string, mean double, sd double")
    out = draws.ribbon(packed, scales, ["model"], 1, ["model", "point"], "x", [0.5], 1).collect()
    assert [(r.x_raw, r.median) for r in out] == [(2.0, pytest.approx(0.25))] and out[0].lower == pytest.approx(0.175)


def test_packed_grid_predictions_are_the_long_ones(spark):
    points = F.array(*[F.struct(F.lit(i).alias("point"), (F.lit(0.5) * i).alias("x")) for i in range(3)], F.struct(F.lit(3).alias("point"), F.lit(None).cast("double").alias("x")))
    grid = spark.createDataFrame([("m", s) for s in ("a", "b", "c", None)], "model string, s string").withColumn("points", points)
    few = spark.createDataFrame([("m", d, None if d == 2 else 0.1 * d, 1.0) for d in range(3)], "model string, draw long, b0 double, b1 double")
    effects = spark.createDataFrame([("a", d, 0.3 * d) for d in range(3)] + [("b", 1, -1.0), ("b", 1, 2.0)], "s string, draw long, effect double")
    key = lambda r: repr(r)
    for more in ((), (effects, ["s"])):
        parts = [grid, few, "model", "draw", "b0", {"b1": "x"}, 1, *more]
        packed = draws.fitted_draws(*parts, packed=True, numbered=True).select("s", "point", F.inline(F.arrays_zip("draw", "fitted")))
        rows = [sorted([(r.s, r.point, r.draw, None if r.fitted is None else round(r.fitted, 12)) for r in d.collect()], key=key) for d in (packed, draws.fitted_draws(*parts))]
        assert rows[0] == rows[1] and len(rows[0]) >= 48


def test_packed_contrasts_meet_by_place(spark):
    rows = [("m", 1, "low", [0.1, 0.3]), ("m", 1, "high", [0.4, None]), ("m", 1, "high", [0.2, 0.9]), ("m", 2, "other", [0.9]), ("m", 3, "low", [0.3]), ("k", None, "high", [])]
    packed = spark.createDataFrame(rows, "model string, s long, level string, fitted array<double>")
    long = packed.select("model", "s", "level", F.posexplode("fitted").alias("draw", "fitted"))
    args = ["level", ["low", "high"], "high", "low"]
    wanted = {(r.model, r.posterior): (r.estimate, r.lower, r.upper) for r in draws.contrast(long, ["model"], ["s", "draw"], *args, group_bound=2).collect()}
    found = {(r.model, r.posterior): (r.estimate, r.lower, r.upper) for r in draws.contrast(packed, ["model"], ["s"], *args, group_bound=2).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted) and found["m", "contrast"][0] == pytest.approx(0.45)
    with pytest.raises(Exception, match="differ in their number"):
        draws.contrast(spark.createDataFrame([("m", 1, "low", [0.1]), ("m", 1, "high", [0.4, 0.2])], packed.schema), ["model"], ["s"], *args)


@pytest.mark.parametrize("numbers", [[0, 1, None], ["x", "y", "x"]])
def test_packed_checks_replicate_the_same_outcomes(spark, numbers):
    kind = "long" if numbers[0] == 0 else "string"
    rows = [(m, i if i % 5 else None, i % 3 == 0 if i % 7 else None, numbers, [0.2 + 0.01 * i, None if i % 4 == 0 else 0.5, 0.9]) for i in range(40) for m in ("a", None)]
    rows.append(("b", 1, True, [], []))
    packed = spark.createDataFrame(rows, f"model string, obs long, event boolean, draw array<{kind}>, fitted array<double>")
    long = packed.select("model", "obs", "event", F.inline(F.arrays_zip("draw", "fitted")))
    found, wanted = ({(r.model, r.draw): r[2:] for r in draws.predictive_check(d, ["model"], "draw", ["obs"], "event", 16).collect()} for d in (packed, long))
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_unit_numbers_are_the_hashes():
    starts, middles, ends = [b"", b"16|3", b"7|" + b"x" * 45], [b"", b"|5", "|é中".encode(), b"|123456789", b"y" * 60], [b"", b"|a"]
    found = unit_numbers(starts, middles, ends)
    for i, s in enumerate(starts):
        for j, m in enumerate(middles):
            for k, e in enumerate(ends):
                assert found[i, j, k] == int(hashlib.md5(s + m + e).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("k", [1, 2])
def test_node_sums_add_up_the_patterns_of_each_subject(k):
    """Also far from zero, where the exponential of the other sign is beyond all numbers."""
    rng = np.random.default_rng(k)
    size = np.array([1, 4, 2, 40, 1])
    starts, rows = np.cumsum(size) - size, size.sum()
    x, n = rng.normal(size=(rows, k)), rng.integers(1, 5, rows).astype(float)
    x[0] = 2000.0
    events = np.floor(n * rng.random(rows))
    beta, sd, u = np.full((5, k), -0.5), np.full(5, 0.7), np.tile(np.linspace(-3, 3, 7), (5, 1))
    with np.errstate(all="raise", under="ignore"):
        found = mixed.node_sums(x, n, events, starts, beta, sd, u)
    for s, (at, m) in enumerate(zip(starts, size)):
        mine = slice(at, at + m)
        eta = (x[mine] @ beta[s])[:, None] + sd[s] * u[s]
        p = np.where(eta < 0, np.exp(np.minimum(eta, 0)) / (1 + np.exp(np.minimum(eta, 0))), 1 / (1 + np.exp(-np.maximum(eta, 0))))
        r, w = events[mine, None] - n[mine, None] * p, n[mine, None] * p * (1 - p)
        loglik = events[mine, None] * eta - n[mine, None] * np.logaddexp(0.0, eta)
        wanted = [loglik, *[x[mine, j][:, None] * r for j in range(k)], r]
        wanted += [(x[mine, i] * x[mine, j])[:, None] * w for i in range(k) for j in range(i, k)] + [x[mine, j][:, None] * w for j in range(k)] + [w]
        assert np.allclose(found[:, s], [t.sum(axis=0) for t in wanted], rtol=1e-10, atol=1e-10)
