"""Effects that travel as one array per subject, and weighted counts added up as arrays."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.scalars import normal_hash
from cohortloom.operators import draws, mixed, models

PAIRS = [("a", 0, 0.5), ("a", 1, -1.0), ("a", 1, 2.0), ("b", 1, 0.25), (None, 0, 9.0), ("a", None, 9.0), ("b", 0, None)]


@pytest.mark.parametrize("numbers", [[0, 1], [0, 1, 1], [0, 1, 2], [0, None]])
@pytest.mark.parametrize("pairs", [PAIRS, [("a", 0, 0.5), ("a", 1, -1.0), ("b", 0, 3.0), ("b", 1, 4.0)]])
def test_effects_meet_their_subject_and_draw(spark, numbers, pairs):
    grid = [("m", s, x) for s in ("a", "a", "b", "c", None) for x in (0.0, 1.5)]
    params = [("m", d, 0.1 * i, 1.0 - i) for i, d in enumerate(numbers)]
    found = draws.fitted_draws(
        spark.createDataFrame(grid, "model string, s string, x double"), spark.createDataFrame(params, "model string, draw long, b0 double, b1 double"),
        "model", "draw", "b0", {"b1": "x"}, 1, spark.createDataFrame(pairs, "s string, draw long, effect double"), ["s"],
    )
    wanted = []
    for (m, s, x), (_, d, b0, b1) in itertools.product(grid, params):
        met = [e or 0.0 for t, n, e in pairs if s is not None and d is not None and t == s and n == d] or [0.0]
        wanted += [(m, s, x, d, 1 / (1 + math.exp(-(b0 + b1 * x + e)))) for e in met]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    rows = sorted([tuple(r) for r in found.select("model", "s", "x", "draw", "fitted").collect()], key=key)
    for got, want in zip(rows, sorted(wanted, key=key), strict=True):
        assert got[:4] == want[:4] and got[4] == pytest.approx(want[4], abs=1e-12)


def test_effects_are_never_broadcast(spark):
    """The effects of all subjects times all draws went through the driver, as Spark took them for small."""
    effects = spark.range(50).select(F.col("id").alias("s"), F.explode(F.array(*[F.lit(d).cast("long") for d in range(4)])).alias("draw"), F.lit(0.5).alias("effect"))
    grid = spark.range(50).select(F.lit("m").alias("model"), F.col("id").alias("s"), F.lit(1.0).alias("x"))
    few = spark.createDataFrame([("m", d, 0.0, 1.0) for d in range(4)], "model string, draw long, b0 double, b1 double")
    plan = draws.fitted_draws(grid, few, "model", "draw", "b0", {"b1": "x"}, 1, effects, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_contrast_keeps_units_without_the_wanted_levels(spark):
    rows = spark.createDataFrame([("m", 1, "low", 0.1), ("m", 1, "high", 0.4), ("m", 2, "other", 0.9), ("m", 3, "low", 0.3)], "model string, s long, level string, fitted double")
    out = {r.posterior: r.estimate for r in draws.contrast(rows, ["model"], ["s"], "level", ["low", "high"], "high", "low", group_bound=1).collect()}
    assert out == pytest.approx({"low": 0.2, "high": 0.4, "contrast": 0.3})


def test_packed_effect_draws_are_the_hashes(spark):
    effects = spark.createDataFrame([("m", 1, 0.5, 2.0), ("m", None, -1.0, 0.1), ("n", 7, None, 1.0)], "model string, s long, effect double, effect_sd double")
    value = F.col("effect") + F.col("effect_sd") * normal_hash(5, "model", "s", "draw")
    by_hash = effects.withColumn("draw", F.explode(F.array(*[F.lit(d).cast("long") for d in (0, 3)]))).select("model", "s", "draw", value.alias("e"))
    wanted = {(r.model, r.s, r.draw): r.e for r in by_hash.collect()}
    got = {(r.model, r.s, r.draw): r.effect for r in mixed.effect_draws(effects, "model", "s", [0, 3], 5).collect()}
    assert got.keys() == wanted.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-12)) for k, v in wanted.items())
    packed = mixed.effect_draws(effects, "model", "s", [0, 3], 5, packed=True).select("model", "s", F.inline("draws")).collect()
    assert {(r.model, r.s, r.draw): r.effect for r in packed} == got


@pytest.mark.parametrize("cells", [4, 1 << 20])
def test_weighted_sums_add_up(spark, monkeypatch, cells):
    monkeypatch.setattr(models, "CELLS", cells)
    rng = np.random.default_rng(3)
    data = [((None, "a", "b")[i % 3], float(i % 4), float(rng.integers(1, 5)), float(i % 2), [1, *map(int, rng.poisson(1, 5))]) for i in range(60)]
    df = spark.createDataFrame(data, "m string, x double, n double, events double, _w array<tinyint>")
    sums: dict = {}
    for r in models._weighted_sums(df, ["m", "x"], 6).collect():
        at = sums.setdefault((r.m, r.x), np.zeros((2, 6)))
        at += np.array([r.n, r.events])
    for m, x in {(d[0], d[1]) for d in data}:
        mine = [d for d in data if (d[0], d[1]) == (m, x)]
        assert np.array_equal(sums.pop((m, x)), [np.sum([np.array(d[4]) * d[i] for d in mine], axis=0) for i in (2, 3)])
    assert not sums


def test_packed_predictions_are_the_long_ones(spark):
    grid = spark.createDataFrame([("m", s, i, 0.5 * i) for i, s in enumerate(["a", "b", "c", None])], "model string, s string, obs int, x double")
    few = spark.createDataFrame([("m", d, 0.1 * d, 1.0) for d in range(3)], "model string, draw long, b0 double, b1 double")
    effects = spark.createDataFrame([("a", d, 0.3 * d) for d in range(3)] + [("b", 1, -1.0)], "s string, draw long, effect double")
    for more in ((), (effects, ["s"])):
        parts = [grid, few, "model", "draw", "b0", {"b1": "x"}, 1, *more]
        long = {r.obs: sorted(r.loglik) for r in draws.loglik_arrays(draws.fitted_draws(*parts), "model", ["obs"], "fitted").collect()}
        packed = {r.obs: sorted(r.loglik) for r in draws.loglik_arrays(draws.fitted_draws(*parts, packed=True), "model", ["obs"], "fitted").collect()}
        assert packed.keys() == long.keys() and all(packed[k] == pytest.approx(long[k]) for k in long)


def test_smoothed_scores_of_short_equal_and_missing_arrays(spark):
    arrays = [(0, None), (2, [-0.5]), (3, [-0.5, None]), (4, [-0.7] * 40), (5, [-0.1 * i for i in range(40)]), (6, [-0.3, -0.4])]
    frame = spark.createDataFrame(arrays, "obs int, loglik array<double>")
    out = {r.obs: r for r in draws.smoothed_scores(frame).collect()}
    plain = {r.obs: r for r in draws.pointwise_scores(frame).collect()}
    for i, r in out.items():
        for c in ("lpd", "p_waic", "elpd_waic"):
            assert r[c] == (None if plain[i][c] is None else pytest.approx(plain[i][c]))
    assert [i for i in out if out[i].pareto_k is not None] == [5] and out[5].elpd_loo != pytest.approx(plain[5].elpd_loo)
    assert all(out[i].elpd_loo == pytest.approx(plain[i].elpd_loo) for i in (2, 4, 6)) and out[0].elpd_loo is out[3].elpd_loo is None
    with pytest.raises(Exception, match="without a log-likelihood"):
        draws.smoothed_scores(spark.createDataFrame([(1, [])], "obs int, loglik array<double>")).collect()
