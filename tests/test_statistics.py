"""Statistics against independent computations."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.pvalues import chi_square_tail, fisher_two_sided, normal_two_sided
from cohortloom.operators import associate, describe, draws, models
from cohortloom.plans.joins import salted_join
from cohortloom.plans.ranking import exact_quantiles, midrank_counts


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 120_000
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))
    value = np.where(rng.random(n) < 0.2, 1.5, np.exp(rng.normal(size=n) * 4))
    value[rng.random(n) < 0.01] = np.nan
    frame = pd.DataFrame({"g": group, "v": value})
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df, frame.dropna()


@pytest.mark.parametrize("bound", [None, 7])
def test_quantiles_of_large_skewed_groups(skewed, bound):
    df, frame = skewed
    probs = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.975, "g1": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, bound).collect()}
    for g, part in frame.groupby("g"):
        assert got[g].n == len(part)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)


def test_quantiles_of_the_whole_table(skewed):
    df, frame = skewed
    row = exact_quantiles(df, [], "v", {"m": 0.5, "hi": 0.99}).first()
    assert row.m == pytest.approx(np.quantile(frame["v"], 0.5)) and row.hi == pytest.approx(np.quantile(frame["v"], 0.99))


def test_quantiles_with_coarse_sketch(skewed):
    df, frame = skewed
    row = exact_quantiles(df, [], "v", {"m": 0.37}, accuracy=500).first()
    assert row.m == pytest.approx(np.quantile(frame["v"], 0.37))


def test_quantiles_of_tiny_groups_null_group_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 5.0), ("y", None)], "g string, v double")
    got = {r.g: (r.n, r.m) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, 3).collect()}
    assert got == {None: (2, 1.5), "x": (1, 5.0)}
    assert exact_quantiles(df.where("false"), [], "v", {"m": 0.5}).count() == 0


def test_midranks_equal_pandas(skewed):
    df, frame = skewed
    got = midrank_counts(df, "g", "v", {}, 7, blocks=32).toPandas().set_index(["g", "v"])["midrank"]
    expected = frame.assign(r=frame.groupby("g")["v"].rank()).groupby(["g", "v"])["r"].first()
    assert (got.sort_index() - expected.sort_index()).abs().max() == 0


def test_salted_join_equals_plain_join(skewed, spark):
    df, _ = skewed
    side = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, k int")
    plain = df.join(side, "g", "left").groupBy("g", "k").count()
    salted = salted_join(df, side, ["g"]).groupBy("g", "k").count()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_tail_probabilities():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    # Closed forms: one, two and four degrees of freedom.
    for x in (0.1, 1.0, 3.84, 20.0, 200.0):
        assert chi_square_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-9)
        assert chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-9)


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (0, 5, 4, 1), (10, 2, 3, 15), (1, 0, 0, 1), (0, 0, 3, 4)])
def test_fisher_equals_enumeration(cells):
    a, b, c, d = cells
    r, k, n = a + b, a + c, a + b + c + d
    def p(x):
        return math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
    span = range(max(0, r + k - n), min(r, k) + 1)
    expected = sum(p(x) for x in span if p(x) <= p(a) * (1 + 1e-7))
    assert fisher_two_sided(a, b, c, d) == pytest.approx(expected)


def test_contingency_with_zero_cell_uses_fisher(spark):
    data = [("v", "x", "g1")] * 5 + [("v", "y", "g1")] * 2 + [("v", "y", "g2")] * 6 + [("w", str(i % 5), f"g{1 + i % 2}") for i in range(12)]
    out = {r.variable: r for r in describe.contingency_test(spark.createDataFrame(data, "variable string, level string, g string"), "variable", "level", "g").collect()}
    r = out["v"]
    assert (r.a, r.b, r.c, r.d, r.test) == (5.0, 0.0, 2.0, 6.0, "fisher")
    assert r.p == pytest.approx(fisher_two_sided(5, 0, 2, 6))
    assert r.chi_square == pytest.approx(13 * (5 * 6 - 0) ** 2 / (5 * 8 * 7 * 6))
    assert out["w"].test == "chi_square_small_expected" and out["w"].df == 4 and out["w"].a is None


def test_rank_sum_with_ties(spark):
    x, y = [1, 2, 2, 3, 5], [2, 4, 4, 6]
    data = [("m", float(v), "a") for v in x] + [("m", float(v), "b") for v in y] + [("m", None, "a")]
    r = describe.rank_sum_test(spark.createDataFrame(data, "variable string, value double, g string"), "variable", "value", "g", "a", "b", 1).first()
    u = sum((i > j) + 0.5 * (i == j) for i in x for j in y)
    assert (r.n1, r.n2, r.u) == (5, 4, u)
    ties = sum(t**3 - t for t in pd.Series(x + y).value_counts())
    var = 20 / 12 * (10 - ties / (9 * 8))
    z = (u - 10 + 0.5) / math.sqrt(var)
    assert r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def logistic(x, y, ridge=0.0):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logit_many_formulas_in_one_call(spark):
    rng = np.random.default_rng(2)
    n = 1500
    z1, z2 = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.8 * z1 - 0.4 * z2 + 0.3 * z1 * z2)))).astype(int)
    one, zero = np.ones(n), np.zeros(n)
    designs = {"one": [one, z1, zero, zero], "two": [one, z1, z2, zero], "cross": [one, z1, z2, z1 * z2], "bare": [zero, z1, zero, zero]}
    frame = pd.concat([pd.DataFrame(dict(zip(["one", "z1", "z2", "z12"], cols)), copy=True).assign(m=m, y=y) for m, cols in designs.items()])
    xs = ["one", "z1", "z2", "z12"]
    got = models.logit_many(spark.createDataFrame(frame), "m", "y", xs, ridge=1e-9).toPandas()
    for m, cols in designs.items():
        used = [i for i, c in enumerate(cols) if np.any(c)]
        beta, se = logistic(np.column_stack([cols[i] for i in used]), y)
        part = got[got["m"] == m].set_index("param")
        for j, i in enumerate(used):
            assert part.loc[xs[i], "value"] == pytest.approx(beta[j], abs=1e-6)
            assert part.loc[xs[i], "std_error"] == pytest.approx(se[j], rel=1e-5)
        for i in set(range(4)) - set(used):
            assert part.loc[xs[i], "value"] == 0.0


def test_bootstrap_equals_refit_on_weighted_rows(spark):
    rng = np.random.default_rng(4)
    n = 600
    frame = pd.DataFrame({"m": "a", "c": rng.integers(0, 40, n), "x": rng.integers(0, 5, n)})
    frame["y"] = (rng.random(n) < 0.2 + 0.1 * frame["x"]).astype(int)
    df = spark.createDataFrame(frame).withColumn("one", F.lit(1.0))
    got = models.logit_many(df, "m", "y", ["one", "x"], "c", 3, 11).toPandas()
    from cohortloom.functions.scalars import poisson_one, unit_hash
    for rep in range(1, 4):
        w = {r.c: r.w for r in df.select("c", poisson_one(unit_hash(11, F.lit(rep), "c")).alias("w")).distinct().collect()}
        repeated = frame.loc[frame.index.repeat(frame["c"].map(w))]
        beta, _ = logistic(np.column_stack([np.ones(len(repeated)), repeated["x"]]), repeated["y"].to_numpy(), models.RIDGE)
        part = got[got["replicate"] == rep].set_index("param")["value"]
        assert part["one"] == pytest.approx(beta[0], abs=1e-6) and part["x"] == pytest.approx(beta[1], abs=1e-6)


def test_separated_data_stays_finite(spark):
    df = spark.createDataFrame([("a", float(i), int(i > 5)) for i in range(12)], "m string, x double, y int").withColumn("one", F.lit(1.0))
    fit = models.logit_fit(models.sufficient_counts(df, ["m"], "y", ["one", "x"]), ["m"], ["one", "x"]).first()
    x = np.column_stack([np.ones(12), np.arange(12)])
    beta, _ = logistic(x, (np.arange(12) > 5).astype(int), models.RIDGE)
    assert fit.step < 1e-9 and fit.beta == pytest.approx(beta, abs=1e-6)


def test_poisson_weights_have_the_right_moments(spark):
    from cohortloom.functions.scalars import poisson_one, unit_hash
    r = spark.range(50000).select(poisson_one(unit_hash(1, "id")).alias("w")).agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert r[0] == pytest.approx(1, abs=0.02) and r[1] == pytest.approx(1, abs=0.04) and r[2] == pytest.approx(math.exp(-1), abs=0.01)


def test_sample_by_size_is_nested_and_exact(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"))
    out = models.sample_by_size(df, "g", ["id"], [10, 700], 3, salts=4).cache()
    assert {(r.g, r.sample_size): r["count"] for r in out.groupBy("g", "sample_size").count().collect()} == {
        (g, s): s for g in ("hot", "cold") for s in (10, 700)
    }
    small, large = out.where("sample_size = 10").select("id"), out.where("sample_size = 700").select("id")
    assert small.subtract(large).isEmpty() and out.select("id", "sample_size").distinct().count() == out.count()


def test_odds_ratios_of_published_estimates(spark):
    # Published log-odds estimates and interval bounds with their odds ratios.
    published = [
        (0.319526341, 1.37647562983311), (0.14115990000000003, 1.15160877550656), (0.515948975, 1.6752274967337597),
        (0.3753274395, 1.4554679142876576), (0.18388165, 1.201873572941457), (0.591479825, 1.8066599787902875),
        (0.2408577019875, 1.272339970976893), (0.05702964250000001, 1.058687192065473), (0.4423143500000001, 1.5563048879898522),
    ]
    # Three equal draws make every interval bound the value itself.
    data = [(i, v) for i, (v, _) in enumerate(published) for _ in range(3)]
    out = draws.draws_summary(spark.createDataFrame(data, "model int, value double"), ["model"], draws_bound=3)
    for r in out.collect():
        assert r.estimate_or == pytest.approx(published[r.model][1], rel=1e-12)
        assert r.q2_5_or == pytest.approx(published[r.model][1], rel=1e-12)


def test_intervals_are_nested_and_both_ways_agree(skewed):
    df, _ = skewed
    widths = [0.5, 0.8, 0.95]
    large = {(r.g, r.width): r for r in draws.median_qi(df, ["g"], "v", widths, group_bound=7).collect()}
    small = {(r.g, r.width): r for r in draws.median_qi(df, ["g"], "v", widths, draws_bound=100_000).collect()}
    assert large.keys() == small.keys()
    for key, r in large.items():
        assert tuple(r)[1:] == pytest.approx(tuple(small[key])[1:], rel=1e-12)
    for g in {g for g, _ in large}:
        lows, highs = zip(*[(large[g, w].lower, large[g, w].upper) for w in widths])
        assert list(lows) == sorted(lows, reverse=True) and list(highs) == sorted(highs)


def test_pointwise_scores_stay_finite_for_extreme_draws(spark):
    df = spark.createDataFrame([("m", [-900.0, -1.0, -2.0]), ("m", [-5.0, -5.0, -5.0])], "model string, loglik array<double>")
    far, flat = draws.pointwise_scores(df.withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()
    assert far.elpd_loo == pytest.approx(math.log(3) - 900) and math.isfinite(far.lpd)
    assert (flat.lpd, flat.p_waic, flat.elpd_loo) == (-5.0, 0.0, pytest.approx(-5.0))


def test_subject_trend_equals_within_regression(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"s": rng.integers(0, 30, 800), "day": rng.integers(0, 60, 800)})
    frame["v"] = 0.05 * frame["day"] + frame["s"] + rng.normal(size=800)
    r = associate.subject_trend(spark.createDataFrame(frame.assign(m="a")), "s", "day", "m", "v").first()
    x = frame["day"] - frame.groupby("s")["day"].transform("mean")
    y = frame["v"] - frame.groupby("s")["v"].transform("mean")
    b = (x * y).sum() / (x * x).sum()
    score = (x * (y - b * x)).groupby(frame["s"]).sum()
    assert r.slope == pytest.approx(b) and r.std_error == pytest.approx(math.sqrt((score**2).sum()) / (x * x).sum())


def test_correlation_with_too_few_or_constant_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)] * 3 + [("b", float(i), float(i * i % 7)) for i in range(8)], "g string, x double, y double")
    out = associate.correlate_by(df, "g", "x", "y", min_n=5).collect()
    assert [r.g for r in out] == ["b"]
    assert out[0].estimate == pytest.approx(np.corrcoef(range(8), [i * i % 7 for i in range(8)])[0, 1])


def test_concordance_and_random_frames(spark):
    rng = random.Random(1)
    cultures = [(rng.randrange(20), rng.choice("abc")) for _ in range(60)]
    dominant = [(k, rng.choice(["a", "b", None])) for k in range(25)]
    got = {r.k: r.any_match for r in describe.same_day_concordance(
        spark.createDataFrame(cultures, "k int, o string"), spark.createDataFrame(dominant, "k int, d string"), ["k"], "o", "d").collect()}
    expected = {}
    for k, d in dominant:
        mine = [o for c, o in cultures if c == k]
        if d is not None and mine:
            expected[k] = d in mine
    assert got == expected
