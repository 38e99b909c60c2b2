"""Subject intercepts, random-intercept trends, varying strata and smoothed tails against plain numerics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import associate, draws as dr, mixed, models

XS = ["one", "x"]


def simulate(seed, subjects, most, beta, sd):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        u = rng.normal() * sd
        for _ in range(rng.integers(1, most)):
            x = round(float(rng.normal()), 1)
            p = 1 / (1 + math.exp(-(beta[0] + beta[1] * x + u)))
            rows.append((f"s{s}", 1.0, x, bool(rng.random() < p)))
    return rows


def frame(spark, sets):
    rows = [(m, *r) for m, rows in sets.items() for r in rows]
    return spark.createDataFrame(rows, "m string, s string, one double, x double, y boolean")


GRID = np.linspace(-9, 9, 4001)
DENSITY = np.exp(-GRID * GRID / 2) / math.sqrt(2 * math.pi) * (GRID[1] - GRID[0])


def by_integration(rows, theta):
    """Log-likelihood, and mean and deviation of each subject's intercept, by the trapezoid rule."""
    total, effects = 0.0, {}
    for s in {r[0] for r in rows}:
        value = np.ones_like(GRID)
        for _, one, x, y in (r for r in rows if r[0] == s):
            p = 1 / (1 + np.exp(-(theta[0] * one + theta[1] * x + math.exp(theta[2]) * GRID)))
            value = value * (p if y else 1 - p)
        weight = value * DENSITY
        total += math.log(weight.sum())
        b = math.exp(theta[2]) * GRID
        mean = (weight * b).sum() / weight.sum()
        effects[s] = mean, math.sqrt((weight * b * b).sum() / weight.sum() - mean * mean)
    return total, effects


@pytest.fixture(scope="module")
def sets():
    return {"a": simulate(1, 60, 8, (-0.5, 0.8), 1.2), "b": simulate(2, 45, 12, (0.7, -0.4), 0.8), "c": simulate(3, 30, 25, (-1.0, 0.3), 2.0)}


def test_slopes_and_curvatures_are_derivatives():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 9, 30)
    starts, total = np.cumsum(size) - size, size.sum()
    x, n = np.column_stack([np.ones(total), rng.normal(size=total)]), rng.integers(1, 4, total).astype(float)
    events = rng.binomial(n.astype(int), 0.4).astype(float)
    t, lw = mixed.quadrature(15)
    u = np.tile(math.sqrt(2) * t, (30, 1))

    def at(theta):
        beta, sd = np.tile(theta[:2], (30, 1)), np.full(30, math.exp(theta[2]))
        return mixed.subject_terms(mixed.node_sums(x, n, events, starts, beta, sd, u), np.tile(lw, (30, 1)), u, sd, 2)

    theta, e = np.array([-0.3, 0.5, 0.1]), 1e-5
    for k, d in enumerate(np.eye(3) * e):
        up, down = at(theta + d), at(theta - d)
        assert np.allclose(at(theta)["score"].sum(0)[k], (up["loglik"].sum() - down["loglik"].sum()) / (2 * e), atol=1e-5)
        assert np.allclose(at(theta)["curve"].sum(0)[k], (up["score"].sum(0) - down["score"].sum(0)) / (2 * e), atol=1e-5)


def test_fits_are_maxima_of_the_integral(spark, sets):
    fits, effects = mixed.mixed_logit(frame(spark, sets), "m", "y", XS, "s", recentre=2)
    found = {r["m"]: r for r in fits.collect()}
    assert set(found) == set(sets) and all(r["converged"] for r in found.values())
    posterior = {(r["m"], r["s"]): (r["effect"], r["effect_sd"]) for r in effects.collect()}
    for m, rows in sets.items():
        theta = np.array(found[m]["theta"])
        value, subjects = by_integration(rows, theta)
        assert found[m]["subjects"] == len(subjects) and found[m]["n"] == len(rows)
        assert abs(value - found[m]["loglik"]) < 1e-5
        for k, d in enumerate(np.eye(3) * 1e-4):
            slope = (by_integration(rows, theta + d)[0] - by_integration(rows, theta - d)[0]) / 2e-4
            assert abs(slope - (1e-3 * theta[k] if k < 2 else 0.0)) < 2e-3
        for s, (mean, sd) in subjects.items():
            assert np.allclose(posterior[m, s], (mean, sd), atol=1e-4)


def test_subjects_of_many_patterns_are_put_together(spark, sets, monkeypatch):
    df = frame(spark, {"c": sets["c"]})
    whole, effects = (t.toPandas() for t in mixed.mixed_logit(df, "m", "y", XS, "s"))
    plain = mixed.subject_rows
    monkeypatch.setattr(mixed, "subject_rows", lambda *a, **k: plain(*a, **k, most=3))
    assert mixed.subject_rows(df, "m", "s", "y", XS).agg(F.max("_parts")).first()[0] > 3
    split, again = (t.toPandas() for t in mixed.mixed_logit(df, "m", "y", XS, "s"))
    assert np.allclose(np.stack(whole["theta"]), np.stack(split["theta"]), atol=1e-9)
    assert np.allclose(effects.sort_values("s")["effect"], again.sort_values("s")["effect"], atol=1e-9)


def test_no_spread_odd_rows_and_empty_tables(spark):
    rng = np.random.default_rng(7)
    rows = [("flat", f"s{i}", 1.0, float(j), bool((i + j) % 2)) for i in range(20) for j in range(4)]
    rows += [("odd", None, 1.0, 0.5, True), ("odd", "a", 1.0, None, True), ("odd", "a", 1.0, 0.1, None), ("odd", "a", 1.0, 0.2, False), ("odd", "b", 1.0, float(rng.normal()), True)]
    df = spark.createDataFrame(rows, "m string, s string, one double, x double, y boolean")
    fits, effects = mixed.mixed_logit(df, "m", "y", XS, "s")
    found = {r["m"]: r for r in fits.collect()}
    assert found["flat"]["theta"][2] <= mixed.LEAST_LOG_SD + 1e-9 and found["flat"]["covariance"][8] == 0.0
    assert found["odd"]["n"] == 3 and found["odd"]["subjects"] == 3
    assert {r["s"] for r in effects.where("m = 'odd'").collect()} == {None, "a", "b"}
    none, nobody = mixed.mixed_logit(df.where("false"), "m", "y", XS, "s")
    assert none.count() == 0 and nobody.count() == 0


def test_draws_follow_the_fit_and_repeat(spark, sets):
    fits, effects = mixed.mixed_logit(frame(spark, {"a": sets["a"]}), "m", "y", XS, "s")
    drawn = mixed.parameter_draws(fits, "m", XS, 4000, 5)
    got = drawn.toPandas().sort_values("draw")[["b_one", "b_x"]].to_numpy()
    row = fits.first()
    assert np.allclose(got.mean(axis=0), row["theta"][:2], atol=0.03)
    assert np.allclose(np.cov(got.T), np.array(row["covariance"]).reshape(3, 3)[:2, :2], atol=0.01)
    assert np.array_equal(got, mixed.parameter_draws(fits, "m", XS, 4000, 5).toPandas().sort_values("draw")[["b_one", "b_x"]].to_numpy())
    some = mixed.effect_draws(effects, "m", "s", range(500), 5).groupBy("s").agg(F.avg("effect").alias("a"), F.stddev("effect").alias("d"))
    both = some.join(effects, "s").toPandas()
    assert np.allclose(both["a"], both["effect"], atol=0.25) and np.allclose(both["d"], both["effect_sd"], rtol=0.2)


def dense_trend(rows, level):
    """Maximum of the likelihood over a fine range of variance ratios, with whole covariance matrices."""
    subjects = sorted({r[0] for r in rows})
    x = np.array([[1.0, r[1]] if level else [r[1]] for r in rows])
    y = np.array([r[2] for r in rows])
    same = np.array([[float(a[0] == b[0]) for b in rows] for a in rows])
    best = None
    for lam in np.concatenate(([0.0], np.exp(np.linspace(-12, 6, 1500)))):
        v = np.eye(len(rows)) + lam * same
        inverse = np.linalg.inv(v)
        info = x.T @ inverse @ x
        beta = np.linalg.solve(info, x.T @ inverse @ y)
        s2 = float((y - x @ beta) @ inverse @ (y - x @ beta)) / len(y)
        value = len(y) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1]
        if best is None or value < best[0]:
            best = value, beta[-1], math.sqrt(s2 * np.linalg.inv(info)[-1, -1]), math.sqrt(lam * s2), math.sqrt(s2), len(subjects)
    return best


@pytest.mark.parametrize("level", [False, True])
def test_random_intercept_equals_dense_solution(spark, level):
    rng = np.random.default_rng(4)
    rows = []
    for name, sd in (("wide", 1.5), ("none", 0.0)):
        for s in range(12):
            u = rng.normal() * sd
            rows += [(name, f"s{s}", d, float(0.3 * d + u + (2.0 if level else 0.0) + rng.normal() * 0.7)) for d in range(int(rng.integers(1, 9)))]
    odd = [("wide", "s1", None, 1.0), ("wide", "s2", 3, None), ("alone", "s", 2, 1.0)]
    df = spark.createDataFrame(rows + odd, "k string, s string, d int, v double")
    got = {r["k"]: r for r in associate.random_intercept(df, "s", "d", "k", "v", intercept=level).collect()}
    for name in ("wide", "none"):
        value, slope, error, spread, rest, subjects = dense_trend([r[1:] for r in rows if r[0] == name], level)
        r = got[name]
        assert r["subjects"] == subjects and r["minus_2_loglik"] <= value + 1e-9
        assert abs(r["minus_2_loglik"] - value) < 1e-3 and abs(r["slope"] - slope) < 2e-3 and abs(r["std_error"] - error) < 2e-3
        assert abs(r["sd_subject"] - spread) < 2e-2 and abs(r["sd_residual"] - rest) < 5e-3
    assert got["alone"]["n"] == 1
    assert associate.random_intercept(df.where("false"), "s", "d", "k", "v").count() == 0


def test_trend_plan_reads_rows_once_and_runs_no_python(spark):
    df = spark.createDataFrame([("k", "s", 1, 1.0)], "k string, s string, d int, v double")
    plan = associate.random_intercept(df, "s", "d", "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and plan.count("Scan") == 1


def test_strata_vary_together_as_em_says(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(7):
        b = rng.multivariate_normal([-0.5, 0.6], [[0.5, 0.2], [0.2, 0.3]])
        for _ in range(30 + 25 * s):
            x = float(rng.normal())
            rows.append((f"t{s}", x, bool(rng.random() < 1 / (1 + math.exp(-(b[0] + b[1] * x))))))
    df = spark.createDataFrame(rows, "t string, x double, y boolean")
    got = models.stratum_effects(df, "t", "x", "y", k=5, rounds=200).toPandas().sort_values("t").reset_index(drop=True)
    assert list(got["t"]) == ["t2", "t3", "t4", "t5", "t6"]
    fit = models.logit_fit(models.sufficient_counts(df.withColumn("_one", F.lit(1.0)), ["t"], "y", ["_one", "x"]), ["t"], ["_one", "x"])
    own = {r["t"]: (np.array(r["beta"]), np.array(r["covariance"]).reshape(2, 2)) for r in fit.collect()}
    b, v = np.array([own[t][0] for t in got["t"]]), np.array([own[t][1] for t in got["t"]])
    mean, cov = b.mean(axis=0), np.cov(b.T, bias=True) + v.mean(axis=0)
    for _ in range(200):
        gain = cov @ np.linalg.inv(cov + v)
        m = mean + (gain @ (b - mean)[:, :, None])[:, :, 0]
        c = cov - gain @ cov
        mean = m.mean(axis=0)
        cov = (c + m[:, :, None] * m[:, None, :]).mean(axis=0) - np.outer(mean, mean)
    gain = cov @ np.linalg.inv(cov + v)
    m, c = mean + (gain @ (b - mean)[:, :, None])[:, :, 0], cov - gain @ cov
    assert np.allclose(got[["intercept", "slope"]], m) and np.allclose(got[["c00", "c01", "c11"]], c[:, [0, 0, 1], [0, 1, 1]])
    assert np.allclose(got[["s00", "s01", "s11"]].iloc[0], [cov[0, 0], cov[0, 1], cov[1, 1]])
    drawn = models.stratum_draws(models.stratum_effects(df, "t", "x", "y", k=5, rounds=200), "t", 3000, 2).toPandas()
    for i, t in enumerate(got["t"]):
        some = drawn.loc[drawn["t"] == t, ["b_0", "b_1"]].to_numpy()
        assert np.allclose(some.mean(axis=0), m[i], atol=0.05) and np.allclose(np.cov(some.T), c[i], atol=0.05)


def smoothed(loglik):
    """Smoothed leave-one-out score of one observation, step by step."""
    ll = np.sort(np.array(loglik))[::-1]
    w = ll.min() - ll
    s = len(w)
    m = min(s // 5, math.ceil(3 * math.sqrt(s)))
    cut = math.exp(w[s - m - 1])
    x = np.exp(w[s - m :]) - cut
    k = None
    new = w.copy()
    if m >= 5 and x[int(m / 4 + 0.5) - 1] > 0:
        points = int(30 + math.sqrt(m))
        j = np.arange(1, points + 1)
        b = (1 - np.sqrt(points / (j - 0.5))) / (3 * x[int(m / 4 + 0.5) - 1]) + 1 / x[-1]
        ks = np.log1p(-b[:, None] * x).mean(axis=1)
        ls = m * (np.log(-b / ks) - ks - 1)
        b = float((np.exp(ls - ls.max()) * b).sum() / np.exp(ls - ls.max()).sum())
        raw = float(np.log1p(-b * x).mean())
        k = (raw * m + 5) / (m + 10)
        p = (np.arange(1, m + 1) - 0.5) / m
        new[s - m :] = np.minimum(np.log(-raw / b * np.expm1(-k * np.log1p(-p)) / k + cut), 0)
    return ll.min() + math.log(np.exp(new - w).sum() / np.exp(new).sum()), k


def test_smoothed_scores(spark):
    rng = np.random.default_rng(3)
    arrays = [list(map(float, -rng.gamma(2.0, 0.5 + 0.3 * i, size))) for i, size in enumerate((40, 100, 400, 24, 30))]
    arrays += [[-1.0] * 50, [-0.5] * 59 + [-700.0], [-0.2]]
    df = spark.createDataFrame(list(enumerate(arrays)), "o int, loglik array<double>")
    got = {r["o"]: r for r in dr.smoothed_scores(df).collect()}
    for i, values in enumerate(arrays):
        score, k = smoothed(values)
        assert math.isfinite(got[i]["elpd_loo"]) and abs(got[i]["elpd_loo"] - score) < 1e-8
        assert (got[i]["pareto_k"] is None) == (k is None) and (k is None or abs(got[i]["pareto_k"] - k) < 1e-8)
    # Without a tail to smooth the score is the plain one.
    plain = {r["o"]: r["elpd_loo"] for r in dr.pointwise_scores(df).collect()}
    assert abs(plain[5] - got[5]["elpd_loo"]) < 1e-12 and abs(plain[3] - got[3]["elpd_loo"]) < 1e-9


def test_weights_are_worked_out_once_per_cluster(spark):
    rows = [("m1", f"c{i % 10}", 1.0, float(i % 4), bool(i % 3)) for i in range(400)] + [("m2", f"c{i % 10}", 1.0, float(i % 5), bool(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "m string, c string, one double, x double, y boolean")
    weights = models.cluster_weights(df, "c", 25, 16)
    assert weights.count() == 10 and all(len(r["_w"]) == 26 and r["_w"][0] == 1 for r in weights.collect())
    fits = models.logit_many(df, "m", "y", ["one", "x"], "c", 25, 16).collect()
    assert len(fits) == 2 * 26 * 2 and all(r["converged"] for r in fits)
    by_rounds = models.logit_many(df, "m", "y", ["one", "x"], "c", 25, 16, in_rows=0)
    a, b = ({(r["m"], r["replicate"], r["param"]): r["value"] for r in t} for t in (fits, by_rounds.collect()))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-8 for k in a)
