"""Regression with subject intercepts, and what is computed from such fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import rounded, sql_with
from catalog.model_queries import (
    _COMPARED, _COMPARISON, _GRID, _STRATA_SQL, SQL_ORDER_DRAWS, _count_models, _gappy, _order_draws, _poisson, _unit, ldl_steps, newton_ctes,
)
from cohortloom.functions import fixed_values as fixed
from cohortloom.operators import associate, draws as dr, mixed, models, shape
from cohortloom.plans import event_cohort as ec
from cohortloom.plans.lineage import cut

XS = ["one", "season"]
MODELS = ["F", "O", "P"]
DRAWS = 40
SEASON = 3.5


def _rows(spark, sf_dir):
    """Orders as repeated observations of customers, one model per order status.

    The outcome is an order above what its customer's balance and the season allow, so
    customers differ in their rates and the exposure has an effect.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    month = F.month("o_orderdate") - 6.5
    rows = orders.join(customer, "o_custkey").select(
        F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("order_id"), F.lit(1.0).alias("one"),
        (month / SEASON).alias("season"), (F.col("o_totalprice") > 150000 + 20 * F.col("c_acctbal") - 4000 * month).alias("event"),
    )
    return cut(rows)


def _fit(rows):
    return mixed.mixed_logit(rows, "model", "event", XS, "subject_id")


def mixed_logit(spark, sf_dir):
    """y ~ 1 + exposure + (1 | subject), for three models at once."""
    fits, _ = _fit(_rows(spark, sf_dir))
    return rounded(mixed.parameter_table(fits, "model", XS), "value", "std_error")


def mixed_logit_persistence(spark, sf_dir):
    """y ~ 0 + count + (1 | subject), for all 27 persistence sets, with nodes moved to each subject.

    Without an intercept subjects lie far apart, so nodes that are the same for all would be too coarse.
    """
    fits, _ = mixed.mixed_logit(_count_models(spark, sf_dir), "model", "event", ["low_count"], "subject_id", recentre=2)
    return rounded(mixed.parameter_table(fits, "model", ["low_count"]), "value", "std_error")


#: Points at which the likelihood itself is compared: coefficients and log standard deviation per model.
POINTS = {"F": (-0.2, 0.3, 0.0), "O": (0.4, -0.2, -1.0), "P": (0.1, 0.1, 0.7)}


def mixed_loglik(spark, sf_dir):
    """Marginal log-likelihood and its gradient at fixed points."""
    points = spark.createDataFrame([(m, list(t)) for m, t in POINTS.items()], "model string, theta array<double>")
    out = mixed.loglik_at(_rows(spark, sf_dir), "model", "event", XS, "subject_id", points, bound=len(MODELS))
    names = ["g_one", "g_season", "g_log_sd"]
    out = out.select("model", F.col("subjects").cast("long").alias("subjects"), "loglik", *[F.col("score")[i].alias(n) for i, n in enumerate(names)])
    return rounded(out, "loglik", *names)


def subject_effects(spark, sf_dir):
    """Posterior mean and deviation of every subject's intercept."""
    _, effects = _fit(_rows(spark, sf_dir))
    return rounded(effects, "effect", "effect_sd")


def _drawn(rows, fits, effects, draws):
    """Coefficient draws 0.. of the fit, and the subjects' effects for the same draws."""
    wide = cut(mixed.parameter_draws(fits, "model", XS, draws, 16))
    return wide, mixed.effect_draws(effects, "model", "subject_id", range(draws), 16, packed=True)


def _fitted(rows, grid, draws, packed=False, numbered=False):
    fits, effects = _fit(rows)
    wide, drawn = _drawn(rows, fits, effects, draws)
    return dr.fitted_draws(
        grid, wide, "model", "draw", "b_one", {"b_season": "season"}, len(MODELS), drawn, ["model", "subject_id"], draws_bound=draws, packed=packed, numbered=numbered
    )


def fitted_draws_of_mixed_fit(spark, sf_dir):
    """Predictions over a grid with intercepts drawn from each subject's posterior."""
    rows = _rows(spark, sf_dir)
    out = _fitted(rows, dr.packed_grid(rows, "season", "subject_id", "model", len(MODELS), 5), 8)
    out = out.select("model", "subject_id", F.col("point").cast("long").alias("point"), "draw", "fitted")
    return rounded(out, "fitted")


def _scales(spark, sf_dir):
    """Mean and deviation under which the exposure becomes a month again."""
    return spark.createDataFrame([(m, 6.5, SEASON) for m in MODELS], "model string, mean double, sd double")


def ribbon_of_mixed_fit(spark, sf_dir):
    """From rows over fit, posterior intercepts and draws to bands along the exposure."""
    rows = _rows(spark, sf_dir)
    fitted = _fitted(rows, dr.packed_grid(rows, "season", "subject_id", "model", len(MODELS), 10), DRAWS, packed=True)
    out = dr.ribbon(fitted, _scales(spark, sf_dir), ["model"], len(MODELS), ["model", "point"], "season", group_bound=30)
    out = out.select("model", F.col("point").cast("long").alias("point"), "season_raw", "width", "median", "lower", "upper")
    return rounded(out, "season_raw", "median", "lower", "upper")


def contrast_of_mixed_fit(spark, sf_dir):
    """Predictions one deviation above and below the mean, and their difference within subject and draw."""
    entries = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("season")) for n, v in (("high", 1.0), ("mid", 0.0), ("low", -1.0))])
    rows = _rows(spark, sf_dir)
    grid = rows.select("model", "subject_id").distinct().withColumn("points", entries)
    out = dr.contrast(_fitted(rows, grid, DRAWS, packed=True), ["model"], ["subject_id"], "level", ["low", "mid", "high"], "high", "low", group_bound=3)
    return rounded(out, "estimate", "lower", "upper", "width")


def predictive_check_of_mixed_fit(spark, sf_dir):
    """Replicated event rates of the fitted model, subject by subject, against the observed one."""
    rows = _rows(spark, sf_dir)
    fitted = _fitted(rows, rows.select("model", "subject_id", "order_id", "season", "event"), DRAWS, packed=True, numbered=True)
    return rounded(dr.predictive_check(fitted, ["model"], "draw", ["order_id"], "event", 16), "replicated_rate", "observed_rate", "expected_rate")


LOO_DRAWS = 60


def _formula_scores(spark, sf_dir):
    """Two formulas on the same orders, of every status, with and without the exposure, each with subject intercepts; scores of every order."""
    rows = _rows(spark, sf_dir).drop("model")
    entries = F.array(F.struct(F.lit("level").alias("model"), F.lit(0.0).alias("season")), F.struct(F.lit("season").alias("model"), F.col("season")))
    rows = cut(rows.select("subject_id", "order_id", "one", "event", F.inline(entries)))
    fitted = _fitted(rows, rows, LOO_DRAWS, packed=True)
    signed = F.transform("fitted", lambda p: F.log(F.when(F.col("event"), p).otherwise(1.0 - p)))
    arrays = dr.loglik_arrays(fitted.withColumn("l", signed), "model", ["order_id"], "l")
    return dr.smoothed_scores(arrays)


def smoothed_scores(spark, sf_dir):
    """Leave-one-out scores with smoothed tails, and the shape of each tail."""
    return rounded(_formula_scores(spark, sf_dir), "lpd", "p_waic", "elpd_loo", "elpd_waic", "pareto_k")


def compare_mixed_formulas(spark, sf_dir):
    """Is the exposure worth its place beside subject intercepts?"""
    out = dr.compare_models(_formula_scores(spark, sf_dir), "model", ["order_id"])
    return rounded(out, *[c for c in out.columns if c not in ("model", "observations")])


STRATA, STRATUM_DRAWS, POINTS_ALONG = 6, 60, 8


def _strata(spark, sf_dir):
    rows = shape.censor_at_first(ec.cohort(spark, sf_dir), "subject_id", "date", "first_suspected")
    rows = shape.zscore(rows.select("subject_id", "subject_day", "max_read_prop", "dominant_taxon", F.col("suspected").alias("event")), ["max_read_prop"])
    return cut(rows)


def stratum_effects(spark, sf_dir):
    """Intercept and slope of the most frequent strata, varying together."""
    out = models.stratum_effects(_strata(spark, sf_dir), "dominant_taxon", "max_read_prop_scaled", "event", STRATA)
    return rounded(out.drop("change"), *[c for c in out.columns if c not in ("dominant_taxon", "n", "events", "change")])


def stratum_bands(spark, sf_dir):
    """Predictions along the exposure for each stratum, from draws of its intercept and slope."""
    rows = _strata(spark, sf_dir)
    effects = cut(models.stratum_effects(rows, "dominant_taxon", "max_read_prop_scaled", "event", STRATA))
    draws = models.stratum_draws(effects, "dominant_taxon", STRATUM_DRAWS, 16)
    shown = rows.join(F.broadcast(effects.select("dominant_taxon")), "dominant_taxon").withColumn("level", F.col("dominant_taxon"))
    grid = dr.packed_grid(shown, "max_read_prop_scaled", "level", "dominant_taxon", STRATA, POINTS_ALONG)
    fitted = dr.fitted_draws(grid, draws, "dominant_taxon", "draw", "b_0", {"b_1": "max_read_prop_scaled"}, STRATA, draws_bound=STRATUM_DRAWS)
    out = dr.median_qi(fitted.withColumn("point", F.col("point").cast("long")), ["dominant_taxon", "point"], "fitted", [0.95], draws_bound=STRATUM_DRAWS)
    return rounded(out, "width", "median", "lower", "upper")


def smooth_density(spark, sf_dir):
    """Kernel densities of the draws of every model and parameter."""
    out = dr.smooth_density(_order_draws(spark, sf_dir), ["model", "param"], "value", points=48, group_bound=12)
    return rounded(out.withColumn("point", F.col("point").cast("long")), "bandwidth", "x", "density")


PAIRS = [("shannon", "log_abundance"), ("max_read_prop", "log_abundance"), ("shannon", "max_read_prop")]
RESAMPLED = 60


def correlate_resampled(spark, sf_dir):
    """Correlations with intervals over resampled subjects."""
    rows = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_confirmed")
    out = associate.correlate_resampled(rows, PAIRS, "subject_id", RESAMPLED)
    return rounded(out, "estimate", "lower", "upper")


QUERIES = {
    "smooth_density": smooth_density,
    "correlate_resampled": correlate_resampled,
    "smoothed_scores": smoothed_scores,
    "compare_mixed_formulas": compare_mixed_formulas,
    "stratum_effects": stratum_effects,
    "stratum_bands": stratum_bands,
    "mixed_logit": mixed_logit,
    "mixed_logit_persistence": mixed_logit_persistence,
    "mixed_loglik": mixed_loglik,
    "subject_effects": subject_effects,
    "fitted_draws_of_mixed_fit": fitted_draws_of_mixed_fit,
    "ribbon_of_mixed_fit": ribbon_of_mixed_fit,
    "contrast_of_mixed_fit": contrast_of_mixed_fit,
    "predictive_check_of_mixed_fit": predictive_check_of_mixed_fit,
}


def _nodes():
    t, lw = mixed.quadrature(mixed.NODES)
    listed = ", ".join(f"({i}, {float(2**0.5 * a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for i, (a, b) in enumerate(zip(t, lw)))
    return f"nodes AS (SELECT * FROM (VALUES {listed}) AS v(q, u, lw))"


def _terms(patterns, at, xs):
    """Sums per node, then per subject, then per model, of the marginal likelihood at the points ``at`` (model, t0..)."""
    k = len(xs)
    ts = ", ".join(f"t{i}" for i in range(k + 1))
    eta = " + ".join([*[f"t{i} * {x}" for i, x in enumerate(xs)], f"exp(t{k}) * u"])
    sums = ["sum(e * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) AS ll", "sum(r) AS r", "sum(w) AS w"]
    sums += [f"sum({x} * r) AS r{i}" for i, x in enumerate(xs)] + [f"sum({x} * w) AS w{i}" for i, x in enumerate(xs)]
    sums += [f"sum({xs[i]} * {xs[j]} * w) AS w{i}_{j}" for i in range(k) for j in range(i + 1)]
    node = f"""SELECT model, subject_id, {ts}, q, u, lw, {", ".join(sums)} FROM (
      SELECT *, e - n * p AS r, n * p * (1 - p) AS w FROM (
        SELECT *, 1 / (1 + exp(-eta)) AS p FROM (SELECT *, {eta} AS eta FROM {patterns} JOIN {at} USING (model), nodes)))
      GROUP BY model, subject_id, {ts}, q, u, lw"""
    g = [*[f"r{i}" for i in range(k)], "v * r"]
    h = {(i, j): f"-w{i}_{j}" for i in range(k) for j in range(i + 1)}
    h |= {(k, j): f"-v * w{j}" for j in range(k)} | {(k, k): "-v * v * w + v * r"}
    means = [f"sum(share * ({x})) AS s{i}" for i, x in enumerate(g)]
    means += [f"sum(share * ({x} + ({g[i]}) * ({g[j]}))) AS c{i}_{j}" for (i, j), x in h.items()]
    subject = f"""SELECT model, subject_id, {ts}, any_value(top) + ln(any_value(total)) AS loglik, {", ".join(means)},
        sum(share * u) AS mean, sum(share * u * u) AS square FROM (
      SELECT *, exp(ll + lw - top) / total AS share FROM (
        SELECT *, sum(exp(ll + lw - top)) OVER (PARTITION BY model, subject_id) AS total FROM (
          SELECT *, exp(t{k}) * u AS v, max(ll + lw) OVER (PARTITION BY model, subject_id) AS top FROM ({node}))))
      GROUP BY model, subject_id, {ts}"""
    return subject, list(h)


def mixed_ctes(patterns, xs, start, rounds=30, name="mixed"):
    """CTE ``mixed`` (model, t0.., se0.., covariance c0_0..): unrolled Newton rounds with steps of at most 0.5, from ``start`` (model, t0..)."""
    k, m = len(xs), len(xs) + 1
    ts = ", ".join(f"t{i}" for i in range(m))
    parts = [_nodes(), f"m0 AS MATERIALIZED ({start})"]
    for t in range(1, rounds + 1):
        subject, cells = _terms(patterns, f"m{t - 1}", xs)
        g = [f"sum(s{i}){f' - 1e-3 * t{i}' if i < k else ''} AS g{i}" for i in range(m)]
        h = [f"-sum(c{i}_{j} - s{i} * s{j}){' + 1e-3' if i == j and i < k else ''} AS h{i}_{j}" for i, j in cells]
        body = f"SELECT model, {ts}, {', '.join([*g, *h])} FROM ({subject}) GROUP BY model, {ts}"
        for step in ldl_steps(m):
            body = f"SELECT *, {', '.join(step)} FROM ({body})"
        largest = ", ".join(f"abs(s{i})" for i in range(m))
        moved = ", ".join([f"t{i} + s{i} * least(1.0, 0.5 / greatest({largest}, 1e-300)) AS t{i}" for i in range(m)])
        kept = ", ".join([f"se{i}" for i in range(m)] + [f"h{i}_{j}" for i, j in cells])
        parts.append(f"m{t} AS MATERIALIZED (SELECT model, {moved}, {kept} FROM ({body}))")
    parts.append(f"{name} AS (SELECT * FROM m{rounds})")
    return ",\n".join(parts)


_PATTERNS = f"""WITH model_rows AS MATERIALIZED (
  SELECT o_orderstatus AS model, o_custkey AS subject_id, o_orderkey AS order_id, (month(o_orderdate) - 6.5) / {SEASON} AS season,
         o_totalprice > 150000 + 20 * c_acctbal - 4000 * (month(o_orderdate) - 6.5) AS event FROM orders JOIN customer ON c_custkey = o_custkey),
counts AS MATERIALIZED (SELECT model, season AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event) AS DOUBLE) AS e FROM model_rows GROUP BY 1, 2),
patterns AS MATERIALIZED (
  SELECT model, subject_id, 1.0::DOUBLE AS one, season AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event) AS DOUBLE) AS e
  FROM model_rows GROUP BY 1, 2, 3, 4),
"""

_START = "SELECT model, b0 AS t0, b1 AS t1, 0.0::DOUBLE AS t2 FROM fit"
_MIXED = _PATTERNS + newton_ctes("counts", ["model"], "x") + ",\n" + mixed_ctes("patterns", ["one", "x"], _START)
_SUBJECTS = _MIXED + f""",
met AS MATERIALIZED ({_terms("patterns", "mixed", ["one", "x"])[0]}),
effects AS MATERIALIZED (SELECT model, subject_id, exp(t2) * mean AS effect, exp(t2) * sqrt(square - mean * mean) AS effect_sd FROM met)"""


def _normal(*cols):
    return f"(sqrt(-2.0 * ln({_unit(16, *cols, chr(39) + 'a' + chr(39))} + {0.5 / 4294967296.0!r})) * cos({2.0 * 3.141592653589793!r} * {_unit(16, *cols, chr(39) + 'b' + chr(39))}))"


# Information at the fit, its inverse by cofactors, the inverse's triangular factor, and draws made with it.
_, _CELLS = _terms("patterns", "mixed", ["one", "x"])
_DRAWN = _SUBJECTS + f""",
information AS (
  SELECT model, t0, t1, {", ".join(f"-sum(c{i}_{j} - s{i} * s{j}){' + 1e-3' if i == j and i < 2 else ''} AS h{i}_{j}" for i, j in _CELLS)}
  FROM met GROUP BY ALL),
inverse AS (
  SELECT model, t0, t1, (h1_1 * h2_2 - h2_1 * h2_1) / d AS c00, (h2_0 * h2_1 - h1_0 * h2_2) / d AS c10, (h1_0 * h2_1 - h2_0 * h1_1) / d AS c20,
         (h0_0 * h2_2 - h2_0 * h2_0) / d AS c11
  FROM (SELECT *, h0_0 * (h1_1 * h2_2 - h2_1 * h2_1) - h1_0 * (h1_0 * h2_2 - h2_1 * h2_0) + h2_0 * (h1_0 * h2_1 - h1_1 * h2_0) AS d FROM information)),
factor AS (SELECT *, sqrt(c00) AS l00, c10 / sqrt(c00) AS l10, sqrt(c11 - c10 * c10 / c00) AS l11 FROM inverse),
drawn AS (
  SELECT model, draw, t0 + l00 * z0 AS b0, t1 + l10 * z0 + l11 * z1 AS b1
  FROM (SELECT *, {_normal("model", "draw", "0")} AS z0, {_normal("model", "draw", "1")} AS z1 FROM factor, (SELECT range AS draw FROM range({{draws}})))),
moved AS (
  SELECT model, subject_id, draw, effect + effect_sd * {_normal("model", "subject_id", "draw")} AS effect
  FROM effects, (SELECT range AS draw FROM range({{draws}})))"""
_GRID_OF_SEASONS = _GRID.replace("shannon_scaled", "season")
_PREDICTED = """,
fitted AS (SELECT g.*, draw, 1 / (1 + exp(-(b0 + b1 * season + effect))) AS fitted FROM {grid} g JOIN drawn USING (model) JOIN moved USING (model, subject_id, draw))"""


def _parameters(names):
    return " UNION ALL ".join(
        f"SELECT model, '{x}' AS param, round(t{i}, 6) + 0.0 AS value, round(se{i}, 6) AS std_error, true AS converged FROM mixed" for i, x in enumerate(names)
    )


def _with(ctes, body):
    return ctes + "\n" + body.strip()


# Tails of the weights as lists: the largest M, a grid of scales, the fitted quantiles.
_LOO_ROWS = """WITH model_rows AS MATERIALIZED (
  SELECT f.model, o_custkey AS subject_id, o_orderkey AS order_id, CASE f.model WHEN 'season' THEN (month(o_orderdate) - 6.5) / 3.5 ELSE 0.0 END AS season,
         o_totalprice > 150000 + 20 * c_acctbal - 4000 * (month(o_orderdate) - 6.5) AS event
  FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('level'), ('season')) AS f(model)),"""
_LOO = _LOO_ROWS + _DRAWN[_DRAWN.index("\ncounts AS"):].format(draws=LOO_DRAWS) + _PREDICTED.format(grid="model_rows") + """,
weights AS (
  SELECT model, order_id, ln(avg(exp(l))) AS lpd, var_samp(l) AS p_waic, ln(avg(exp(l))) - var_samp(l) AS elpd_waic, min(l) AS low,
         list_sort(list_transform(list(l), lambda v: min(l) - v)) AS w, count(*) AS s, CAST(least(floor(count(*) / 5.0), ceil(3 * sqrt(count(*)))) AS INTEGER) AS m
  FROM (SELECT model, order_id, ln(CASE WHEN event THEN fitted ELSE 1 - fitted END) AS l FROM fitted) GROUP BY 1, 2),
tails AS (
  SELECT *, x[CAST(floor(m / 4.0 + 0.5) AS INTEGER)] AS quarter, x[m] AS largest, floor(30 + sqrt(m)) AS points FROM (
    SELECT *, list_transform(w[s - m + 1:], lambda v: exp(v) - cut) AS x FROM (SELECT *, exp(w[s - m]) AS cut FROM weights))),
grids AS (
  SELECT *, list_transform(bs, lambda b: list_sum(list_transform(x, lambda v: ln(1 - b * v))) / m) AS ks FROM (
    SELECT *, list_transform(range(1, CAST(points AS INTEGER) + 1), lambda j: (1 - sqrt(points / (j - 0.5))) / (3 * quarter) + 1 / largest) AS bs
    FROM tails WHERE quarter > 0)),
scaled AS (
  SELECT *, list_sum(list_transform(range(1, len(bs) + 1), lambda i: exp(ls[i] - top) * bs[i])) / list_sum(list_transform(ls, lambda l: exp(l - top))) AS b FROM (
    SELECT *, list_max(ls) AS top FROM (
      SELECT *, list_transform(range(1, len(bs) + 1), lambda i: m * (ln(-bs[i] / ks[i]) - ks[i] - 1)) AS ls FROM grids))),
shaped AS (
  SELECT *, (raw * m + 5) / (m + 10) AS k, -raw / b AS sigma FROM (SELECT *, list_sum(list_transform(x, lambda v: ln(1 - b * v))) / m AS raw FROM scaled)),
renewed AS (
  SELECT *, list_concat(w[:s - m], list_transform(range(1, m + 1), lambda i: least(ln(sigma * (exp(-k * ln(1 - (i - 0.5) / m)) - 1) / k + cut), 0.0))) AS new FROM shaped),
scores AS (
  SELECT model, order_id, lpd, p_waic, elpd_waic, k AS pareto_k,
         low + ln(list_sum(list_transform(range(1, s + 1), lambda i: exp(new[i] - w[i]))) / list_sum(list_transform(new, lambda v: exp(v)))) AS elpd_loo
  FROM renewed
  UNION ALL
  SELECT model, order_id, lpd, p_waic, elpd_waic, NULL, low + ln(s / list_sum(list_transform(w, lambda v: exp(v)))) FROM tails WHERE quarter <= 0)"""

# EM over the strata's own estimates, one recursive step a round.
_POSTERIOR = """
  SELECT *, m0 + g00 * (b0 - m0) + g01 * (b1 - m1) AS p0, m1 + g10 * (b0 - m0) + g11 * (b1 - m1) AS p1,
         s00 - g00 * s00 - g01 * s01 AS c00, s01 - g00 * s01 - g01 * s11 AS c01, s11 - g10 * s01 - g11 * s11 AS c11
  FROM (SELECT *, (s00 * (s11 + v11) - s01 * (s01 + v01)) / det AS g00, (s01 * (s00 + v00) - s00 * (s01 + v01)) / det AS g01,
               (s01 * (s11 + v11) - s11 * (s01 + v01)) / det AS g10, (s11 * (s00 + v00) - s01 * (s01 + v01)) / det AS g11
        FROM (SELECT *, (s00 + v00) * (s11 + v11) - (s01 + v01) * (s01 + v01) AS det FROM {em}, estimates))"""
_MOMENTS = "avg(p0) AS m0, avg(p1) AS m1, avg(c00 + p0 * p0) - avg(p0) * avg(p0) AS s00, avg(c01 + p0 * p1) - avg(p0) * avg(p1) AS s01, avg(c11 + p1 * p1) - avg(p1) * avg(p1) AS s11"
_EM = (
    sql_with(
        _STRATA_SQL.replace("LIMIT 4", f"LIMIT {STRATA}") + newton_ctes("counts", ["dominant_taxon"], "x") + f""",
estimates AS MATERIALIZED (
  SELECT dominant_taxon, n, events, b0, b1, h11 / (h00 * h11 - h01 * h01) AS v00, -h01 / (h00 * h11 - h01 * h01) AS v01, h00 / (h00 * h11 - h01 * h01) AS v11
  FROM (SELECT dominant_taxon, b0, b1, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events, sum(n * p * (1 - p)) + 1e-3 AS h00,
               sum(x * n * p * (1 - p)) AS h01, sum(x * x * n * p * (1 - p)) + 1e-3 AS h11
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM counts JOIN fit USING (dominant_taxon)) GROUP BY 1, 2, 3)),
em AS (
  SELECT 0 AS i, {_MOMENTS} FROM (SELECT b0 AS p0, b1 AS p1, v00 AS c00, v01 AS c01, v11 AS c11 FROM estimates)
  UNION ALL
  SELECT i + 1, {_MOMENTS} FROM ({_POSTERIOR.format(em="(SELECT * FROM em WHERE i < 500)")}) GROUP BY i),
effects AS MATERIALIZED ({_POSTERIOR.format(em="(SELECT * FROM em WHERE i = 500)")})""",
        "",
    ).replace("WITH", "WITH RECURSIVE", 1)
)

_DENSITY = SQL_ORDER_DRAWS + """,
stats AS (
  SELECT model, param, count(*) AS n, min(value) AS lo, max(value) AS hi, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(count(*), -0.2) AS h
  FROM draws JOIN (SELECT model, param, stddev_samp(value) AS sd, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr FROM draws GROUP BY 1, 2) USING (model, param)
  GROUP BY 1, 2, iqr, sd),
placed AS (SELECT model, param, n, h, lo - 3 * h AS f, (hi - lo + 6 * h) / 47 AS d, (value - (lo - 3 * h)) / ((hi - lo + 6 * h) / 47) AS spot FROM draws JOIN stats USING (model, param)),
shares AS (
  SELECT model, param, n, h, f, d, floor(spot) AS bin, 1 - (spot - floor(spot)) AS w FROM placed
  UNION ALL SELECT model, param, n, h, f, d, floor(spot) + 1, spot - floor(spot) FROM placed),
bins AS (SELECT model, param, any_value(n) AS n, any_value(h) AS h, any_value(f) AS f, any_value(d) AS d, bin, sum(w) AS w FROM shares GROUP BY model, param, bin)
SELECT model, param, round(any_value(h), 6) AS bandwidth, range AS point, round(any_value(f + d * range), 6) + 0.0 AS x,
       round(sum(w * exp(-0.5 * ((bin - range) * d / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) + 0.0 AS density
FROM bins, range(48) GROUP BY model, param, range"""
_RESAMPLED = sql_with(
    "kept AS (SELECT * FROM gappy WHERE date <= coalesce(first_confirmed, DATE '9999-01-01')),\npairs AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, subject_id, {x} AS a, {y} AS b FROM kept WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS)
    + f"""),
weights AS (
  SELECT range AS replicate, subject_id, CASE WHEN range = 0 THEN 1 ELSE {_poisson("u")} END AS w
  FROM (SELECT range, subject_id, {_unit(16, "range", "subject_id")} AS u FROM (SELECT DISTINCT subject_id FROM pairs), range({RESAMPLED + 1}))),
means AS (
  SELECT x, y, replicate, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM pairs JOIN weights USING (subject_id) WHERE w > 0 GROUP BY 1, 2, 3),
refits AS (
  SELECT x, y, replicate, any_value(n) AS n, sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) ** 2) * sum(w * (b - mb) ** 2)) AS r
  FROM pairs JOIN weights USING (subject_id) JOIN means USING (x, y, replicate) WHERE w > 0 GROUP BY 1, 2, 3)""",
    """
SELECT x, y, CAST(max(n) FILTER (replicate = 0) AS BIGINT) AS n, round(max(r) FILTER (replicate = 0), 6) + 0.0 AS estimate,
       round(quantile_cont(r, 0.025) FILTER (replicate > 0), 6) + 0.0 AS lower, round(quantile_cont(r, 0.975) FILTER (replicate > 0), 6) + 0.0 AS upper,
       count(r) FILTER (replicate > 0) AS replicates FROM refits GROUP BY 1, 2""",
)

ORACLE = {
    "smooth_density": _DENSITY,
    "correlate_resampled": _RESAMPLED,
    "smoothed_scores": _LOO + """
SELECT model, order_id, round(lpd, 6) AS lpd, round(p_waic, 6) AS p_waic, round(elpd_loo, 6) AS elpd_loo, round(elpd_waic, 6) AS elpd_waic,
       round(pareto_k, 6) AS pareto_k FROM scores""",
    "compare_mixed_formulas": _LOO + _COMPARED.replace("USING (subject_id, subject_day)", "USING (order_id)") + "\n" + _COMPARISON,
    "stratum_effects": _EM + """
SELECT dominant_taxon, n, events, """ + ", ".join(
        f"round({c}, 6) + 0.0 AS {a}"
        for c, a in [("b0", "b0"), ("b1", "b1"), ("p0", "intercept"), ("p1", "slope"), *[(c, c) for c in ("c00", "c01", "c11")],
                     ("m0", "mean_intercept"), ("m1", "mean_slope"), *[(c, c) for c in ("s00", "s01", "s11")]]
    ) + " FROM effects",
    "stratum_bands": _EM + f""",
drawn AS (
  SELECT dominant_taxon, draw, p0 + sqrt(greatest(c00, 0)) * z0 AS b_0,
         p1 + coalesce(c01 / nullif(sqrt(greatest(c00, 0)), 0), 0) * z0
         + sqrt(greatest(c11 - coalesce(c01 / nullif(sqrt(greatest(c00, 0)), 0), 0) ** 2, 0)) * z1 AS b_1
  FROM (SELECT *, {_normal("dominant_taxon", "draw", "0")} AS z0, {_normal("dominant_taxon", "draw", "1")} AS z1 FROM effects, (SELECT range AS draw FROM range({STRATUM_DRAWS})))),
reach AS (SELECT dominant_taxon, min(z) AS lo, max(z) AS hi FROM z GROUP BY 1)
SELECT dominant_taxon, point, round(median(f), 6) AS median, CAST(0.95 AS DOUBLE) AS width, round(quantile_cont(f, {(1 - 0.95) / 2!r}), 6) AS lower,
       round(quantile_cont(f, {(1 + 0.95) / 2!r}), 6) AS upper
FROM (SELECT dominant_taxon, range AS point, 1 / (1 + exp(-(b_0 + b_1 * (lo + (hi - lo) / {POINTS_ALONG - 1} * range)))) AS f
      FROM drawn JOIN reach USING (dominant_taxon), range({POINTS_ALONG})) GROUP BY 1, 2""",
    "mixed_logit": _MIXED + " " + _parameters([*XS, "log_sd"]),
    "mixed_loglik": _with(
        _PATTERNS + _nodes() + ",\npoints AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {', '.join(f'{x}::DOUBLE' for x in t)})" for m, t in POINTS.items())
        + ") AS v(model, t0, t1, t2)),\nmet AS (" + _terms("patterns", "points", ["one", "x"])[0] + ")",
        """
SELECT model, count(*) AS subjects, round(sum(loglik), 6) AS loglik, round(sum(s0), 6) + 0.0 AS g_one, round(sum(s1), 6) + 0.0 AS g_season,
       round(sum(s2), 6) + 0.0 AS g_log_sd FROM met GROUP BY 1""",
    ),
    "subject_effects": _with(_SUBJECTS, "SELECT model, subject_id, round(effect, 6) + 0.0 AS effect, round(effect_sd, 6) AS effect_sd FROM effects"),
    "fitted_draws_of_mixed_fit": _with(
        _DRAWN.format(draws=8) + _GRID_OF_SEASONS.format(n=5) + _PREDICTED.format(grid="grid"),
        "SELECT model, subject_id, point, draw, round(fitted, 6) AS fitted FROM fitted",
    ),
    "ribbon_of_mixed_fit": _with(
        _DRAWN.format(draws=DRAWS) + _GRID_OF_SEASONS.format(n=10) + _PREDICTED.format(grid="grid"),
        " UNION ALL ".join(
            f"SELECT model, point, round(any_value(season * 3.5 + 6.5), 6) + 0.0 AS season_raw, CAST({w} AS DOUBLE) AS width, "
            f"round(median(fitted), 6) AS median, round(quantile_cont(fitted, {(1 - w) / 2!r}), 6) AS lower, "
            f"round(quantile_cont(fitted, {(1 + w) / 2!r}), 6) AS upper FROM fitted GROUP BY model, point"
            for w in fixed.INTERVAL_WIDTHS
        ),
    ),
    "contrast_of_mixed_fit": _with(
        _DRAWN.format(draws=DRAWS) + """,
points AS (SELECT m.model, m.subject_id, level, season FROM (SELECT DISTINCT model, subject_id FROM model_rows) m,
  (VALUES ('high', 1.0::DOUBLE), ('mid', 0.0), ('low', -1.0)) AS t(level, season))""" + _PREDICTED.format(grid="points") + """,
wide AS (SELECT model, subject_id, draw, max(fitted) FILTER (level = 'low') AS low, max(fitted) FILTER (level = 'mid') AS mid,
         max(fitted) FILTER (level = 'high') AS high FROM fitted GROUP BY 1, 2, 3),
long_values AS (SELECT model, 'low' AS posterior, low AS value FROM wide UNION ALL SELECT model, 'mid', mid FROM wide
         UNION ALL SELECT model, 'high', high FROM wide UNION ALL SELECT model, 'contrast', high - low FROM wide)""",
        """
SELECT model, posterior, round(median(value), 6) + 0.0 AS estimate, CAST(0.95 AS DOUBLE) AS width,
       round(quantile_cont(value, 0.025), 6) + 0.0 AS lower, round(quantile_cont(value, 0.975), 6) + 0.0 AS upper FROM long_values GROUP BY 1, 2""",
    ),
    "predictive_check_of_mixed_fit": _with(
        _DRAWN.format(draws=DRAWS) + _PREDICTED.format(grid="model_rows"),
        f"""
SELECT model, draw, round(avg(CASE WHEN {_unit(16, "draw", "order_id")} < fitted THEN 1.0 ELSE 0.0 END), 6) AS replicated_rate,
       round(avg(CAST(event AS INTEGER)), 6) AS observed_rate, round(avg(fitted), 6) AS expected_rate FROM fitted GROUP BY 1, 2""",
    ),
}
