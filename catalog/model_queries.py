"""Draws, predictions and many-model regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import r6, rounded, sql, sql_with
from catalog.persist_queries import ORACLE as PERSIST_ORACLE
from catalog.persist_queries import counted_ctes, grid_rows
from cohortloom.functions import fixed_values as fixed
from cohortloom.functions.scalars import poisson_one_cuts
from cohortloom.operators import define, draws as dr, models, persist, shape
from cohortloom.plans import event_cohort as ec
from cohortloom.plans.lineage import cut

DAY = ["subject_id", "subject_day"]
N_DRAWS = 200
MODELS = list(ec.OUTCOMES)


def _gappy(spark, sf_dir):
    return ec.with_missing(ec.cohort(spark, sf_dir))


def _order_draws(spark, sf_dir):
    """A draws table derived from orders: one draw per order, model by priority, parameter by status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.col("o_orderstatus")
    return orders.select(
        F.concat(F.lit("m_"), F.when(F.col("o_orderkey") % 3 == 0, "sv_").when(F.col("o_orderkey") % 3 == 1, "svp_").otherwise("svaps_"),
                 F.when(status == "O", "shannon").otherwise("max_read_prop")).alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, "b_shannon_low_count").otherwise("b_max_read_prop_high_count").alias("param"),
        F.col("o_orderkey").alias("draw"),
        ((F.col("o_totalprice") - 250000) / 400000).alias("value"),
    )


SQL_ORDER_DRAWS = """
WITH draws AS (
  SELECT 'm_' || CASE o_orderkey % 3 WHEN 0 THEN 'sv_' WHEN 1 THEN 'svp_' ELSE 'svaps_' END
         || CASE WHEN o_orderstatus = 'O' THEN 'shannon' ELSE 'max_read_prop' END AS model,
         CASE WHEN o_orderkey % 2 = 0 THEN 'b_shannon_low_count' ELSE 'b_max_read_prop_high_count' END AS param,
         o_orderkey AS draw, (o_totalprice - 250000) / 400000 AS value FROM orders)"""


def draws_summary(spark, sf_dir):
    out = dr.draws_summary(_order_draws(spark, sf_dir), ["model", "param"], group_bound=12)
    return rounded(out, *[c for c in out.columns if c not in ("model", "param")])


def estimates_grid(spark, sf_dir):
    summary = dr.draws_summary(_order_draws(spark, sf_dir), ["model", "param"], group_bound=12)
    out = dr.estimates_grid(
        summary.select("model", "param", "estimate_or", "q2_5_or", "q97_5_or"),
        "model", "param", ["shannon", "max_read_prop", "log_copy_16S_per_ml_sputum"], fixed.OUTCOME_LABELS,
    )
    return rounded(out, "estimate_or", "q2_5_or", "q97_5_or")


def median_qi(spark, sf_dir):
    out = dr.median_qi(_order_draws(spark, sf_dir), ["param"], "value", fixed.INTERVAL_WIDTHS, group_bound=2)
    return rounded(out, "width", "median", "lower", "upper")


def median_qi_forty_widths(spark, sf_dir):
    widths = [round(0.025 * i - 0.0125, 4) for i in range(1, 41)]
    out = dr.median_qi(_order_draws(spark, sf_dir), ["model"], "value", widths, group_bound=6)
    return rounded(out, "width", "median", "lower", "upper")


def median_qi_of_bootstrap(spark, sf_dir):
    """Intervals of draws whose number is a setting, so that built-in percentiles apply."""
    wide = _coefficient_draws(_stored_rows(spark, sf_dir))
    long = shape.to_long(wide, ["model", "draw"], ["b_0", "b_1"], "param")
    out = dr.median_qi(long, ["model", "param"], "value", fixed.INTERVAL_WIDTHS, draws_bound=N_DRAWS)
    return rounded(out, "width", "median", "lower", "upper")


def median_qi_any_groups(spark, sf_dir):
    """No bound on groups or on group size."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_extendedprice")
    out = dr.median_qi(items, ["l_suppkey"], "l_extendedprice", [0.5, 0.95])
    return rounded(out, "width", "median", "lower", "upper")


def direction_share(spark, sf_dir):
    return rounded(dr.direction_share(_order_draws(spark, sf_dir), ["model", "param"], "value"), "share_above")


def binned_density(spark, sf_dir):
    return rounded(dr.binned_density(_order_draws(spark, sf_dir), ["param"], "value", -1.0, 0.125), "density")


def _kept_rows(gappy):
    """Rows up to the first event under each definition, keyed by model."""
    entries = [F.struct(F.lit(name).alias("model"), F.col(flag).alias("event"), F.col(first).alias("_first")) for name, (flag, first, _) in ec.OUTCOMES.items()]
    long = gappy.select(*DAY, "date", "shannon", "log_abundance", F.inline(F.array(*entries)))
    return shape.censor_at_first(long, "subject_id", "date", "_first").drop("_first", "date")


def _model_rows(gappy):
    """Standardised exposure and outcome per definition: censored, scaled, complete."""
    return shape.zscore(_kept_rows(gappy), ["shannon", "log_abundance"], by="model", levels=len(MODELS)).dropna()


def _stored_rows(spark, sf_dir):
    return cut(_model_rows(_gappy(spark, sf_dir)))


def _scales(gappy):
    return _kept_rows(gappy).groupBy("model").agg(F.avg("shannon").alias("mean"), F.stddev_samp("shannon").alias("sd"))


def _coefficient_draws(rows):
    """Draws 0..N-1 of intercept and slope per model.

    The intercept is centred on the model's event rate in the whole cohort; the spread over
    draws follows a fixed rule, so that SQL can repeat it.
    """
    rates = rows.groupBy("model").agg(F.avg(F.col("event").cast("double")).alias("rate"))
    m = F.array_position(F.array(*[F.lit(x) for x in MODELS]), F.col("model"))

    def spread(shift):
        return (F.col("draw") * 7919 + (m + shift) * 104729) % 10007 / 10007.0 - 0.4

    base = rates.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_DRAWS - 1).cast("long"))))
    centre = F.log(F.col("rate") / (1 - F.col("rate")))
    return base.select("model", "draw", (centre + spread(0)).alias("b_0"), spread(5).alias("b_1"))


def _chosen(rows, n):
    return dr.choose_draws(_coefficient_draws(rows), "draw", N_DRAWS, n, 16)


def prediction_grid(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    out = dr.prediction_grid(rows, "shannon_scaled", "subject_id", "model", 3, 20, ("taxon", ["click", "view"]))
    return rounded(out.withColumn("point", F.col("point").cast("long")), "shannon_scaled")


def _fitted(spark, sf_dir, rows, n=20, draws=25, grid=None, packed=False):
    if grid is None:
        grid = dr.packed_grid(rows, "shannon_scaled", "subject_id", "model", 3, n)
    # Subject effects come from the account balance, scaled by the draw.
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    base = customer.select(F.col("c_custkey").alias("subject_id"), (F.col("c_acctbal") / 20000).alias("_base"))
    picked = dr.choose_draws(spark.range(N_DRAWS).withColumnRenamed("id", "draw"), "draw", N_DRAWS, draws, 16)
    # The chosen draws, a setting, meet every subject as one array.
    effect = F.transform("_draws", lambda d: F.struct(d.alias("draw"), (F.col("_base") * (1 + d % 3)).alias("effect")))
    effects = base.withColumn("_draws", picked.agg(F.sort_array(F.collect_list("draw"))).scalar()).select("subject_id", effect.alias("draws"))
    return dr.fitted_draws(
        grid, _chosen(rows, draws), "model", "draw", "b_0", {"b_1": "shannon_scaled"}, 3, effects, ["subject_id"], packed=packed
    )


def fitted_draws(spark, sf_dir):
    out = _fitted(spark, sf_dir, _stored_rows(spark, sf_dir), 10, 10).select("model", "subject_id", "point", "draw", "fitted")
    return rounded(out.withColumn("point", F.col("point").cast("long")), "fitted")


def ribbon(spark, sf_dir):
    gappy = _gappy(spark, sf_dir)
    out = dr.ribbon(
        _fitted(spark, sf_dir, cut(_model_rows(gappy)), packed=True), _scales(gappy), ["model"], 3, ["model", "point"], "shannon_scaled", group_bound=60
    )
    out = out.select("model", F.col("point").cast("long").alias("point"), "shannon_scaled_raw", "width", "median", "lower", "upper")
    return rounded(out, "shannon_scaled_raw", "median", "lower", "upper")


def contrast(spark, sf_dir):
    entries = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("shannon_scaled")) for n, v in (("high", 1.0), ("mid", 0.0), ("low", -1.0))])
    rows = _stored_rows(spark, sf_dir)
    grid = rows.select("model", "subject_id").distinct().withColumn("points", entries)
    fitted = _fitted(spark, sf_dir, rows, grid=grid, packed=True)
    out = dr.contrast(fitted, ["model"], ["subject_id"], "level", ["low", "mid", "high"], "high", "low", group_bound=3)
    return rounded(out, "estimate", "lower", "upper", "width")


def _loglik_scores(spark, sf_dir):
    gappy = _gappy(spark, sf_dir)
    rows = shape.censor_at_first(gappy, "subject_id", "date", "first_confirmed")
    rows = shape.zscore(rows.select(*DAY, "shannon", F.col("confirmed").alias("event")), ["shannon"]).dropna()
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    chosen = _chosen(_model_rows(gappy), 40)
    arrays = dr.pointwise_loglik(rows, chosen, "model", "draw", "b_0", {"b_1": "shannon_scaled"}, "event", 3)
    return dr.pointwise_scores(arrays.select("model", *DAY, "loglik"))


def pointwise_scores(spark, sf_dir):
    return rounded(_loglik_scores(spark, sf_dir), "lpd", "p_waic", "elpd_loo", "elpd_waic")


def compare_models(spark, sf_dir):
    out = dr.compare_models(_loglik_scores(spark, sf_dir), "model", DAY)
    return rounded(out, *[c for c in out.columns if c not in ("model", "observations")])


def _checks(spark, sf_dir):
    stored = _stored_rows(spark, sf_dir)
    rows = stored.select("model", *DAY, "shannon_scaled", "event")
    fitted = dr.fitted_draws(rows, _chosen(stored, 40), "model", "draw", "b_0", {"b_1": "shannon_scaled"}, 3)
    return dr.predictive_check(fitted, ["model"], "draw", DAY, "event", 16)


def predictive_check(spark, sf_dir):
    return rounded(_checks(spark, sf_dir), "replicated_rate", "observed_rate", "expected_rate")


def predictive_check_summary(spark, sf_dir):
    out = dr.predictive_check_summary(_checks(spark, sf_dir), ["model"])
    return rounded(out, "observed_rate", "lower", "median", "upper", "share_at_or_above")


def _count_models(spark, sf_dir):
    """The 27 persistence sets as one table keyed by model."""
    rows = grid_rows(spark, sf_dir)
    return rows.withColumn("model", F.concat_ws("|", "mode", "measure", "outcome")).withColumn("one", F.lit(1.0))


def logit_newton_step(spark, sf_dir):
    """Gradient and information at zero of y ~ 1 + count, for every model."""
    counts = models.sufficient_counts(_count_models(spark, sf_dir), ["model"], "event", ["one", "low_count"])
    sums = models.newton_sums(counts, None, ["model"], ["one", "low_count"], None)
    out = sums.select(
        "model", F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"),
        F.col("_g0").alias("g_one"), F.col("_g1").alias("g_count"), F.col("_h0_0").alias("h_one"),
        F.col("_h0_1").alias("h_cross"), F.col("_h1_1").alias("h_count"),
    )
    return rounded(out, "g_one", "g_count", "h_one", "h_cross", "h_count")


def logit_many_no_intercept(spark, sf_dir):
    """y ~ count without intercept, for all 27 persistence sets at once."""
    out = models.logit_many(_count_models(spark, sf_dir), "model", "event", ["low_count"])
    return rounded(out.select("model", "value", "std_error", "converged"), "value", "std_error")


def logit_many(spark, sf_dir):
    """y ~ 1 + standardised exposure, for three outcome definitions at once."""
    rows = _model_rows(_gappy(spark, sf_dir)).withColumn("one", F.lit(1.0))
    out = models.logit_many(rows, "model", "event", ["one", "shannon_scaled"])
    return rounded(out.select("model", "param", "value", "std_error", "converged"), "value", "std_error")


REPLICATES = 200


def _bootstrap(spark, sf_dir):
    return models.logit_many(_count_models(spark, sf_dir), "model", "event", ["one", "low_count"], "subject_id", REPLICATES, 16)


def logit_bootstrap(spark, sf_dir):
    """Cluster-bootstrap draws of y ~ 1 + count for all 27 sets."""
    out = _bootstrap(spark, sf_dir)
    return rounded(out.select("model", F.col("replicate").cast("long").alias("replicate"), "param", "value", "converged"), "value")


def bootstrap_summary(spark, sf_dir):
    """From event log to estimates: impute, censor, count, fit with replicates, summarise the draws per set."""
    drawn = cut(_bootstrap(spark, sf_dir).where(F.col("replicate") > 0))
    out = dr.draws_summary(drawn, ["model", "param"], draws_bound=REPLICATES)
    return rounded(out.select("model", "param", "estimate", "est_error", "q2_5", "q97_5"), "estimate", "est_error", "q2_5", "q97_5")


def bootstrap_pooled_intervals(spark, sf_dir):
    """Intervals of the slope per mode and measure, pooled over outcomes."""
    drawn = _bootstrap(spark, sf_dir).where((F.col("replicate") > 0) & (F.col("param") == "low_count"))
    parts = F.split("model", r"\|")
    pooled = cut(drawn.select(parts[0].alias("mode"), parts[1].alias("measure"), "value"))
    out = dr.median_qi(pooled, ["mode", "measure"], "value", fixed.INTERVAL_WIDTHS, draws_bound=len(MODELS) * REPLICATES)
    return rounded(out, "width", "median", "lower", "upper")


FITS = 20


def ribbon_of_fit(spark, sf_dir):
    """Scale, fit with replicates, predict over a grid for every subject, summarise along it."""
    gappy = _gappy(spark, sf_dir)
    rows = cut(_model_rows(gappy))
    long = models.logit_many(rows.withColumn("one", F.lit(1.0)), "model", "event", ["one", "shannon_scaled"], "subject_id", FITS, 16)
    wide = cut(
        long.where(F.col("replicate") > 0).groupBy("model", F.col("replicate").cast("long").alias("draw"))
        .agg(*[F.max(F.when(F.col("param") == x, F.col("value"))).alias(b) for b, x in (("b_0", "one"), ("b_1", "shannon_scaled"))])
    )
    grid = dr.packed_grid(rows, "shannon_scaled", "subject_id", "model", 3, 10)
    fitted = dr.fitted_draws(grid, wide, "model", "draw", "b_0", {"b_1": "shannon_scaled"}, 3, draws_bound=FITS, packed=True)
    out = dr.ribbon(fitted, _scales(gappy), ["model"], 3, ["model", "point"], "shannon_scaled", group_bound=30)
    out = out.select("model", F.col("point").cast("long").alias("point"), "shannon_scaled_raw", "width", "median", "lower", "upper")
    return rounded(out, "shannon_scaled_raw", "median", "lower", "upper")


TERMS = ["one", "z1", "z2", "z12", "count"]


def _formula_rows(spark, sf_dir):
    """Observations stacked once per formula; a term that a formula leaves out is zero: z1; z2; z1 + z2; z1 * z2; count."""
    rows = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_confirmed")
    rows = shape.zscore(rows.select(*DAY, "shannon", "log_abundance", F.col("confirmed").alias("event")), ["shannon", "log_abundance"]).dropna()
    rows = define.dichotomise(rows, "shannon", "<", 0.6, "low")
    rows = persist.persistence_count(rows, "subject_id", "subject_day", "low", block_days=7)
    z1, z2, zero = F.col("shannon_scaled"), F.col("log_abundance_scaled"), F.lit(0.0)
    entries = [
        ("diversity", z1, zero, zero, zero), ("abundance", zero, z2, zero, zero), ("both", z1, z2, zero, zero),
        ("interaction", z1, z2, z1 * z2, zero), ("count", zero, zero, zero, F.col("low_count").cast("double")),
    ]
    names = ["model", *TERMS[1:]]
    structs = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, e)]) for e in entries])
    return rows.select(*DAY, "event", F.lit(1.0).alias("one"), F.inline(structs))


def logit_formulas(spark, sf_dir):
    """Five formulas on the same rows."""
    out = models.logit_many(_formula_rows(spark, sf_dir), "model", "event", TERMS)
    return rounded(out.select("model", "param", "value", "std_error", "converged"), "value", "std_error")


def compare_formulas(spark, sf_dir):
    """Fit five formulas with replicates and compare them on the observations they share."""
    rows = cut(_formula_rows(spark, sf_dir))
    long = models.logit_many(rows, "model", "event", TERMS, "subject_id", FITS, 16)
    wide = cut(
        long.where(F.col("replicate") > 0).groupBy("model", F.col("replicate").cast("long").alias("draw"))
        .agg(*[F.max(F.when(F.col("param") == x, F.col("value"))).alias(f"b_{x}") for x in TERMS])
    )
    arrays = dr.pointwise_loglik(rows, wide, "model", "draw", "b_one", {f"b_{x}": x for x in TERMS[1:]}, "event", 5, FITS)
    out = dr.compare_models(dr.pointwise_scores(arrays.select("model", *DAY, "loglik")), "model", DAY)
    return rounded(out, *[c for c in out.columns if c not in ("model", "observations")])


def top_strata(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return models.top_strata(events, "props", 10)


def _taxon_labels(spark, sf_dir):
    rows = ec.samples(spark, sf_dir).select("dominant_taxon").distinct()
    group = shape.recode_by_pattern(rows, "dominant_taxon", [("click|view", "browsing")], out="kind")
    return group.withColumn("label", F.concat("kind", F.lit(" ("), "dominant_taxon", F.lit(")")))


def taxon_labels(spark, sf_dir):
    return _taxon_labels(spark, sf_dir)


def stratum_slopes(spark, sf_dir):
    """The four most frequent strata."""
    return _stratum_slopes(spark, sf_dir, k=4)


def stratum_slopes_default(spark, sf_dir):
    """All strata, as the default holds more than there are."""
    return _stratum_slopes(spark, sf_dir)


def _stratum_slopes(spark, sf_dir, **options):
    rows = shape.censor_at_first(ec.cohort(spark, sf_dir), "subject_id", "date", "first_suspected")
    rows = shape.zscore(rows.select(*DAY, "max_read_prop", "dominant_taxon", F.col("suspected").alias("event")), ["max_read_prop"])
    out = models.stratum_slopes(rows, "dominant_taxon", "max_read_prop_scaled", "event", labels=_taxon_labels(spark, sf_dir), **options)
    return rounded(out, "slope", "std_error", "pooled", "shrunk")


def _sweep_rows(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.concat(F.lit("effect_"), "l_returnflag").alias("effect"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_linestatus") == "O").alias("event"),
        ((F.col("l_extendedprice") - 50000) / 25000 + F.when(F.col("l_linestatus") == "O", 0.3).otherwise(0.0)).alias("measure"),
    )


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "measure"]


def sample_by_size(spark, sf_dir):
    out = models.sample_by_size(_sweep_rows(spark, sf_dir), "effect", ["l_orderkey", "l_linenumber", "l_partkey"], [100, 200, 300], 16)
    return out.groupBy("effect", F.col("sample_size").cast("long").alias("sample_size")).agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("order_keys"), F.count_if("event").alias("events")
    )


def sample_size_sweep(spark, sf_dir):
    out = models.sample_size_sweep(
        _sweep_rows(spark, sf_dir), "effect", ["l_orderkey", "l_linenumber", "l_partkey"], "event", "measure", [100, 300, 600], 30
    )
    return rounded(out, "estimate", "lower", "upper", "odds_ratio", "sign_error_share")


def detection_share(spark, sf_dir):
    out = models.sample_size_sweep(
        _sweep_rows(spark, sf_dir), "effect", ["l_orderkey", "l_linenumber", "l_partkey"], "event", "measure", [100, 600], 30
    )
    return rounded(models.detection_share(out), "detection_share", "sign_error_share")


QUERIES = {
    "draws_summary": draws_summary,
    "estimates_grid": estimates_grid,
    "median_qi": median_qi,
    "median_qi_forty_widths": median_qi_forty_widths,
    "median_qi_of_bootstrap": median_qi_of_bootstrap,
    "median_qi_any_groups": median_qi_any_groups,
    "direction_share": direction_share,
    "binned_density": binned_density,
    "prediction_grid": prediction_grid,
    "fitted_draws": fitted_draws,
    "ribbon": ribbon,
    "contrast": contrast,
    "pointwise_scores": pointwise_scores,
    "compare_models": compare_models,
    "predictive_check": predictive_check,
    "predictive_check_summary": predictive_check_summary,
    "logit_newton_step": logit_newton_step,
    "logit_many_no_intercept": logit_many_no_intercept,
    "logit_many": logit_many,
    "logit_bootstrap": logit_bootstrap,
    "logit_formulas": logit_formulas,
    "bootstrap_summary": bootstrap_summary,
    "bootstrap_pooled_intervals": bootstrap_pooled_intervals,
    "ribbon_of_fit": ribbon_of_fit,
    "compare_formulas": compare_formulas,
    "top_strata": top_strata,
    "taxon_labels": taxon_labels,
    "stratum_slopes": stratum_slopes,
    "stratum_slopes_default": stratum_slopes_default,
    "sample_by_size": sample_by_size,
    "sample_size_sweep": sample_size_sweep,
    "detection_share": detection_share,
}

_DRAWS_SUMMARY = """
SELECT model, param, avg(value) AS estimate, stddev_samp(value) AS est_error,
       quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.975) AS q97_5 FROM draws GROUP BY 1, 2"""


def _qi(source, by, value, widths):
    return " UNION ALL ".join(
        f"SELECT {by}, round(quantile_cont({value}, 0.5), 6) + 0.0 AS median, CAST({w} AS DOUBLE) AS width, "
        f"round(quantile_cont({value}, {(1 - w) / 2!r}), 6) + 0.0 AS lower, round(quantile_cont({value}, {(1 + w) / 2!r}), 6) + 0.0 AS upper "
        f"FROM {source} GROUP BY {by}"
        for w in widths
    )


def _unit(seed, *cols):
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


_SCALED = ",\n".join(
    f"""kept_{o} AS (SELECT * FROM gappy WHERE date <= coalesce(first_{o}, DATE '9999-01-01')),
z_{o} AS (SELECT '{o}' AS model, subject_id, subject_day, {o} AS event,
  (shannon - avg(shannon) OVER ()) / stddev_samp(shannon) OVER () AS shannon_scaled,
  (log_abundance - avg(log_abundance) OVER ()) / stddev_samp(log_abundance) OVER () AS log_abundance_scaled FROM kept_{o})"""
    for o in MODELS
)
_MODEL_ROWS = (
    _SCALED
    + ",\nmodel_rows AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT * FROM z_{o}" for o in MODELS)
    + ") WHERE shannon_scaled IS NOT NULL AND log_abundance_scaled IS NOT NULL)"
)
_COEFS = _MODEL_ROWS + f""",
rates AS (SELECT model, avg(CAST(event AS INTEGER)) AS rate, CASE model WHEN 'suspected' THEN 1 WHEN 'confirmed' THEN 2 ELSE 3 END AS m
          FROM model_rows GROUP BY model),
coefs AS (
  SELECT model, draw, ln(rate / (1 - rate)) + (draw * 7919 + m * 104729) % 10007 / 10007.0 - 0.4 AS b_0,
         (draw * 7919 + (m + 5) * 104729) % 10007 / 10007.0 - 0.4 AS b_1
  FROM rates, (SELECT range AS draw FROM range({N_DRAWS}))),
draw_order AS (SELECT range AS draw, row_number() OVER (ORDER BY {_unit(16, "range")}, range) AS place FROM range({N_DRAWS}))"""
_GRID = """,
reach AS (SELECT model, min(shannon_scaled) AS lo, max(shannon_scaled) AS hi FROM model_rows GROUP BY 1),
grid AS (
  SELECT s.model, s.subject_id, range AS point, lo + (hi - lo) / ({n} - 1) * range AS shannon_scaled
  FROM (SELECT DISTINCT model, subject_id FROM model_rows) s JOIN reach USING (model), range({n}))"""
_FITTED = """,
fitted AS (
  SELECT g.*, c.draw, 1 / (1 + exp(-(b_0 + b_1 * shannon_scaled + c_acctbal / 20000 * (1 + c.draw % 3)))) AS fitted
  FROM {grid} g JOIN coefs c ON g.model = c.model JOIN draw_order o ON o.draw = c.draw AND o.place <= {d}
  JOIN customer k ON k.c_custkey = g.subject_id)"""
_CHECKED = _COEFS + f""",
checks AS (
  SELECT r.model, c.draw, avg(CASE WHEN {_unit(16, "c.draw", "subject_id", "subject_day")} < p THEN 1.0 ELSE 0.0 END) AS replicated_rate,
         avg(CAST(event AS INTEGER)) AS observed_rate, avg(p) AS expected_rate
  FROM (SELECT m.*, c.draw, 1 / (1 + exp(-(b_0 + b_1 * shannon_scaled))) AS p FROM model_rows m JOIN coefs c USING (model)
        JOIN draw_order o ON o.draw = c.draw AND place <= 40) AS r, (SELECT 1) AS one, LATERAL (SELECT r.draw AS draw) AS c
  GROUP BY 1, 2)"""
_SCORES = _COEFS + """,
obs AS (
  SELECT subject_id, subject_day, confirmed AS event, (shannon - avg(shannon) OVER ()) / stddev_samp(shannon) OVER () AS z FROM kept_confirmed),
ll AS (
  SELECT c.model, subject_id, subject_day, ln(CASE WHEN event THEN 1 / (1 + exp(-(b_0 + b_1 * z))) ELSE 1 / (1 + exp(b_0 + b_1 * z)) END) AS l
  FROM obs, coefs c JOIN draw_order o ON o.draw = c.draw AND place <= 40 WHERE z IS NOT NULL),
scores AS (
  SELECT model, subject_id, subject_day, ln(avg(exp(l))) AS lpd, var_samp(l) AS p_waic, -ln(avg(exp(-l))) AS elpd_loo,
         ln(avg(exp(l))) - var_samp(l) AS elpd_waic FROM ll GROUP BY 1, 2, 3)"""


def ldl_steps(m):
    """Nested columns that solve the system of h0_0.. and g0.. for s0.. by its LDL' factors, with se0.. from the diagonal of the inverse."""
    steps = []
    for j in range(m):
        steps.append([f"h{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f" AS d{j}"])
        lower = [f"(h{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i in range(j + 1, m)]
        steps += [lower] if lower else []
    steps += [[f"g{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f" AS y{i}"] for i in range(m)]
    steps += [[f"y{i} / d{i}" + "".join(f" - l{k}_{i} * s{k}" for k in range(i + 1, m)) + f" AS s{i}"] for i in reversed(range(m))]
    # Inverse of the unit lower factor, for the diagonal of the inverse.
    for i in range(m):
        for j in reversed(range(i)):
            steps.append([f"-(l{i}_{j}" + "".join(f" + l{i}_{k} * v{k}_{j}" for k in range(j + 1, i)) + f") AS v{i}_{j}"])
    steps.append([f"sqrt(1 / d{i}" + "".join(f" + v{k}_{i} * v{k}_{i} / d{k}" for k in range(i + 1, m)) + f") AS se{i}" for i in range(m)])
    return steps


def newton_many(counts, keys, xs, rounds=14):
    """CTEs ``fit`` (keys, b0.., se0..): Newton on ``counts`` (keys, xs, n, e); the systems are solved by their LDL' factors."""
    ks, m = ", ".join(keys), len(xs)
    eta = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
    betas = ", ".join(f"b{i}" for i in range(m))
    sums = [f"sum({xs[i]} * (e - n * p)) - 1e-3 * b{i} AS g{i}" for i in range(m)]
    sums += [f"sum({xs[i]} * {xs[j]} * n * p * (1 - p)){' + 1e-3' if i == j else ''} AS h{i}_{j}" for i in range(m) for j in range(i + 1)]
    steps = ldl_steps(m)
    steps.append(["least(1.0, 4.0 / greatest(" + ", ".join(f"abs(s{i})" for i in range(m)) + ", 1e-300)) AS scale"])
    parts = [f"it0 AS (SELECT DISTINCT {ks}, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(m)) + f" FROM {counts})"]
    for t in range(1, rounds + 1):
        body = f"SELECT {ks}, {betas}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {counts} JOIN it{t - 1} USING ({ks})) GROUP BY {ks}, {betas}"
        for step in steps:
            body = f"SELECT *, {', '.join(step)} FROM ({body})"
        found = ", ".join([f"b{i} + scale * s{i} AS b{i}" for i in range(m)] + [f"se{i}" for i in range(m)])
        parts.append(f"it{t} AS MATERIALIZED (SELECT {ks}, {found} FROM ({body}))")
    parts.append(f"fit AS (SELECT * FROM it{rounds})")
    return ",\n".join(parts)


def newton_ctes(counts, keys, x, rounds=16, intercept=True):
    """CTEs ``fit`` (keys, b0, b1, se0, se1): unrolled Newton iterations on ``counts`` (keys, x, n, e)."""
    ks = ", ".join(keys)
    one = "1.0" if intercept else "0.0"
    parts = [f"it0 AS (SELECT DISTINCT {ks}, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {counts})"]
    for t in range(1, rounds + 1):
        parts.append(
            f"""s{t} AS MATERIALIZED (
  SELECT {ks}, b0, b1, {one} * sum(e - n * p) - 1e-3 * b0 AS g0, sum({x} * (e - n * p)) - 1e-3 * b1 AS g1, {one} * sum(n * p * (1 - p)) + 1e-3 AS h00,
         {one} * sum({x} * n * p * (1 - p)) AS h01, sum({x} * {x} * n * p * (1 - p)) + 1e-3 AS h11
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * {x}))) AS p FROM {counts} JOIN it{t - 1} USING ({ks})) GROUP BY {ks}, b0, b1),
it{t} AS MATERIALIZED (
  SELECT {ks}, b0 + k * d0 AS b0, b1 + k * d1 AS b1, se0, se1 FROM (
    SELECT *, least(1.0, 4.0 / greatest(abs(d0), abs(d1), 1e-300)) AS k FROM (
      SELECT *, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS d1,
             sqrt(h11 / (h00 * h11 - h01 * h01)) AS se0, sqrt(h00 / (h00 * h11 - h01 * h01)) AS se1 FROM s{t})))"""
        )
    parts.append(f"fit AS (SELECT * FROM it{rounds})")
    return ",\n".join(parts)


def _grid_rows(mode_filter=""):
    """The CTEs of the persistence grid with its counted rows."""
    text = ORACLE_GRID[: ORACLE_GRID.rindex("SELECT mode, measure, outcome, low_count")]
    return text + mode_filter


ORACLE_GRID = PERSIST_ORACLE["persistence_grid"]
_GRID_COUNTS = """,
model_counts AS MATERIALIZED (
  SELECT mode || '|' || measure || '|' || outcome AS model, CAST(low_count AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (event) AS DOUBLE) AS e FROM counted GROUP BY 1, 2)"""


def _poisson(u):
    return "(" + " + ".join(f"CAST({u} >= {c!r} AS INTEGER)" for c in poisson_one_cuts()) + ")"


_BOOT = f""",
per_subject AS (
  SELECT mode || '|' || measure || '|' || outcome AS model, subject_id, CAST(low_count AS DOUBLE) AS x, count(*) AS n,
         count(*) FILTER (event) AS e FROM counted GROUP BY 1, 2, 3),
weights AS (
  SELECT range AS replicate, subject_id, CASE WHEN range = 0 THEN 1 ELSE {_poisson("u")} END AS w
  FROM (SELECT range, subject_id, {_unit(16, "range", "subject_id")} AS u FROM (SELECT DISTINCT subject_id FROM per_subject), range({REPLICATES + 1}))),
boot AS MATERIALIZED (
  SELECT model, replicate, x, CAST(sum(n * w) AS DOUBLE) AS n, CAST(sum(e * w) AS DOUBLE) AS e
  FROM per_subject JOIN weights USING (subject_id) WHERE w > 0 GROUP BY 1, 2, 3),
"""

_BOOT_FIT = _grid_rows().rstrip() + _BOOT + newton_ctes("boot", ["model", "replicate"], "x", 24)
# Counts of the rows with each replicate's weights of their subjects.
_REPLICATED = f""",
weights AS (
  SELECT range AS replicate, subject_id, CASE WHEN range = 0 THEN 1 ELSE {_poisson("u")} END AS w
  FROM (SELECT range, subject_id, {_unit(16, "range", "subject_id")} AS u FROM (SELECT DISTINCT subject_id FROM {{rows}}), range({{fits}} + 1))),
counts AS MATERIALIZED (
  SELECT model, replicate, {{xs}}, sum(w)::DOUBLE AS n, coalesce((sum(w) FILTER (event))::DOUBLE, 0.0) AS e
  FROM {{rows}} JOIN weights USING (subject_id) WHERE w > 0 GROUP BY {{by}}),
"""
_FORMULAS = """
kept AS (SELECT * FROM gappy WHERE date <= coalesce(first_confirmed, DATE '9999-01-01')),
z AS (SELECT * FROM (
  SELECT subject_id, subject_day, shannon, confirmed AS event, (shannon - avg(shannon) OVER ()) / stddev_samp(shannon) OVER () AS z1,
         (log_abundance - avg(log_abundance) OVER ()) / stddev_samp(log_abundance) OVER () AS z2, log_abundance FROM kept)
  WHERE shannon IS NOT NULL AND log_abundance IS NOT NULL),
base AS (SELECT *, shannon < 0.6 AS f FROM z),""" + counted_ctes("base") + """,
stacked AS (
  SELECT c.subject_id, c.subject_day, c.event, t.model, 1.0::DOUBLE AS one, CASE WHEN t.model IN ('diversity', 'both', 'interaction') THEN z1 ELSE 0.0 END AS z1,
         CASE WHEN t.model IN ('abundance', 'both', 'interaction') THEN z2 ELSE 0.0 END AS z2, CASE WHEN t.model = 'interaction' THEN z1 * z2 ELSE 0.0 END AS z12,
         CASE WHEN t.model = 'count' THEN CAST(low_count AS DOUBLE) ELSE 0.0 END AS "count"
  FROM counted c, (VALUES ('diversity'), ('abundance'), ('both'), ('interaction'), ('count')) AS t(model))"""

_STRATA_SQL = """
kept AS (SELECT * FROM cohort WHERE date <= coalesce(first_suspected, DATE '9999-01-01')),
z AS (SELECT dominant_taxon, suspected, (max_read_prop - avg(max_read_prop) OVER ()) / stddev_samp(max_read_prop) OVER () AS z FROM kept),
top4 AS (SELECT dominant_taxon FROM z GROUP BY 1 ORDER BY count(*) DESC, dominant_taxon LIMIT 4),
counts AS MATERIALIZED (
  SELECT dominant_taxon, z AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (suspected) AS DOUBLE) AS e
  FROM z JOIN top4 USING (dominant_taxon) GROUP BY 1, 2),
"""

_LINE_ROWS = f"""
WITH line_rows AS (
  SELECT 'effect_' || l_returnflag AS effect, l_orderkey, l_linenumber, l_partkey, l_linestatus = 'O' AS event,
         (l_extendedprice - 50000) / 25000 + CASE WHEN l_linestatus = 'O' THEN 0.3 ELSE 0.0 END AS measure,
         {_unit(16, "l_orderkey", "l_linenumber", "l_partkey")} AS u FROM lineitem),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY effect ORDER BY u, l_orderkey, l_linenumber, l_partkey) AS place FROM line_rows)"""


def _sweep_sql(sizes):
    listed = ", ".join(f"({s})" for s in sizes)
    cluster = "l_orderkey || '|' || l_linenumber || '|' || l_partkey"
    return _LINE_ROWS + f""",
sampled AS (
  SELECT effect, sample_size, measure AS x, event, {cluster} AS cluster
  FROM placed JOIN (VALUES {listed}) AS sizes(sample_size) ON place <= sample_size),
counts AS MATERIALIZED (
  SELECT effect || '|' || sample_size AS model, replicate, x, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w) FILTER (event) AS DOUBLE) AS e0,
         coalesce(CAST(sum(w) FILTER (event) AS DOUBLE), 0.0) AS e
  FROM (SELECT s.*, range AS replicate, CASE WHEN range = 0 THEN 1 ELSE {_poisson(_unit(16, "range", "cluster"))} END AS w FROM sampled s, range(31))
  WHERE w > 0 GROUP BY 1, 2, 3),
whole AS MATERIALIZED (
  SELECT effect AS model, 0 AS replicate, measure AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event) AS DOUBLE) AS e
  FROM line_rows GROUP BY 1, 3),
both_counts AS MATERIALIZED (SELECT model, replicate, x, n, e FROM counts UNION ALL SELECT * FROM whole),
""" + newton_ctes("both_counts", ["model", "replicate"], "x", 12) + """,
joined AS (
  SELECT split_part(f.model, '|', 1) AS effect, CAST(split_part(f.model, '|', 2) AS INTEGER) AS sample_size, f.replicate, f.b1, t.b1 AS truth
  FROM fit f JOIN fit t ON t.model = split_part(f.model, '|', 1) WHERE f.model LIKE '%|%'),
sweep AS (
  SELECT effect, sample_size, max(b1) FILTER (replicate = 0) AS estimate, quantile_cont(b1, 0.025) FILTER (replicate > 0) AS lower,
         quantile_cont(b1, 0.975) FILTER (replicate > 0) AS upper,
         avg(CASE WHEN sign(b1) <> sign(truth) THEN 1.0 ELSE 0.0 END) FILTER (replicate > 0) AS sign_error_share
  FROM joined GROUP BY 1, 2)
"""


_COMPARED = """,
sums AS (
  SELECT model, count(*) AS observations, sum(elpd_waic) AS elpd_waic, sum(p_waic) AS p_waic, -2 * sum(elpd_waic) AS waic,
         sum(elpd_loo) AS elpd_loo, sum(lpd - elpd_loo) AS p_loo, sqrt(count(*) * var_samp(elpd_loo)) AS se FROM scores GROUP BY 1),
best AS (SELECT model FROM sums ORDER BY elpd_loo DESC, model LIMIT 1),
differences AS (
  SELECT s.model, sum(s.elpd_loo - b.elpd_loo) AS elpd_diff, sqrt(count(*) * var_samp(s.elpd_loo - b.elpd_loo)) AS se_diff
  FROM scores s JOIN scores b USING (subject_id, subject_day) WHERE b.model = (SELECT model FROM best) GROUP BY 1)"""
_COMPARISON = "SELECT model, observations, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in ("elpd_waic", "p_waic", "waic", "elpd_loo", "p_loo", "se", "elpd_diff", "se_diff")
) + " FROM sums JOIN differences USING (model)"

def _slopes_sql(k):
    return sql_with(
        _STRATA_SQL.replace("LIMIT 4", f"LIMIT {k}") + newton_ctes("counts", ["dominant_taxon"], "x") + """,
sizes AS (SELECT dominant_taxon, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events FROM counts GROUP BY 1),
pooled AS (SELECT sum(b1 / se1 ** 2) / sum(1 / se1 ** 2) AS mean, sum(1 / se1 ** 2) AS w, sum(1 / se1 ** 4) AS w2, count(*) AS k FROM fit),
tau AS (SELECT any_value(mean) AS mean, greatest((sum((b1 - mean) ** 2 / se1 ** 2) - (any_value(k) - 1)) / any_value(w - w2 / w), 0.0) AS tau2 FROM fit, pooled)""",
        """
SELECT f.dominant_taxon, n, events, round(b1, 6) AS slope, round(se1, 6) AS std_error, round(mean, 6) AS pooled,
       round((tau2 * b1 + se1 ** 2 * mean) / (tau2 + se1 ** 2), 6) AS shrunk, true AS converged,
       CASE WHEN f.dominant_taxon IN ('click', 'view') THEN 'browsing' ELSE f.dominant_taxon END AS kind,
       CASE WHEN f.dominant_taxon IN ('click', 'view') THEN 'browsing' ELSE f.dominant_taxon END || ' (' || f.dominant_taxon || ')' AS label
FROM fit f JOIN sizes USING (dominant_taxon), tau""",
    )


ORACLE = {
    "draws_summary": SQL_ORDER_DRAWS + f"""
SELECT model, param, {", ".join(f"round({c}, 6) + 0.0 AS {c}, round(exp({c}), 6) AS {c}_or" for c in dr.SUMMARY)} FROM ({_DRAWS_SUMMARY})""",
    "estimates_grid": SQL_ORDER_DRAWS + f"""
SELECT model, param, round(exp(estimate), 6) AS estimate_or, round(exp(q2_5), 6) AS q2_5_or, round(exp(q97_5), 6) AS q97_5_or,
       CASE WHEN model LIKE '%shannon%' THEN 'shannon' ELSE 'max_read_prop' END AS measure,
       CASE WHEN model LIKE 'm_svaps%' THEN 'Suspected VA-LRTI' || chr(10) || '+Culture' || chr(10) || '+Signs' || chr(10) || '+Antibiotic Change'
            WHEN model LIKE 'm_svp%' THEN 'Suspected VA-LRTI' || chr(10) || '+Culture' || chr(10) || '+Signs' ELSE 'Suspected VA-LRTI' END AS outcome
FROM ({_DRAWS_SUMMARY}) WHERE (model LIKE '%shannon' AND param LIKE '%shannon%') OR (model LIKE '%max_read_prop' AND param LIKE '%max_read_prop%')""",
    "median_qi": SQL_ORDER_DRAWS + _qi("draws", "param", "value", fixed.INTERVAL_WIDTHS),
    "median_qi_forty_widths": SQL_ORDER_DRAWS + _qi("draws", "model", "value", [round(0.025 * i - 0.0125, 4) for i in range(1, 41)]),
    "median_qi_any_groups": _qi("lineitem", "l_suppkey", "l_extendedprice", [0.5, 0.95]),
    "median_qi_of_bootstrap": sql_with(
        _COEFS + ",\nlong_draws AS (SELECT model, 'b_0' AS param, b_0 AS value FROM coefs UNION ALL SELECT model, 'b_1', b_1 FROM coefs)",
        _qi("long_draws", "model, param", "value", fixed.INTERVAL_WIDTHS),
    ),
    "direction_share": SQL_ORDER_DRAWS
    + " SELECT model, param, count(*) AS draws, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM draws GROUP BY 1, 2",
    "binned_density": SQL_ORDER_DRAWS + """
SELECT param, bin, count(*) AS draws, round(count(*) / (sum(count(*)) OVER (PARTITION BY param) * 0.125), 6) AS density
FROM (SELECT param, CAST(floor((value + 1.0) / 0.125) AS BIGINT) AS bin FROM draws) GROUP BY 1, 2""",
    "prediction_grid": sql_with(
        _MODEL_ROWS + _GRID.format(n=20),
        "SELECT model, subject_id, point, round(shannon_scaled, 6) + 0.0 AS shannon_scaled, taxon FROM grid, (VALUES ('click'), ('view')) AS t(taxon)",
    ),
    "fitted_draws": sql_with(
        _COEFS + _GRID.format(n=10) + _FITTED.format(grid="grid", d=10),
        "SELECT model, subject_id, point, draw, round(fitted, 6) AS fitted FROM fitted",
    ),
    "ribbon": sql_with(
        _COEFS + _GRID.format(n=20) + _FITTED.format(grid="grid", d=25) + ",\nscales AS ("
        + " UNION ALL ".join(f"SELECT '{o}' AS model, avg(shannon) AS mean, stddev_samp(shannon) AS sd FROM kept_{o}" for o in MODELS)
        + ")",
        " UNION ALL ".join(
            f"SELECT model, point, round(any_value(shannon_scaled * sd + mean), 6) + 0.0 AS shannon_scaled_raw, CAST({w} AS DOUBLE) AS width, "
            f"round(median(fitted), 6) AS median, round(quantile_cont(fitted, {(1 - w) / 2!r}), 6) AS lower, "
            f"round(quantile_cont(fitted, {(1 + w) / 2!r}), 6) AS upper FROM fitted JOIN scales USING (model) GROUP BY model, point"
            for w in fixed.INTERVAL_WIDTHS
        ),
    ),
    "contrast": sql_with(
        _COEFS + """,
points AS (SELECT m.model, m.subject_id, level, shannon_scaled FROM (SELECT DISTINCT model, subject_id FROM model_rows) m,
  (VALUES ('high', 1.0::DOUBLE), ('mid', 0.0), ('low', -1.0)) AS t(level, shannon_scaled))"""
        + _FITTED.format(grid="points", d=25)
        + """,
wide AS (SELECT model, subject_id, draw, max(fitted) FILTER (level = 'low') AS low, max(fitted) FILTER (level = 'mid') AS mid,
         max(fitted) FILTER (level = 'high') AS high FROM fitted GROUP BY 1, 2, 3),
long_values AS (SELECT model, 'low' AS posterior, low AS value FROM wide UNION ALL SELECT model, 'mid', mid FROM wide
         UNION ALL SELECT model, 'high', high FROM wide UNION ALL SELECT model, 'contrast', high - low FROM wide)""",
        """
SELECT model, posterior, round(median(value), 6) + 0.0 AS estimate, CAST(0.95 AS DOUBLE) AS width,
       round(quantile_cont(value, 0.025), 6) + 0.0 AS lower, round(quantile_cont(value, 0.975), 6) + 0.0 AS upper FROM long_values GROUP BY 1, 2""",
    ),
    "pointwise_scores": sql_with(
        _SCORES,
        "SELECT model, subject_id, subject_day, round(lpd, 6) AS lpd, round(p_waic, 6) AS p_waic, round(elpd_loo, 6) AS elpd_loo, round(elpd_waic, 6) AS elpd_waic FROM scores",
    ),
    "compare_models": sql_with(
        _SCORES + _COMPARED,
        _COMPARISON,
    ),
    "predictive_check": sql_with(
        _CHECKED,
        "SELECT model, draw, round(replicated_rate, 6) AS replicated_rate, round(observed_rate, 6) AS observed_rate, round(expected_rate, 6) AS expected_rate FROM checks",
    ),
    "predictive_check_summary": sql_with(
        _CHECKED,
        """
SELECT model, round(any_value(observed_rate), 6) AS observed_rate, round(quantile_cont(replicated_rate, 0.025), 6) AS lower,
       round(median(replicated_rate), 6) AS median, round(quantile_cont(replicated_rate, 0.975), 6) AS upper,
       round(avg(CASE WHEN replicated_rate >= observed_rate THEN 1.0 ELSE 0.0 END), 6) AS share_at_or_above FROM checks GROUP BY 1""",
    ),
    "logit_newton_step": _grid_rows() .rstrip() + """
SELECT mode || '|' || measure || '|' || outcome AS model, count(*) AS n, count(*) FILTER (event) AS events,
       CAST(sum(CAST(event AS INTEGER) - 0.5) AS DOUBLE) + 0.0 AS g_one, CAST(sum(low_count * (CAST(event AS INTEGER) - 0.5)) AS DOUBLE) + 0.0 AS g_count,
       CAST(count(*) AS DOUBLE) / 4 AS h_one, CAST(sum(low_count) AS DOUBLE) / 4 AS h_cross, CAST(sum(low_count * low_count) AS DOUBLE) / 4 AS h_count
FROM counted GROUP BY 1""",
    "logit_many_no_intercept": _grid_rows().rstrip() + _GRID_COUNTS + ",\n" + newton_ctes("model_counts", ["model"], "x", intercept=False)
    + " SELECT model, round(b1, 6) + 0.0 AS value, round(se1, 6) AS std_error, true AS converged FROM fit",
    "logit_many": sql_with(
        _MODEL_ROWS + """,
counts AS MATERIALIZED (SELECT model, shannon_scaled AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event) AS DOUBLE) AS e FROM model_rows GROUP BY 1, 2),
""" + newton_ctes("counts", ["model"], "x"),
        """
SELECT model, 'one' AS param, round(b0, 6) + 0.0 AS value, round(se0, 6) AS std_error, true AS converged FROM fit
UNION ALL SELECT model, 'shannon_scaled', round(b1, 6) + 0.0, round(se1, 6), true FROM fit""",
    ),
    "logit_bootstrap": _BOOT_FIT + """
SELECT model, replicate, 'one' AS param, round(b0, 6) + 0.0 AS value, true AS converged FROM fit
UNION ALL SELECT model, replicate, 'low_count', round(b1, 6) + 0.0, true FROM fit""",
    "bootstrap_summary": _BOOT_FIT + """,
drawn AS (SELECT model, 'one' AS param, b0 AS value FROM fit WHERE replicate > 0 UNION ALL SELECT model, 'low_count', b1 FROM fit WHERE replicate > 0)
SELECT model, param, round(avg(value), 6) + 0.0 AS estimate, round(stddev_samp(value), 6) AS est_error,
       round(quantile_cont(value, 0.025), 6) + 0.0 AS q2_5, round(quantile_cont(value, 0.975), 6) + 0.0 AS q97_5 FROM drawn GROUP BY 1, 2""",
    "bootstrap_pooled_intervals": _BOOT_FIT + """,
pooled AS (SELECT split_part(model, '|', 1) AS mode, split_part(model, '|', 2) AS measure, b1 AS value FROM fit WHERE replicate > 0)
""" + _qi("pooled", "mode, measure", "value", fixed.INTERVAL_WIDTHS),
    "ribbon_of_fit": sql_with(
        _MODEL_ROWS + _REPLICATED.format(rows="model_rows", xs="shannon_scaled AS x", by="1, 2, 3", fits=FITS) + newton_ctes("counts", ["model", "replicate"], "x")
        + _GRID.format(n=10) + """,
fitted AS (SELECT g.*, 1 / (1 + exp(-(b0 + b1 * shannon_scaled))) AS fitted FROM grid g JOIN fit USING (model) WHERE replicate > 0),
scales AS (""" + " UNION ALL ".join(f"SELECT '{o}' AS model, avg(shannon) AS mean, stddev_samp(shannon) AS sd FROM kept_{o}" for o in MODELS) + ")",
        " UNION ALL ".join(
            f"SELECT model, point, round(any_value(shannon_scaled * sd + mean), 6) + 0.0 AS shannon_scaled_raw, CAST({w} AS DOUBLE) AS width, "
            f"round(median(fitted), 6) AS median, round(quantile_cont(fitted, {(1 - w) / 2!r}), 6) AS lower, "
            f"round(quantile_cont(fitted, {(1 + w) / 2!r}), 6) AS upper FROM fitted JOIN scales USING (model) GROUP BY model, point"
            for w in fixed.INTERVAL_WIDTHS
        ),
    ),
    "logit_formulas": sql_with(
        _FORMULAS + """,
counts AS MATERIALIZED (SELECT model, one, z1, z2, z12, "count", count(*)::DOUBLE AS n, (count(*) FILTER (event))::DOUBLE AS e FROM stacked GROUP BY ALL),
""" + newton_many("counts", ["model"], [*TERMS[:-1], '"count"']),
        " UNION ALL ".join(
            f"SELECT model, '{x}' AS param, round(b{i}, 6) + 0.0 AS value, round(se{i}, 6) AS std_error, true AS converged FROM fit" for i, x in enumerate(TERMS)
        ),
    ),
    "compare_formulas": sql_with(
        _FORMULAS + _REPLICATED.format(rows="stacked", xs='one, z1, z2, z12, "count"', by="1, 2, 3, 4, 5, 6, 7", fits=FITS)
        + newton_many("counts", ["model", "replicate"], [*TERMS[:-1], '"count"']) + """,
ll AS (
  SELECT model, subject_id, subject_day, CASE WHEN event THEN -ln(1 + exp(-eta)) ELSE -ln(1 + exp(eta)) END AS l
  FROM (SELECT *, b0 + b1 * z1 + b2 * z2 + b3 * z12 + b4 * "count" AS eta FROM stacked JOIN fit USING (model) WHERE replicate > 0)),
scores AS (
  SELECT model, subject_id, subject_day, ln(avg(exp(l))) AS lpd, var_samp(l) AS p_waic, -ln(avg(exp(-l))) AS elpd_loo,
         ln(avg(exp(l))) - var_samp(l) AS elpd_waic FROM ll GROUP BY 1, 2, 3)""" + _COMPARED,
        _COMPARISON,
    ),
    "top_strata": "SELECT props, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, props LIMIT 10",
    "taxon_labels": sql(
        """
SELECT DISTINCT dominant_taxon, CASE WHEN dominant_taxon IN ('click', 'view') THEN 'browsing' ELSE dominant_taxon END AS kind,
       CASE WHEN dominant_taxon IN ('click', 'view') THEN 'browsing' ELSE dominant_taxon END || ' (' || dominant_taxon || ')' AS label FROM samples"""
    ),
    "stratum_slopes": _slopes_sql(4),
    "stratum_slopes_default": _slopes_sql(10),
    "sample_by_size": _LINE_ROWS + """
SELECT effect, CAST(s AS BIGINT) AS sample_size, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS order_keys, count(*) FILTER (event) AS events
FROM placed JOIN (VALUES (100), (200), (300)) AS t(s) ON place <= s GROUP BY 1, 2""",
    "sample_size_sweep": _sweep_sql([100, 300, 600]) + """
SELECT effect, sample_size, round(estimate, 6) AS estimate, round(lower, 6) AS lower, round(upper, 6) AS upper, round(exp(estimate), 6) AS odds_ratio,
       lower > 0 OR upper < 0 AS detected, round(sign_error_share, 6) AS sign_error_share, true AS converged FROM sweep""",
    "detection_share": _sweep_sql([100, 600]) + """
SELECT sample_size, round(avg(CASE WHEN lower > 0 OR upper < 0 THEN 1.0 ELSE 0.0 END), 6) AS detection_share,
       round(avg(sign_error_share), 6) AS sign_error_share FROM sweep GROUP BY 1""",
}
