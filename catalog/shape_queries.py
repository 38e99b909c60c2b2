"""Reading, cleaning and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import r6, rounded, sql, sql_with, text_date
from cohortloom.functions import fixed_values as fixed
from cohortloom.operators import shape
from cohortloom.plans import event_cohort as ec
from cohortloom.plans.lineage import scratch_path
from cohortloom.sources.measurements import read_measurements, read_results, write_resumable, write_results

DAY = ["subject_id", "subject_day"]


def _gappy(spark, sf_dir):
    return ec.with_missing(ec.cohort(spark, sf_dir))


def _measurement_file(spark, sf_dir, file_format):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    written = customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("Undetermined")).otherwise(F.col("c_acctbal").cast("string")).alias("amount"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    path = scratch_path(spark, "measurements")
    sep = "\t" if file_format == "tsv" else ","
    written.write.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)
    df = read_measurements(
        spark, path, "c_custkey long, amount string, segment string", file_format,
        numeric=["amount"], log10={"amount": "log_amount"}, zero="null",
    )
    return rounded(df, "log_amount")


def read_csv(spark, sf_dir):
    return _measurement_file(spark, sf_dir, "csv")


def read_tsv(spark, sf_dir):
    return _measurement_file(spark, sf_dir, "tsv")


READ_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount,
       CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,
       round(CASE WHEN c_custkey % 7 <> 0 AND c_acctbal > 0 THEN log10(c_acctbal) END, 6) + 0.0 AS log_amount
FROM customer"""


def results_round_trip(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    result = events.groupBy("user_id", F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), r6(F.max("value")).alias("largest")
    )
    path = scratch_path(spark, "results")
    write_results(result, path, ["model"])
    return read_results(spark, path, "user_id long, n long, largest double, model string")


def results_resumed(spark, sf_dir):
    """Results by key: a first run of some keys, then a run of all that goes on from there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("model", F.col("event_type"))
    keys = events.select("model").distinct()

    def results(some):
        chosen = events.join(F.broadcast(some), "model")
        return chosen.groupBy("user_id", "model").agg(F.count("*").alias("n"), r6(F.max("value")).alias("largest"))

    path = scratch_path(spark, "results")
    write_resumable(keys.where(F.col("model") < "p"), results, path, "model", batches=2)
    write_resumable(keys, results, path, "model", batches=2)
    return read_results(spark, path, "user_id long, n long, largest double, model string")


def baseline_enrich(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    subjects = customer.select(F.col("c_custkey").alias("subject_id"), "c_mktsegment")
    prior = (
        customer.where(F.col("c_custkey") % 9 != 0)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("subject_id"), F.col("n_name").alias("history"))
    )
    out = shape.baseline_enrich(
        subjects, _gappy(spark, sf_dir), "subject_id", "subject_day", "shannon", prior, "history", "AN|IA$", "pattern_noted"
    )
    return rounded(out, "admission_shannon").withColumn(
        "admission_shannon_above_median", F.col("admission_shannon_above_median").cast("string")
    )


def densify_calendar(spark, sf_dir):
    df = _gappy(spark, sf_dir).select("subject_id", "subject_day", "date", "shannon", "dominant_taxon")
    return text_date(shape.densify_calendar(df, "subject_id", "subject_day", block_days=7), "date")


def locf(spark, sf_dir):
    df = _gappy(spark, sf_dir).select(*DAY, "shannon", "log_abundance", "dominant_taxon")
    return rounded(shape.locf(df, "subject_id", "subject_day", ["shannon", "log_abundance", "dominant_taxon"], block_days=7), "shannon", "log_abundance")


def densify_and_fill(spark, sf_dir):
    out = ec.filled_calendar(_gappy(spark, sf_dir)).select(
        *DAY, "date", "shannon", "max_read_prop", "log_abundance", "dominant_taxon", "synthetic", "first_confirmed"
    )
    return rounded(text_date(out, "date", "first_confirmed"), "shannon", "max_read_prop", "log_abundance")


def normalise_missing(spark, sf_dir):
    df = _gappy(spark, sf_dir)
    gap = F.col("subject_day") % 4 == 0
    holes = df.select(
        *DAY,
        F.when(F.col("shannon").isNull(), F.lit(float("nan"))).otherwise(F.col("shannon")).alias("shannon"),
        F.when(~gap, F.col("suspected")).alias("suspected"),
        F.when(~gap, F.col("first_confirmed")).alias("first_confirmed"),
    )
    out = shape.normalise_missing(
        holes, "subject_id", "subject_day", flags=["suspected"], static=["first_confirmed"], nan_columns=["shannon"], block_days=7
    )
    return rounded(text_date(out, "first_confirmed"), "shannon")


def censor_until_event(spark, sf_dir):
    df = ec.cohort(spark, sf_dir)
    out = shape.censor_at_first(df, "subject_id", "date", "first_confirmed")
    return rounded(text_date(out.select(*DAY, "date", "shannon", "confirmed"), "date"), "shannon")


def censor_event_day(spark, sf_dir):
    df = ec.cohort(spark, sf_dir)
    out = shape.censor_at_first(df, "subject_id", "date", "first_confirmed", mode="event_day", block_days=7)
    return rounded(text_date(out.select(*DAY, "date", "shannon", "confirmed"), "date"), "shannon")


def censor_null_dates_propagate(spark, sf_dir):
    df = ec.filled_calendar(_gappy(spark, sf_dir)).withColumn("date", F.when(~F.col("synthetic"), F.col("date")))
    out = shape.censor_at_first(
        df, "subject_id", "date", "first_confirmed", null_policy="propagate", block_days=7
    )
    return rounded(text_date(out.select(*DAY, "date", "shannon"), "date"), "shannon")


def zscore(spark, sf_dir):
    df = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_suspected")
    cols = ["shannon", "max_read_prop", "log_abundance"]
    out = shape.zscore(df.select(*DAY, *cols), cols)
    return rounded(out, *cols, *[f"{c}_scaled" for c in cols])


def analysis_set(spark, sf_dir):
    df = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_suspected")
    cols = ["shannon", "max_read_prop", "log_abundance"]
    out = shape.analysis_set(shape.zscore(df, cols), ["subject_id", *[f"{c}_scaled" for c in cols], "suspected"])
    return rounded(out, *[f"{c}_scaled" for c in cols])


def _imputed(spark, sf_dir, mode):
    gappy, cols = _gappy(spark, sf_dir), [*DAY, "shannon", "log_abundance", "suspected"]
    return shape.impute(gappy.select(*cols), ec.filled_calendar(gappy).select(*cols), mode, "suspected")


def impute_event_day(spark, sf_dir):
    return rounded(_imputed(spark, sf_dir, "event_day"), "shannon", "log_abundance")


def impute_full(spark, sf_dir):
    out = _imputed(spark, sf_dir, "full").withColumn("suspected", F.col("suspected").cast("string"))
    return rounded(out, "shannon", "log_abundance")


def imputation_share(spark, sf_dir):
    gappy, cols = _gappy(spark, sf_dir), [*DAY, "shannon", "log_abundance", "suspected"]
    both = shape.impute(gappy.select(*cols), ec.filled_calendar(gappy).select(*cols), "event_day", "suspected", dedup=True)
    total = both.where(F.col("shannon").isNotNull())
    observed = gappy.where(F.col("shannon").isNotNull())
    return shape.imputation_share(total, observed)


def to_long(spark, sf_dir):
    return rounded(shape.to_long(_gappy(spark, sf_dir), DAY, ["shannon", "max_read_prop", "log_abundance"]), "value")


def explode_tokens(spark, sf_dir):
    df = ec.samples(spark, sf_dir).select("subject_id", "date", "tokens")
    out = shape.explode_tokens(df, "tokens", "organism", rules=[("^Click$", "Click (any)"), ("_", " ")])
    return text_date(out, "date")


def explode_first_tokens(spark, sf_dir):
    """The first four tokens, where a caller asks for no more."""
    df = ec.samples(spark, sf_dir).select("subject_id", "date", "tokens")
    return text_date(shape.explode_tokens(df, "tokens", "organism", max_parts=4, title_case=False), "date")


def recode_by_pattern(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority"))
    rules = [("URGENT|HIGH", "pressing"), ("LOW|NOT", "other")]
    return shape.recode_by_pattern(df, "priority", rules, "not recorded")


def label_columns_and_values(spark, sf_dir):
    long = shape.to_long(_gappy(spark, sf_dir), DAY, ["shannon", "max_read_prop"])
    named = shape.label_values(long, "measure", {k: fixed.MEASURE_LABELS[k] for k in ("shannon", "max_read_prop")})
    named = rounded(named, "value")
    return shape.label_columns(named, {"measure": "MDI", "value": "MDI Value", "subject_day": "Day"})


def significant_digits(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    return shape.signif(items, ["l_extendedprice", "l_tax"], 3)


QUERIES = {
    "read_csv": read_csv,
    "read_tsv": read_tsv,
    "results_round_trip": results_round_trip,
    "results_resumed": results_resumed,
    "baseline_enrich": baseline_enrich,
    "densify_calendar": densify_calendar,
    "locf": locf,
    "densify_and_fill": densify_and_fill,
    "normalise_missing": normalise_missing,
    "censor_until_event": censor_until_event,
    "censor_event_day": censor_event_day,
    "censor_null_dates_propagate": censor_null_dates_propagate,
    "zscore": zscore,
    "analysis_set": analysis_set,
    "impute_event_day": impute_event_day,
    "impute_full": impute_full,
    "imputation_share": imputation_share,
    "to_long": to_long,
    "explode_tokens": explode_tokens,
    "explode_first_tokens": explode_first_tokens,
    "recode_by_pattern": recode_by_pattern,
    "label_columns_and_values": label_columns_and_values,
    "significant_digits": significant_digits,
}

_Z = "(m.{0} - avg(m.{0}) OVER ()) / nullif(stddev_samp(m.{0}) OVER (), 0)"
_KEPT = "kept AS (SELECT * FROM gappy WHERE date <= coalesce(first_suspected, (SELECT max(date) FROM cohort)))"
_EVENT_DAY = """both_rows AS (
  SELECT subject_id, subject_day, shannon, log_abundance, suspected FROM gappy
  UNION ALL SELECT subject_id, subject_day, shannon, log_abundance, suspected FROM filled WHERE suspected)"""

ORACLE = {
    "read_csv": READ_SQL,
    "read_tsv": READ_SQL,
    "results_round_trip": """
SELECT user_id, event_type AS model, count(*) AS n, round(max(value), 6) AS largest FROM events GROUP BY 1, 2""",
    "results_resumed": """
SELECT user_id, event_type AS model, count(*) AS n, round(max(value), 6) AS largest FROM events GROUP BY 1, 2""",
    "baseline_enrich": sql_with(
        """
subj AS (
  SELECT c.c_custkey AS subject_id, c.c_mktsegment, d.shannon AS admission_shannon,
         CASE WHEN c.c_custkey % 9 <> 0 THEN n.n_name END AS history
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT DISTINCT subject_id, shannon FROM gappy WHERE subject_day = 0) d ON c.c_custkey = d.subject_id)""",
        """
SELECT subject_id, c_mktsegment, round(admission_shannon, 6) AS admission_shannon,
       CAST(admission_shannon > (SELECT median(admission_shannon) FROM subj) AS VARCHAR) AS admission_shannon_above_median,
       history, coalesce(regexp_matches(history, 'AN|IA$'), false) AS pattern_noted
FROM subj""",
    ),
    "densify_calendar": sql(
        """
SELECT c.subject_id, c.subject_day, strftime(g.date, '%Y-%m-%d') AS date, g.shannon, g.dominant_taxon
FROM calendar c LEFT JOIN gappy g ON c.subject_id = g.subject_id AND c.subject_day = g.subject_day"""
    ),
    "locf": sql(
        """
SELECT subject_id, subject_day,
       round(last_value(shannon IGNORE NULLS) OVER w, 6) AS shannon,
       round(last_value(log_abundance IGNORE NULLS) OVER w, 6) AS log_abundance,
       last_value(dominant_taxon IGNORE NULLS) OVER w AS dominant_taxon
FROM gappy WINDOW w AS (PARTITION BY subject_id ORDER BY subject_day ROWS UNBOUNDED PRECEDING)"""
    ),
    "densify_and_fill": sql(
        """
SELECT subject_id, subject_day, strftime(date, '%Y-%m-%d') AS date, round(shannon, 6) AS shannon,
       round(max_read_prop, 6) AS max_read_prop, round(log_abundance, 6) AS log_abundance, dominant_taxon, synthetic,
       strftime(first_confirmed, '%Y-%m-%d') AS first_confirmed
FROM filled"""
    ),
    "normalise_missing": sql(
        """
SELECT subject_id, subject_day, round(shannon, 6) AS shannon,
       CASE WHEN subject_day % 4 <> 0 THEN suspected ELSE false END AS suspected,
       strftime(max(CASE WHEN subject_day % 4 <> 0 THEN first_confirmed END) OVER (PARTITION BY subject_id), '%Y-%m-%d') AS first_confirmed
FROM gappy"""
    ),
    "censor_until_event": sql(
        """
SELECT subject_id, subject_day, strftime(date, '%Y-%m-%d') AS date, round(shannon, 6) AS shannon, confirmed
FROM (SELECT *, coalesce(first_confirmed, max(date) OVER (PARTITION BY subject_id)) AS stop FROM cohort) WHERE date <= stop"""
    ),
    "censor_event_day": sql(
        """
SELECT subject_id, subject_day, strftime(date, '%Y-%m-%d') AS date, round(shannon, 6) AS shannon, confirmed
FROM (SELECT *, coalesce(first_confirmed, max(date) OVER (PARTITION BY subject_id)) AS stop FROM cohort) WHERE date = stop"""
    ),
    "censor_null_dates_propagate": sql_with(
        """
undated AS (SELECT * REPLACE (CASE WHEN NOT synthetic THEN date END AS date) FROM filled),
stops AS (
  SELECT subject_id, CASE WHEN count(*) = count(date) THEN max(date) END AS last_date FROM undated GROUP BY 1)""",
        """
SELECT u.subject_id, u.subject_day, strftime(u.date, '%Y-%m-%d') AS date, round(u.shannon, 6) AS shannon
FROM undated u JOIN stops s USING (subject_id) WHERE u.date <= coalesce(u.first_confirmed, s.last_date)""",
    ),
    "zscore": sql_with(
        _KEPT,
        "SELECT subject_id, subject_day, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("shannon", "max_read_prop", "log_abundance"))
        + ", "
        + ", ".join(f"round({_Z.format(c)}, 6) + 0.0 AS {c}_scaled" for c in ("shannon", "max_read_prop", "log_abundance"))
        + " FROM kept m",
    ),
    "analysis_set": sql_with(
        _KEPT
        + ",\nscaled AS (SELECT subject_id, suspected, "
        + ", ".join(f"{_Z.format(c)} AS {c}_scaled" for c in ("shannon", "max_read_prop", "log_abundance"))
        + " FROM kept m)",
        """
SELECT DISTINCT subject_id, round(shannon_scaled, 6) + 0.0 AS shannon_scaled, round(max_read_prop_scaled, 6) + 0.0 AS max_read_prop_scaled,
       round(log_abundance_scaled, 6) + 0.0 AS log_abundance_scaled, suspected
FROM scaled WHERE shannon_scaled IS NOT NULL AND max_read_prop_scaled IS NOT NULL AND log_abundance_scaled IS NOT NULL""",
    ),
    "impute_event_day": sql_with(
        _EVENT_DAY,
        "SELECT subject_id, subject_day, round(shannon, 6) AS shannon, round(log_abundance, 6) AS log_abundance, suspected FROM both_rows",
    ),
    "impute_full": sql(
        """
SELECT subject_id, subject_day, round(shannon, 6) AS shannon, round(log_abundance, 6) AS log_abundance,
       CAST(suspected AS VARCHAR) AS suspected FROM filled"""
    ),
    "imputation_share": sql_with(
        _EVENT_DAY,
        """
SELECT n_total, n_observed, round(100.0 * (n_total - n_observed) / n_total, 1) AS share
FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM both_rows WHERE shannon IS NOT NULL)) AS n_total,
             (SELECT count(*) FROM gappy WHERE shannon IS NOT NULL) AS n_observed)""",
    ),
    "to_long": sql(
        """
SELECT subject_id, subject_day, 'shannon' AS measure, round(shannon, 6) AS value FROM gappy WHERE shannon IS NOT NULL
UNION ALL SELECT subject_id, subject_day, 'max_read_prop', round(max_read_prop, 6) FROM gappy WHERE max_read_prop IS NOT NULL
UNION ALL SELECT subject_id, subject_day, 'log_abundance', round(log_abundance, 6) FROM gappy WHERE log_abundance IS NOT NULL"""
    ),
    "explode_tokens": sql(
        """
SELECT subject_id, strftime(date, '%Y-%m-%d') AS date,
       CASE WHEN t = 'click' THEN 'Click (any)' ELSE upper(t[1]) || t[2:] END AS organism
FROM (SELECT subject_id, date, unnest(string_split(tokens, ' ')) AS t FROM samples)"""
    ),
    "explode_first_tokens": sql(
        "SELECT subject_id, strftime(date, '%Y-%m-%d') AS date, unnest(string_split(tokens, ' ')[1:4]) AS organism FROM samples"
    ),
    "recode_by_pattern": """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'not recorded'
  WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'pressing'
  WHEN o_orderpriority LIKE '%LOW%' OR o_orderpriority LIKE '%NOT%' THEN 'other' ELSE o_orderpriority END AS priority
FROM orders""",
    "label_columns_and_values": sql(
        """
SELECT subject_id, subject_day AS "Day", 'Shannon Diversity (base e)' AS "MDI", round(shannon, 6) AS "MDI Value" FROM gappy WHERE shannon IS NOT NULL
UNION ALL SELECT subject_id, subject_day, 'Max ASV Proportional Abundance', round(max_read_prop, 6) FROM gappy WHERE max_read_prop IS NOT NULL"""
    ),
    "significant_digits": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE round(l_extendedprice / pow(10, floor(log10(abs(l_extendedprice))) - 2)) * pow(10, floor(log10(abs(l_extendedprice))) - 2) END AS l_extendedprice,
       CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_tax, CAST(2 - floor(log10(abs(l_tax))) AS INTEGER)) END AS l_tax
FROM lineitem""",
}
