"""Description of outcomes and cohort, and association between measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SQL_COHORT, r6, rounded, sql, sql_with, text_date
from cohortloom.functions import fixed_values as fixed
from cohortloom.operators import associate, describe, shape
from cohortloom.plans import event_cohort as ec

DAY = ["subject_id", "subject_day"]
FLAGS = list(ec.OUTCOMES)
MEASURES = list(ec.MEASURES)


def _gappy(spark, sf_dir):
    return ec.with_missing(ec.cohort(spark, sf_dir))


def _rollup(spark, sf_dir):
    return describe.first_event_rollup(ec.cohort(spark, sf_dir), "subject_id", "subject_day", FLAGS)


def first_event_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


def definition_prevalence(spark, sf_dir):
    return describe.definition_prevalence(_rollup(spark, sf_dir), "subject_id", FLAGS)


def time_to_event_summary(spark, sf_dir):
    out = describe.time_to_event_summary(_rollup(spark, sf_dir), "subject_id", FLAGS)
    return rounded(out, "mean", "sd", "median", "iqr")


def frequency(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return describe.frequency(events, "props", "occurrences")


def frequency_of_recoded_text(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority")
    recoded = shape.recode_by_pattern(orders, "o_orderpriority", [("URGENT|HIGH", "pressing")])
    return describe.frequency(recoded, "o_orderpriority", "orders")


def same_day_concordance(spark, sf_dir):
    rows = ec.samples(spark, sf_dir)
    cultures = shape.explode_tokens(
        rows.where("suspected").select("subject_id", "date", "tokens"), "tokens", "organism", title_case=False
    )
    dominant = ec.with_missing(ec.cohort(spark, sf_dir)).select("subject_id", "date", "dominant_taxon")
    out = describe.same_day_concordance(cultures, dominant, ["subject_id", "date"], "organism", "dominant_taxon")
    return text_date(out, "date")


def specimen_totals(spark, sf_dir):
    return describe.specimen_totals(_gappy(spark, sf_dir), MEASURES)


def period_activity_weeks(spark, sf_dir):
    return describe.period_activity(_gappy(spark, sf_dir), "subject_id", "subject_day", MEASURES, fixed.WEEK_PERIODS)


def period_activity_enrollment(spark, sf_dir):
    return describe.period_activity(_gappy(spark, sf_dir), "subject_id", "subject_day", MEASURES, fixed.ENROLLMENT_PERIODS)


def box_summary(spark, sf_dir):
    long = shape.to_long(_gappy(spark, sf_dir), DAY, MEASURES)
    long = long.withColumn("period", describe.period_of("subject_day", fixed.ENROLLMENT_PERIODS))
    out = describe.box_summary(long, ["measure", "period"], "value", len(MEASURES) * len(fixed.ENROLLMENT_PERIODS))
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


def box_summary_line_items(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    out = describe.box_summary(items, ["l_returnflag"], "l_extendedprice")
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


def _subjects(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spent = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), r6(F.sum("o_totalprice")).alias("spent"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    segment = F.col("c_mktsegment")
    return (
        customer.join(spent, "c_custkey", "left")
        .withColumns(
            {
                "in_debt": F.col("c_acctbal") < 0,
                "arm": F.when(segment == "BUILDING", "high").when(segment == "MACHINERY", "low"),
            }
        )
    )


def baseline_table(spark, sf_dir):
    out = describe.baseline_table(
        _subjects(spark, sf_dir), "arm", ["high", "low"], ["c_acctbal", "n_orders", "spent"], ["c_mktsegment"], ["in_debt", "urgent"], add_p=True
    )
    return rounded(out, "percent", "median", "q1", "q3", "p")


def _rank_input(spark, sf_dir):
    return shape.to_long(_subjects(spark, sf_dir), ["arm"], ["c_acctbal", "n_orders", "spent"], "variable")


def rank_sum_statistics(spark, sf_dir):
    out = describe.rank_sum_statistics(_rank_input(spark, sf_dir), "variable", "value", "arm", "high", "low", 3)
    return rounded(out, "u", "z")


def rank_sum_line_items(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", "l_quantity", "l_extendedprice")
    long = shape.to_long(items, ["l_linestatus"], ["l_quantity", "l_extendedprice"], "variable")
    out = describe.rank_sum_statistics(long, "variable", "value", "l_linestatus", "F", "O", 2, continuity=False)
    return rounded(out, "u", "z")


def rank_sum_test(spark, sf_dir):
    out = describe.rank_sum_test(_rank_input(spark, sf_dir), "variable", "value", "arm", "high", "low", 3)
    return rounded(out, "u", "z", "p")


def _levels(spark, sf_dir):
    subjects = _subjects(spark, sf_dir).withColumn("nation", F.col("c_nationkey"))
    return shape.to_long(subjects, ["arm"], ["in_debt", "urgent", "nation"], "variable", "level", value_type="string")


def contingency_statistics(spark, sf_dir):
    out = describe.contingency_statistics(_levels(spark, sf_dir), "variable", "level", "arm")
    return rounded(out, "chi_square", "min_expected", "a", "b", "c", "d")


def contingency_test(spark, sf_dir):
    out = describe.contingency_test(_levels(spark, sf_dir), "variable", "level", "arm")
    return rounded(out, "chi_square", "min_expected", "a", "b", "c", "d", "p")


def correlate(spark, sf_dir):
    df = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_suspected")
    pairs = [("shannon", "log_abundance"), ("max_read_prop", "log_abundance"), ("shannon", "max_read_prop")]
    return rounded(associate.correlate(df, pairs), "estimate", "lower", "upper")


def _correlate_by(spark, sf_dir, center):
    df = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_suspected")
    out = associate.correlate_by(
        df, "dominant_taxon", "shannon", "log_abundance", 5, fixed.NO_DOMINANT_GENUS, center
    )
    return rounded(out, "estimate", "lower", "upper")


def correlate_by_stratum(spark, sf_dir):
    return _correlate_by(spark, sf_dir, "stratum")


def correlate_by_stratum_table_means(spark, sf_dir):
    return _correlate_by(spark, sf_dir, "table")


def _suppliers(spark, sf_dir):
    """Suppliers of five groups of nations: their balance, whether it is high, and whether their nation's number is even."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return supplier.select(
        F.concat(F.lit("g"), F.floor(F.col("s_nationkey") / 5).cast("string")).alias("variable"), F.col("s_acctbal").alias("value"),
        F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("arm"), F.col("s_nationkey").cast("string").alias("nation"),
        F.when(F.col("s_acctbal") > 4500, "high").otherwise("low").alias("balance"),
    )


def rank_sum_exact(spark, sf_dir):
    """Exact p-values of small groups without ties."""
    out = describe.rank_sum_exact(_suppliers(spark, sf_dir), "variable", "value", "arm", "even", "odd", 5)
    return rounded(out, "u", "z", "p")


def contingency_exact(spark, sf_dir):
    """Nations by balance: tables of up to five rows with few suppliers in each."""
    out = describe.contingency_exact(_suppliers(spark, sf_dir), "variable", "nation", "balance")
    out = out.select("variable", "n", F.col("df").cast("long").alias("df"), "chi_square", "min_expected", "test", "p")
    return rounded(out, "chi_square", "min_expected", "p")


def subject_trend(spark, sf_dir):
    long = shape.to_long(_gappy(spark, sf_dir), DAY, MEASURES)
    return rounded(
        associate.subject_trend(long, "subject_id", "subject_day", "measure", "value"), "slope", "std_error", "lower", "upper"
    )


def _random_intercept(spark, sf_dir, **options):
    long = shape.to_long(_gappy(spark, sf_dir), DAY, MEASURES)
    out = associate.random_intercept(long, "subject_id", "subject_day", "measure", "value", **options)
    return rounded(out, *[c for c in out.columns if c not in ("measure", "n", "subjects", *([] if options else ["level"]))])


def random_intercept(spark, sf_dir):
    """measure ~ 0 + day + (1 | subject)"""
    return _random_intercept(spark, sf_dir)


def random_intercept_common_level(spark, sf_dir):
    """measure ~ 1 + day + (1 | subject)"""
    return _random_intercept(spark, sf_dir, intercept=True)


def affine_fit(spark, sf_dir):
    df = shape.censor_at_first(_gappy(spark, sf_dir), "subject_id", "date", "first_confirmed")
    out = associate.affine_fit(shape.zscore(df, ["max_read_prop"]), "max_read_prop", "max_read_prop_scaled")
    return rounded(out, "intercept", "slope")


QUERIES = {
    "first_event_rollup": first_event_rollup,
    "definition_prevalence": definition_prevalence,
    "time_to_event_summary": time_to_event_summary,
    "frequency": frequency,
    "frequency_of_recoded_text": frequency_of_recoded_text,
    "same_day_concordance": same_day_concordance,
    "specimen_totals": specimen_totals,
    "period_activity_weeks": period_activity_weeks,
    "period_activity_enrollment": period_activity_enrollment,
    "box_summary": box_summary,
    "box_summary_line_items": box_summary_line_items,
    "baseline_table": baseline_table,
    "rank_sum_statistics": rank_sum_statistics,
    "rank_sum_line_items": rank_sum_line_items,
    "rank_sum_test": rank_sum_test,
    "contingency_statistics": contingency_statistics,
    "contingency_test": contingency_test,
    "correlate": correlate,
    "correlate_by_stratum": correlate_by_stratum,
    "correlate_by_stratum_table_means": correlate_by_stratum_table_means,
    "rank_sum_exact": rank_sum_exact,
    "contingency_exact": contingency_exact,
    "subject_trend": subject_trend,
    "random_intercept": random_intercept,
    "random_intercept_common_level": random_intercept_common_level,
    "affine_fit": affine_fit,
}

_ROLLUP = "rollup_rows AS (SELECT subject_id, " + ", ".join(
    f"bool_or({f}) AS any_{f}, coalesce(min(CASE WHEN {f} THEN subject_day END), max(subject_day)) AS {f}_day" for f in FLAGS
) + " FROM cohort GROUP BY 1)"
_DEFINITIONS = _ROLLUP + ",\ndefinitions AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS definition, any_{f} AS occurred, CAST({f}_day AS DOUBLE) AS days FROM rollup_rows" for f in FLAGS
) + ")"
_LONG = "long_rows AS (" + " UNION ALL ".join(
    f"SELECT subject_id, subject_day, '{m}' AS measure, {m} AS value FROM gappy WHERE {m} IS NOT NULL" for m in MEASURES
) + ")"


def _case(periods, what):
    text = "CASE"
    for i, (label, low, high) in enumerate(periods):
        upper = "" if high is None else f" AND subject_day < {high}"
        value = f"'{label}'" if what == "label" else str(i + 1)
        text += f" WHEN subject_day >= {low}{upper} THEN {value}"
    return text + " END"


def _activity(periods):
    return sql_with(
        _LONG,
        f"""
SELECT measure, {_case(periods, "label")} AS period, {_case(periods, "rank")} AS period_order,
       count(DISTINCT subject_id) AS subjects, count(*) AS specimens FROM long_rows GROUP BY 1, 2, 3""",
    )


def _box(source, by, value):
    keys = ", ".join(by)
    on = " AND ".join(f"r.{k} = q.{k}" for k in by)
    return f"""
quartiles AS (
  SELECT {keys}, count(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
  FROM {source} GROUP BY {keys})
SELECT {", ".join("q." + k for k in by)}, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(r.{value}) FILTER (r.{value} >= q1 - 1.5 * (q3 - q1) AND r.{value} <= q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_low,
       round(max(r.{value}) FILTER (r.{value} >= q1 - 1.5 * (q3 - q1) AND r.{value} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (r.{value} < q1 - 1.5 * (q3 - q1) OR r.{value} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} r JOIN quartiles q ON {on} GROUP BY {", ".join("q." + k for k in by)}, q.n, q1, median, q3"""


_SUBJECTS = """
WITH spent AS (
  SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 6) AS spent, bool_or(o_orderpriority = '1-URGENT') AS urgent
  FROM orders GROUP BY 1),
subj AS (
  SELECT c.*, n_orders, spent, urgent, c_acctbal < 0 AS in_debt,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'high' WHEN c_mktsegment = 'MACHINERY' THEN 'low' END AS arm
  FROM customer c LEFT JOIN spent USING (c_custkey))"""


def _baseline_sql():
    parts = []
    for group, where in (("overall", "true"), ("high", "arm = 'high'"), ("low", "arm = 'low'")):
        for v in ("c_acctbal", "n_orders", "spent"):
            parts.append(
                f"SELECT '{v}' AS variable, '' AS level, '{group}' AS \"group\", count({v}) AS count, CAST(NULL AS DOUBLE) AS percent, "
                f"round(median({v}), 6) AS median, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.75), 6) AS q3 FROM subj WHERE {where}"
            )
        parts.append(
            f"SELECT 'c_mktsegment', c_mktsegment, '{group}', count(*), round(100.0 * count(*) / sum(count(*)) OVER (), 6), NULL, NULL, NULL "
            f"FROM subj WHERE {where} GROUP BY c_mktsegment"
        )
        for v in ("in_debt", "urgent"):
            parts.append(
                f"SELECT '{v}', 'TRUE', '{group}', count(*) FILTER ({v}), round(100.0 * count(*) FILTER ({v}) / count({v}), 6), NULL, NULL, NULL FROM subj WHERE {where}"
            )
    return _SUBJECTS + "\n" + " UNION ALL ".join(parts)


def _baseline_with_p():
    levels = _CHI.replace("SELECT 'nation', CAST(c_nationkey AS VARCHAR), arm", "SELECT 'c_mktsegment', c_mktsegment, arm")
    ranks = _rank_test_sql()
    return f"""
SELECT b.*, test, p FROM ({_baseline_sql()}) b JOIN (
  SELECT variable, 'rank_sum' AS test, p FROM ({ranks}) UNION ALL SELECT variable, test, p FROM ({_contingency_sql(levels)})) t USING (variable)"""


def _rank_test_sql():
    z = "(u - n1 * n2 / 2.0 - sign(u - n1 * n2 / 2.0) * 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - tied / (n * (n - 1))))"
    full = _rank_sql(_RANK_LONG, "long_rows", "arm", "high", "low", True).replace(" AS z FROM stats", f" AS z, {z} AS z_full FROM stats")
    return f"SELECT variable, n1, n2, u, z, round({normal_p('z_full')}, 6) + 0.0 AS p FROM ({full})"


def _rank_sql(prefix, source, group, first, second, continuity):
    shift = "sign(u - n1 * n2 / 2.0) * 0.5" if continuity else "0.0"
    return f"""{prefix},
ranked AS (
  SELECT variable, value, {group} AS g, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r
  FROM {source} WHERE {group} IN ('{first}', '{second}') AND value IS NOT NULL),
ties AS (SELECT variable, sum(t * t * t - t) AS tied FROM (SELECT variable, CAST(count(*) AS DOUBLE) AS t FROM ranked GROUP BY variable, value) GROUP BY 1),
sums AS (
  SELECT variable, count(*) FILTER (g = '{first}') AS n1, count(*) FILTER (g = '{second}') AS n2,
         CAST(sum(r) FILTER (g = '{first}') AS DOUBLE) AS w FROM ranked GROUP BY 1),
stats AS (SELECT s.*, w - n1 * (n1 + 1) / 2.0 AS u, n1 + n2 AS n, tied FROM sums s JOIN ties USING (variable))
SELECT variable, n1, n2, round(u, 6) AS u,
       round((u - n1 * n2 / 2.0 - {shift}) / sqrt(n1 * n2 / 12.0 * ((n + 1) - tied / (n * (n - 1)))), 6) AS z FROM stats"""


def normal_p(z):
    """Two-sided normal p-value: one minus the error function, from its series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    terms = f"exp(2 * i * ln(2.0) + (2 * i + 1) * ln({x}) - {x} * {x} - lgamma(2.0 * i + 2) + lgamma(i + 1.0))"
    return f"CASE WHEN {z} = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum([{terms} FOR i IN range(0, 4000)])) END"


def chi_square_p(x, df):
    """Upper tail of chi-square: one minus the series of the lower incomplete gamma function."""
    a, y = f"({df} / 2.0)", f"({x} / 2.0)"
    terms = f"exp(({a} + i) * ln({y}) - {y} - lgamma({a} + i + 1))"
    return f"CASE WHEN {x} <= 0 OR {df} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([{terms} FOR i IN range(0, 4000)])) END"


def fisher_p(a, b, c, d):
    """Fisher's exact test: total probability of the tables with these margins that are no likelier."""
    pick = lambda n, k: f"(lgamma(CAST({n} AS DOUBLE) + 1) - lgamma(CAST({k} AS DOUBLE) + 1) - lgamma(CAST({n} AS DOUBLE) - ({k}) + 1))"
    prob = lambda k: f"exp({pick(f'({a} + {b})', k)} + {pick(f'({c} + {d})', f'({a} + {c} - {k})')} - {pick(f'({a} + {b} + {c} + {d})', f'({a} + {c})')})"
    low, high = f"greatest(0, {a} - {d})", f"least({a} + {b}, {a} + {c})"
    listed = f"[{prob('k')} FOR k IN range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1)]"
    return f"least(1.0, list_sum([p FOR p IN {listed} IF p <= {prob(a)} * (1 + 1e-7)]))"


_RANK_LONG = _SUBJECTS + ", long_rows AS (" + " UNION ALL ".join(
    f"SELECT arm, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM subj" for v in ("c_acctbal", "n_orders", "spent")
) + ")"

_CHI = """
, long_rows AS (
  SELECT 'in_debt' AS variable, CAST(in_debt AS VARCHAR) AS level, arm FROM subj
  UNION ALL SELECT 'urgent', CAST(urgent AS VARCHAR), arm FROM subj
  UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), arm FROM subj),
usable AS (SELECT * FROM long_rows WHERE level IS NOT NULL AND arm IS NOT NULL),
r AS (SELECT variable, level, count(*) AS r FROM usable GROUP BY 1, 2),
c AS (SELECT variable, arm, count(*) AS c FROM usable GROUP BY 1, 2),
t AS (SELECT variable, count(*) AS n, count(DISTINCT level) AS nl, count(DISTINCT arm) AS ng, min(level) AS l1, min(arm) AS g1 FROM usable GROUP BY 1),
o AS (SELECT variable, level, arm, count(*) AS o FROM usable GROUP BY 1, 2, 3),
cells AS (
  SELECT t.*, r.level, c.arm, coalesce(o, 0) AS o, r.r * c.c / CAST(n AS DOUBLE) AS e
  FROM r JOIN c USING (variable) JOIN t USING (variable) LEFT JOIN o USING (variable, level, arm))
SELECT variable, n, (nl - 1) * (ng - 1) AS df, round(sum((o - e) * (o - e) / e), 6) AS chi_square, round(min(e), 6) AS min_expected,
       CASE WHEN nl = 2 AND ng = 2 THEN CAST(sum(o) FILTER (level = l1 AND arm = g1) AS DOUBLE) END AS a,
       CASE WHEN nl = 2 AND ng = 2 THEN CAST(sum(o) FILTER (level = l1 AND arm <> g1) AS DOUBLE) END AS b,
       CASE WHEN nl = 2 AND ng = 2 THEN CAST(sum(o) FILTER (level <> l1 AND arm = g1) AS DOUBLE) END AS c,
       CASE WHEN nl = 2 AND ng = 2 THEN CAST(sum(o) FILTER (level <> l1 AND arm <> g1) AS DOUBLE) END AS d
FROM cells GROUP BY variable, n, nl, ng"""

_BOUNDS = """
round(r, 6) AS estimate,
CASE WHEN n > 3 THEN round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) END AS lower,
CASE WHEN n > 3 THEN round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) END AS upper"""
_KEPT = "kept AS (SELECT * FROM gappy WHERE date <= coalesce(first_suspected, DATE '9999-01-01'))"
_PAIRS = """,
pairs AS (SELECT coalesce(dominant_taxon, 'no dominant genus') AS dominant_taxon, shannon AS x, log_abundance AS y
          FROM kept WHERE shannon IS NOT NULL AND log_abundance IS NOT NULL)"""
_STRATA = f"""
SELECT *, coalesce((estimate > 0 AND lower > 0 AND upper > 0) OR (estimate < 0 AND lower < 0 AND upper < 0), false) AS same_sign
FROM (SELECT dominant_taxon, n, {_BOUNDS} FROM strata WHERE n > 5)"""

def _contingency_sql(statistics=_CHI):
    raw = (_SUBJECTS + statistics).replace("round(sum((o - e) * (o - e) / e), 6) AS chi_square", "sum((o - e) * (o - e) / e) AS chi_square").replace(
        "round(min(e), 6) AS min_expected", "min(e) AS min_expected")
    small, two = "min_expected < 5", "a IS NOT NULL"
    return f"""
SELECT variable, n, df, round(chi_square, 6) AS chi_square, round(min_expected, 6) AS min_expected, a, b, c, d,
       CASE WHEN {small} AND {two} THEN 'fisher' WHEN {small} THEN 'chi_square_small_expected' ELSE 'chi_square' END AS test,
       round(CASE WHEN {small} AND {two} THEN {fisher_p("a", "b", "c", "d")} ELSE {chi_square_p("chi_square", "df")} END, 6) + 0.0 AS p
FROM ({raw})"""


def _random_intercept_sql(level):
    """The profile likelihood over subjects themselves, its derivative halved in a recursive query."""
    c = "(lam / (1 + lam * n))"

    def fit(rows, keys):
        sums = f"""SELECT {keys}, sum(n) AS nt, sum(xx - {c} * x * x) AS axx, sum(xy - {c} * x * y) AS axy, sum(yy - {c} * y * y) AS ayy,
          sum(n - {c} * n * n) AS ann, sum(x - {c} * n * x) AS ax, sum(y - {c} * n * y) AS ay FROM {rows} GROUP BY {keys}"""
        if not level:
            return f"SELECT *, axx AS info, axy / axx AS b, 0.0::DOUBLE AS a, ayy - axy / axx * axy AS rss FROM ({sums})"
        return f"""SELECT *, ayy - b * axy - a * ay AS rss FROM (SELECT *, (ay - b * ax) / ann AS a FROM (
          SELECT *, axx - ax * ax / ann AS info, (axy - ax * ay / ann) / (axx - ax * ax / ann) AS b FROM ({sums})))"""

    def slope(table, keys):
        fitted = fit(f"(SELECT * FROM {table} JOIN per USING (measure))", keys)
        return f"""SELECT {keys}, sum(n / (1 + lam * n)) - any_value(nt) * sum((y - b * x - a * n) ** 2 / (1 + lam * n) ** 2) / any_value(rss) AS d
          FROM ({fitted}) JOIN per USING (measure) GROUP BY {keys}"""

    found = "round(a, 6) + 0.0" if level else "CAST(NULL AS DOUBLE)"
    return (
        SQL_COHORT.replace("WITH", "WITH RECURSIVE", 1) + ",\n" + _LONG + f""",
per AS MATERIALIZED (
  SELECT measure, subject_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(subject_day) AS DOUBLE) AS x, sum(value) AS y,
         CAST(sum(subject_day * subject_day) AS DOUBLE) AS xx, sum(subject_day * value) AS xy, sum(value * value) AS yy FROM long_rows GROUP BY 1, 2),
zero AS (SELECT DISTINCT measure, 0.0::DOUBLE AS lam FROM per),
at_zero AS ({slope("zero", "measure, lam")}),
halving AS (
  SELECT measure, 0 AS i, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi FROM zero
  UNION ALL
  SELECT measure, i + 1, CASE WHEN d < 0 THEN mid ELSE lo END, CASE WHEN d < 0 THEN hi ELSE mid END FROM (
    {slope("(SELECT *, (lo + hi) / 2 AS mid, exp((lo + hi) / 2) AS lam FROM halving WHERE i < 110)", "measure, i, lo, hi, mid, lam")})),
chosen AS (
  SELECT measure, CASE WHEN d < 0 THEN exp((lo + hi) / 2) ELSE 0.0 END AS lam FROM halving JOIN at_zero USING (measure) WHERE i = 110),
fitted AS ({fit("(SELECT * FROM chosen JOIN per USING (measure))", "measure, lam")}),
extra AS (SELECT measure, count(*) AS subjects, sum(ln(1 + lam * n)) AS spread FROM chosen JOIN per USING (measure) GROUP BY 1)
SELECT measure, CAST(nt AS BIGINT) AS n, subjects, round(b, 6) + 0.0 AS slope, round(sqrt(rss / nt / info), 6) AS std_error,
       round(b - 1.959963984540054 * sqrt(rss / nt / info), 6) + 0.0 AS lower, round(b + 1.959963984540054 * sqrt(rss / nt / info), 6) + 0.0 AS upper,
       {found} AS level, round(sqrt(lam * rss / nt), 6) AS sd_subject, round(sqrt(rss / nt), 6) AS sd_residual,
       round(nt * (ln(2 * pi() * rss / nt) + 1) + spread, 6) AS minus_2_loglik
FROM fitted JOIN extra USING (measure)"""
    )


_SUPPLIERS = """WITH RECURSIVE long_rows AS (
  SELECT 'g' || CAST(s_nationkey // 5 AS VARCHAR) AS variable, s_acctbal AS value, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS arm,
         CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal > 4500 THEN 'high' ELSE 'low' END AS balance FROM supplier)"""


def _rank_exact_sql():
    """Subsets of the ranks are counted by size and sum, one rank a step."""
    text = _rank_sql(_SUPPLIERS, "long_rows", "arm", "even", "odd", True)
    head = text[: text.index("SELECT variable, n1, n2, round(u, 6)")]
    z = "(u - n1 * n2 / 2.0 - sign(u - n1 * n2 / 2.0) * 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - tied / (n * (n - 1))))"
    return head.rstrip() + f""",
judged AS (SELECT *, greatest(n1, n2) < 50 AND tied = 0 AND least(n1, n2) > 0 AS small, CASE WHEN n1 > 0 AND n2 > 0 THEN {z} END AS z FROM stats),
subsets AS (
  SELECT 0 AS i, 0 AS s, 0 AS t, 1.0::DOUBLE AS ways
  UNION ALL
  SELECT i + 1, s + x, t + x * (i + 1), sum(ways) FROM subsets, (VALUES (0), (1)) AS c(x) WHERE i < (SELECT coalesce(max(n), 0) FROM judged WHERE small) GROUP BY 1, 2, 3),
exact AS (
  SELECT variable, least(1.0, 2 * sum(ways) FILTER (t - s * (s + 1) // 2 <= least(u, n1 * n2 - u)) / sum(ways)) AS p
  FROM judged JOIN subsets ON i = n AND s = n1 WHERE small GROUP BY 1)
SELECT variable, n1, n2, round(coalesce(u, 0), 6) AS u, round(z, 6) + 0.0 AS z, CASE WHEN small THEN 'exact' ELSE 'normal' END AS method,
       round(CASE WHEN small THEN e.p WHEN z IS NOT NULL THEN {normal_p("z")} END, 6) + 0.0 AS p
FROM judged LEFT JOIN exact e USING (variable)"""


# All tables with the margins, row by row; two columns at most.
_TABLES = _SUPPLIERS + f""",
cells AS (SELECT variable, nation, balance, CAST(count(*) AS DOUBLE) AS o FROM long_rows GROUP BY 1, 2, 3),
by_row AS (SELECT variable, nation, sum(o) AS r, coalesce(sum(o) FILTER (balance = 'high'), 0) AS h, row_number() OVER (PARTITION BY variable ORDER BY nation) AS i FROM cells GROUP BY 1, 2),
by_column AS (SELECT variable, balance, sum(o) AS k FROM cells GROUP BY 1, 2),
shape AS (
  SELECT variable, any_value(n) AS n, any_value(nl) AS nl, any_value(ng) AS ng, any_value(rm) * any_value(km) / any_value(n) AS min_expected,
         any_value(n) * (sum(o * o / (r * k)) - 1) AS chi
  FROM cells JOIN by_row USING (variable, nation) JOIN by_column USING (variable, balance)
  JOIN (SELECT variable, sum(r) AS n, count(*) AS nl, min(r) AS rm FROM by_row GROUP BY 1) USING (variable)
  JOIN (SELECT variable, count(*) AS ng, min(k) AS km FROM by_column GROUP BY 1) USING (variable) GROUP BY 1),
tables AS (
  SELECT variable, 0::BIGINT AS i, 0.0::DOUBLE AS s, 0.0::DOUBLE AS lf FROM shape WHERE min_expected < 5
  UNION ALL
  SELECT t.variable, t.i + 1, s + x, lf + lgamma(x + 1.0) + lgamma(r - x + 1.0)
  FROM tables t JOIN by_row b ON b.variable = t.variable AND b.i = t.i + 1, LATERAL (SELECT unnest(range(0, CAST(r AS BIGINT) + 1)) AS x)),
seen AS (SELECT variable, sum(h) AS k1, sum(lgamma(h + 1.0) + lgamma(r - h + 1.0)) AS lf0 FROM by_row GROUP BY 1),
exact AS (
  SELECT variable, sum(exp(lf0 - lf)) FILTER (lf >= lf0 - 1e-9) / sum(exp(lf0 - lf)) AS p
  FROM tables JOIN shape USING (variable) JOIN seen USING (variable) WHERE i = nl AND s = k1 GROUP BY 1)
SELECT variable, CAST(n AS BIGINT) AS n, (nl - 1) * (ng - 1) AS df, round(chi, 6) + 0.0 AS chi_square, round(min_expected, 6) AS min_expected,
       CASE WHEN min_expected >= 5 THEN 'chi_square' WHEN nl = 2 AND ng = 2 THEN 'fisher' ELSE 'exact' END AS test,
       round(CASE WHEN min_expected >= 5 THEN {chi_square_p("chi", "((nl - 1) * (ng - 1))")} ELSE least(1.0, p) END, 6) + 0.0 AS p
FROM shape LEFT JOIN exact USING (variable)"""

ORACLE = {
    "rank_sum_exact": _rank_exact_sql(),
    "contingency_exact": _TABLES,
    "random_intercept": _random_intercept_sql(False),
    "random_intercept_common_level": _random_intercept_sql(True),
    "first_event_rollup": sql_with(_ROLLUP, "SELECT * FROM rollup_rows"),
    "definition_prevalence": sql_with(_DEFINITIONS, "SELECT definition, occurred, count(*) AS subjects FROM definitions GROUP BY 1, 2"),
    "time_to_event_summary": sql_with(
        _DEFINITIONS,
        """
SELECT definition || ' (' || (SELECT count(*) FILTER (occurred) FROM definitions e WHERE e.definition = d.definition) || ' subjects)' AS definition,
       occurred, count(*) AS subjects, round(avg(days), 6) AS mean, round(stddev_samp(days), 6) AS sd, round(median(days), 6) AS median,
       round(quantile_cont(days, 0.75) - quantile_cont(days, 0.25), 6) AS iqr
FROM definitions d GROUP BY d.definition, occurred""",
    ),
    "frequency": "SELECT props, count(*) AS occurrences FROM events GROUP BY 1",
    "frequency_of_recoded_text": """
SELECT CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'pressing' ELSE o_orderpriority END AS o_orderpriority,
       count(*) AS orders FROM orders GROUP BY 1""",
    "same_day_concordance": sql_with(
        """
grown AS (SELECT subject_id, date, unnest(string_split(tokens, ' ')) AS organism FROM samples WHERE suspected)""",
        """
SELECT g.subject_id, strftime(g.date, '%Y-%m-%d') AS date, bool_or(organism = dominant_taxon) AS any_match
FROM grown g JOIN gappy d ON g.subject_id = d.subject_id AND g.date = d.date WHERE dominant_taxon IS NOT NULL GROUP BY g.subject_id, g.date""",
    ),
    "specimen_totals": sql_with(_LONG, "SELECT measure, count(*) AS specimens FROM long_rows GROUP BY 1"),
    "period_activity_weeks": _activity(fixed.WEEK_PERIODS),
    "period_activity_enrollment": _activity(fixed.ENROLLMENT_PERIODS),
    "box_summary": sql_with(
        _LONG + f",\nperiods AS (SELECT measure, {_case(fixed.ENROLLMENT_PERIODS, 'label')} AS period, value FROM long_rows),"
        + _box("periods", ["measure", "period"], "value").split("SELECT", 2)[0]
        + "SELECT" + _box("periods", ["measure", "period"], "value").split("SELECT", 2)[1],
        "SELECT" + _box("periods", ["measure", "period"], "value").split("SELECT", 2)[2],
    ),
    "box_summary_line_items": "WITH " + _box("lineitem", ["l_returnflag"], "l_extendedprice").strip(),
    "baseline_table": _baseline_with_p(),
    "rank_sum_statistics": _rank_sql(_RANK_LONG, "long_rows", "arm", "high", "low", True),
    "rank_sum_line_items": _rank_sql(
        "WITH long_rows AS (SELECT l_linestatus, 'l_quantity' AS variable, l_quantity AS value FROM lineitem"
        " UNION ALL SELECT l_linestatus, 'l_extendedprice', l_extendedprice FROM lineitem)",
        "long_rows", "l_linestatus", "F", "O", False,
    ),
    "rank_sum_test": _rank_test_sql(),
    "contingency_statistics": _SUBJECTS + _CHI,
    "contingency_test": _contingency_sql(),
    "correlate": sql_with(
        _KEPT + ",\npairs AS ("
        + " UNION ALL ".join(
            f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr({x}, {y}) AS r FROM kept WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
            for x, y in (("shannon", "log_abundance"), ("max_read_prop", "log_abundance"), ("shannon", "max_read_prop"))
        ) + ")",
        f"SELECT x, y, n, {_BOUNDS} FROM pairs",
    ),
    "correlate_by_stratum": sql_with(
        _KEPT + _PAIRS + ",\nstrata AS (SELECT dominant_taxon, count(*) AS n, corr(x, y) AS r FROM pairs GROUP BY 1)", _STRATA
    ),
    "correlate_by_stratum_table_means": sql_with(
        _KEPT + _PAIRS + """,
moved AS (SELECT dominant_taxon, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM pairs),
strata AS (SELECT dominant_taxon, count(*) AS n, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS r FROM moved GROUP BY 1)""",
        _STRATA,
    ),
    "subject_trend": sql_with(
        _LONG + """,
moved AS (
  SELECT measure, subject_id, CAST(subject_day AS DOUBLE) - avg(subject_day) OVER w AS x, value - avg(value) OVER w AS y
  FROM long_rows WINDOW w AS (PARTITION BY measure, subject_id)),
slopes AS (SELECT measure, count(*) AS n, count(DISTINCT subject_id) AS subjects, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM moved GROUP BY 1),
scores AS (SELECT measure, subject_id, sum(x * (y - b * x)) AS s FROM moved JOIN slopes USING (measure) GROUP BY 1, 2),
errors AS (SELECT measure, sqrt(sum(s * s)) AS root FROM scores GROUP BY 1)""",
        """
SELECT measure, n, subjects, round(b, 6) AS slope, round(root / xx, 6) AS std_error,
       round(b - 1.959963984540054 * root / xx, 6) AS lower, round(b + 1.959963984540054 * root / xx, 6) AS upper
FROM slopes JOIN errors USING (measure)""",
    ),
    "affine_fit": sql(
        """
SELECT count(max_read_prop) AS n, round(avg(max_read_prop), 6) AS intercept, round(stddev_samp(max_read_prop), 6) AS slope
FROM gappy WHERE date <= coalesce(first_confirmed, DATE '9999-01-01')"""
    ),
}
