"""Definitions of outcomes and persistence of disruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import r6, rounded, sql, sql_with, text_date
from cohortloom.operators import define, persist, shape
from cohortloom.plans import event_cohort as ec
from cohortloom.plans.lineage import cut

DAY = ["subject_id", "subject_day"]
OUTCOMES = {name: (flag, first) for name, (flag, first, _) in ec.OUTCOMES.items()}
MEASURES = {m: (f"raw_{m}", m, op, cut) for m, (op, cut) in ec.MEASURES.items()}


def _gappy(spark, sf_dir):
    return ec.with_missing(ec.cohort(spark, sf_dir))


def event_rate_by_persistence(spark, sf_dir):
    rows = shape.censor_at_first(ec.cohort(spark, sf_dir), "subject_id", "date", "first_confirmed")
    rows = define.dichotomise(rows.select(*DAY, "shannon", "confirmed"), "shannon", "<", 0.6, "low")
    counted = persist.persistence_count(rows, "subject_id", "subject_day", "low", block_days=7)
    out = counted.groupBy("low_count").agg(
        F.count("*").alias("observations"), F.count_if("confirmed").alias("outcomes"),
        r6(F.avg(F.col("confirmed").cast("double"))).alias("event_rate"),
    )
    return out


def diversity(spark, sf_dir):
    out = define.diversity(ec.taxon_counts(spark, sf_dir), ["subject_id", "date"], "taxon", "n")
    return rounded(text_date(out, "date"), "shannon", "max_read_prop")


def define_outcome(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    cultures = events.where(F.col("event_type") == "error").withColumns(
        {"growth": F.col("value") >= 50, "signs": F.col("event_id") % 3 != 0}
    )
    treatments = events.where((F.col("event_type") == "purchase") & (F.col("value") >= 30))
    out = define.define_outcome(cultures, treatments, "user_id", "ts", "growth", "signs", 48)
    return text_date(out, "date")


def case_window(spark, sf_dir):
    rows = shape.censor_at_first(ec.cohort(spark, sf_dir), "subject_id", "date", "first_confirmed")
    out = define.case_window(rows, "date", "first_confirmed", "confirmed")
    return text_date(out.select(*DAY, "date", F.coalesce("confirmed", F.lit(False)).alias("confirmed")), "date")


def dichotomise(spark, sf_dir):
    df = _gappy(spark, sf_dir).select(*DAY, "shannon", "max_read_prop", "log_abundance")
    for measure, (op, cut) in ec.MEASURES.items():
        df = define.dichotomise(df, measure, op, cut, f"{measure}_disrupted")
    return df.select(*DAY, *[F.col(f"{m}_disrupted").cast("string").alias(f"{m}_disrupted") for m in ec.MEASURES])


def persistence_count(spark, sf_dir):
    df = _gappy(spark, sf_dir).select(*DAY, "max_read_prop").dropna()
    flagged = define.dichotomise(df, "max_read_prop", ">", 0.5, "high").select(*DAY, "high")
    return persist.persistence_count(flagged, "subject_id", "subject_day", "high", block_days=5, count="high_count")


def _set(spark, sf_dir, mode, dedup):
    gappy = _gappy(spark, sf_dir)
    cols = [*DAY, "date", "shannon", "suspected", "confirmed", "first_confirmed"]
    filled = gappy if mode == "none" else cut(ec.filled_calendar(gappy))
    out = persist.persistence_set(
        gappy.select(*cols), filled.select(*cols), "subject_id", "subject_day", "date",
        "confirmed", "first_confirmed", "shannon", "<", 0.6, mode, "suspected", dedup, block_days=7,
    )
    return rounded(out.select(*DAY, "shannon", "confirmed", "improved", "episode", "low_count"), "shannon")


def persistence_set_observed(spark, sf_dir):
    return _set(spark, sf_dir, "none", "before")


def persistence_set_event_day(spark, sf_dir):
    return _set(spark, sf_dir, "event_day", "before")


def persistence_set_event_day_counted_twice(spark, sf_dir):
    return _set(spark, sf_dir, "event_day", "after")


def persistence_set_full(spark, sf_dir):
    return _set(spark, sf_dir, "full", "before")


def grid_rows(spark, sf_dir, together=True, dedup="before"):
    return persist.persistence_grid(
        cut(ec.filled_calendar(_gappy(spark, sf_dir))), "subject_id", "subject_day", "date", "synthetic",
        OUTCOMES, MEASURES, "suspected", flags_missing_together=together, block_days=7, dedup=dedup,
    )


def _grid_counts(rows):
    return rows.groupBy("mode", "measure", "outcome", "low_count").agg(
        F.count("*").alias("observations"), F.count_if("event").alias("events")
    )


def persistence_grid(spark, sf_dir):
    """All 27 sets, collapsed to observations and events per count."""
    return _grid_counts(grid_rows(spark, sf_dir))


def persistence_grid_separate_flags(spark, sf_dir):
    """The same where each outcome flag may be missing on rows of its own."""
    return _grid_counts(grid_rows(spark, sf_dir, together=False))


def persistence_grid_counted_twice(spark, sf_dir):
    """All 27 sets where a measured event day counts as two rows, as in a union before ``distinct``."""
    return _grid_counts(grid_rows(spark, sf_dir, dedup="after"))


QUERIES = {
    "persistence_grid_counted_twice": persistence_grid_counted_twice,
    "event_rate_by_persistence": event_rate_by_persistence,
    "diversity": diversity,
    "define_outcome": define_outcome,
    "case_window": case_window,
    "dichotomise": dichotomise,
    "persistence_count": persistence_count,
    "persistence_set_observed": persistence_set_observed,
    "persistence_set_event_day": persistence_set_event_day,
    "persistence_set_event_day_counted_twice": persistence_set_event_day_counted_twice,
    "persistence_set_full": persistence_set_full,
    "persistence_grid": persistence_grid,
    "persistence_grid_separate_flags": persistence_grid_separate_flags,
}


def counted_ctes(source: str, partition: str = "subject_id", order: str = "subject_day") -> str:
    """CTE ``counted``: episode and count by lag and running sums over ``source`` with a boolean ``f``."""
    return f"""
lagged AS (
  SELECT *, coalesce(NOT f AND lag(f) OVER (PARTITION BY {partition} ORDER BY {order}), false) AS improved FROM {source}),
episodes AS (
  SELECT *, CAST(sum(CAST(improved AS INTEGER)) OVER (PARTITION BY {partition} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode
  FROM lagged),
counted AS (
  SELECT *, CAST(sum(CAST(f AS INTEGER)) OVER (PARTITION BY {partition}, episode ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS low_count
  FROM episodes)"""


def set_sql(rows: str, twice: bool = False) -> str:
    order = "subject_day, copy" if twice else "subject_day"
    distinct = "DISTINCT " if twice else ""
    return sql_with(
        f"base AS ({rows}), " + counted_ctes("base", order=order).strip(),
        f"SELECT {distinct}subject_id, subject_day, round(shannon, 6) AS shannon, confirmed, improved, episode, low_count FROM counted",
    )


_STOP = "date <= coalesce(first_confirmed, DATE '9999-01-01')"
_TWO = f"""
  SELECT subject_id, subject_day, shannon, confirmed, shannon < 0.6 AS f{{copy1}} FROM gappy WHERE {_STOP} AND shannon IS NOT NULL
  UNION {{all}} SELECT subject_id, subject_day, shannon, confirmed, shannon < 0.6{{copy2}} FROM filled WHERE {_STOP} AND shannon IS NOT NULL AND suspected"""


def _grid_sql(twice: bool = False) -> str:
    parts = []
    tests = {"shannon": "< 0.6", "max_read_prop": "> 0.5", "log_abundance": "> 2.0"}
    for m, test in tests.items():
        for o in OUTCOMES:
            keep = f"date <= coalesce(first_{o}, DATE '9999-01-01') AND {{v}} IS NOT NULL AND {o} IS NOT NULL"
            head = f"SELECT '{{mode}}' AS mode, '{m}' AS measure, '{o}' AS outcome, subject_id, subject_day, {o} AS event, {{v}} {test} AS f FROM filled"
            for mode, v, extra in (
                ("none", f"raw_{m}", " AND NOT synthetic"),
                ("full", m, ""),
            ):
                parts.append(f"{head} WHERE {keep}{extra}".format(mode=mode, v=v))
            both = f"{head} WHERE {keep} AND NOT synthetic".format(mode="event_day", v=f"raw_{m}")
            days = f"{head} WHERE {keep} AND suspected".format(mode="event_day", v=m)
            if twice:
                parts[-2:] = [p.replace(" FROM filled", ", 1 AS copy FROM filled") for p in parts[-2:]]
                parts += [p.replace(" FROM filled", f", {c} AS copy FROM filled") for c, p in ((1, both), (2, days))]
            else:
                parts.append(f"SELECT * FROM ({both} UNION {days})")
    order = "subject_day, copy" if twice else "subject_day"
    return sql_with(
        "base AS (" + "\nUNION ALL ".join(parts) + "), "
        + counted_ctes("base", "mode, measure, outcome, subject_id", order).strip()
        + ", kept AS (SELECT DISTINCT mode, measure, outcome, subject_id, subject_day, event, f, improved, episode, low_count FROM counted)",
        "SELECT mode, measure, outcome, low_count, count(*) AS observations, count(*) FILTER (event) AS events FROM kept GROUP BY 1, 2, 3, 4",
    )


ORACLE = {
    "event_rate_by_persistence": sql_with(
        f"base AS (SELECT *, shannon < 0.6 AS f FROM cohort WHERE {_STOP}), " + counted_ctes("base").strip(),
        """
SELECT low_count, count(*) AS observations, count(*) FILTER (confirmed) AS outcomes,
       round(avg(CAST(confirmed AS INTEGER)), 6) AS event_rate FROM counted GROUP BY 1""",
    ),
    "diversity": sql(
        """
SELECT subject_id, strftime(date, '%Y-%m-%d') AS date, round(-sum(p * ln(p)), 6) + 0.0 AS shannon, round(max(p), 6) AS max_read_prop,
       arg_max(taxon, (n, taxon)) AS dominant_taxon, max(p) > 0.5 AS dominated
FROM shares GROUP BY subject_id, date"""
    ),
    "define_outcome": """
WITH cultures AS (
  SELECT *, value >= 50 AS growth, event_id % 3 <> 0 AS signs FROM events WHERE event_type = 'error'),
treated AS (
  SELECT c.*, EXISTS (
    SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.value >= 30 AND p.user_id = c.user_id
    AND p.ts BETWEEN c.ts - INTERVAL 48 HOUR AND c.ts + INTERVAL 48 HOUR) AS hit
  FROM cultures c)
SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, true AS suspected, bool_or(growth) AS plus_pathogen,
       bool_or(growth AND signs) AS plus_signs_and_pathogen, bool_or(growth AND signs AND hit) AS plus_abx_and_pathogen_and_signs,
       bool_or(growth AND hit) AS plus_abx_and_pathogen
FROM treated GROUP BY 1, 2""",
    "case_window": sql(
        f"""
SELECT subject_id, subject_day, strftime(date, '%Y-%m-%d') AS date,
       coalesce(date BETWEEN first_confirmed - 1 AND first_confirmed, false) AS confirmed FROM cohort WHERE {_STOP}"""
    ),
    "dichotomise": sql(
        """
SELECT subject_id, subject_day, CAST(shannon < 0.6 AS VARCHAR) AS shannon_disrupted,
       CAST(max_read_prop > 0.5 AS VARCHAR) AS max_read_prop_disrupted, CAST(log_abundance > 2 AS VARCHAR) AS log_abundance_disrupted
FROM gappy"""
    ),
    "persistence_count": sql_with(
        "base AS (SELECT subject_id, subject_day, max_read_prop > 0.5 AS f FROM gappy WHERE max_read_prop IS NOT NULL), "
        + counted_ctes("base").strip(),
        "SELECT subject_id, subject_day, f AS high, improved, episode, low_count AS high_count FROM counted",
    ),
    "persistence_set_observed": set_sql(
        f"SELECT subject_id, subject_day, shannon, confirmed, shannon < 0.6 AS f FROM gappy WHERE {_STOP} AND shannon IS NOT NULL"
    ),
    "persistence_set_event_day": set_sql(_TWO.format(copy1="", copy2="", all="")),
    "persistence_set_event_day_counted_twice": set_sql(
        _TWO.format(copy1=", 1 AS copy", copy2=", 2", all="ALL"), twice=True
    ),
    "persistence_set_full": set_sql(
        f"SELECT subject_id, subject_day, shannon, confirmed, shannon < 0.6 AS f FROM filled WHERE {_STOP} AND shannon IS NOT NULL AND confirmed IS NOT NULL"
    ),
    "persistence_grid": _grid_sql(),
    "persistence_grid_counted_twice": _grid_sql(twice=True),
    "persistence_grid_separate_flags": _grid_sql(),
}
