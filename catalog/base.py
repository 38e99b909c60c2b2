"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: str | Column) -> Column:
    """Round to six decimals; adding zero turns minus zero into zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def text_date(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


# The cohort in SQL.  Shannon is written as its definition, -sum(p ln p).
SQL_SAMPLES = """
taxa AS (
  SELECT user_id AS subject_id, CAST(ts AS DATE) AS date, event_type AS taxon,
         CAST(count(*) AS DOUBLE) AS n, sum(value) AS amount,
         max(CASE WHEN event_type = 'error' THEN value END) AS worst
  FROM events GROUP BY 1, 2, 3),
shares AS (
  SELECT *, n / sum(n) OVER (PARTITION BY subject_id, date) AS p FROM taxa),
samples AS (
  SELECT subject_id, date,
         round(-sum(p * ln(p)), 9) + 0.0 AS shannon, round(max(p), 9) AS max_read_prop,
         round(log10(sum(amount)), 9) AS log_abundance,
         arg_max(taxon, (n, taxon)) AS dominant_taxon,
         string_agg(taxon, ' ' ORDER BY taxon) AS tokens,
         coalesce(max(worst) >= 100, false) AS suspected,
         coalesce(max(worst) >= 150, false) AS confirmed,
         coalesce(max(worst) >= 200, false) AS strict
  FROM shares GROUP BY 1, 2)"""

SQL_COHORT = (
    "WITH "
    + SQL_SAMPLES
    + """,
cohort AS (
  SELECT s.*, CAST(date_diff('day', min(date) OVER w, date) AS BIGINT) AS subject_day,
         min(CASE WHEN suspected THEN date END) OVER w AS first_suspected,
         min(CASE WHEN confirmed THEN date END) OVER w AS first_confirmed,
         min(CASE WHEN strict THEN date END) OVER w AS first_strict
  FROM samples s WINDOW w AS (PARTITION BY subject_id)),
gappy AS (
  SELECT * REPLACE (
    CASE WHEN (subject_id * 31 + subject_day) % 7 <> 0 THEN shannon END AS shannon,
    CASE WHEN (subject_id * 31 + subject_day) % 7 <> 0 THEN max_read_prop END AS max_read_prop,
    CASE WHEN (subject_id * 31 + subject_day) % 7 <> 0 AND max_read_prop > 0.5 THEN dominant_taxon END AS dominant_taxon,
    CASE WHEN (subject_id * 17 + subject_day) % 11 <> 0 THEN log_abundance END AS log_abundance)
  FROM cohort),
span AS (
  SELECT subject_id, min(subject_day) AS lo, max(subject_day) AS hi,
         min(date) AS start, min(first_suspected) AS first_suspected,
         min(first_confirmed) AS first_confirmed, min(first_strict) AS first_strict
  FROM gappy GROUP BY 1),
calendar AS (
  SELECT subject_id, unnest(range(lo, hi + 1)) AS subject_day, start, first_suspected, first_confirmed, first_strict
  FROM span),
filled AS (
  SELECT c.subject_id, c.subject_day, CAST(c.start + CAST(c.subject_day AS INTEGER) AS DATE) AS date,
         last_value(g.shannon IGNORE NULLS) OVER w AS shannon,
         last_value(g.max_read_prop IGNORE NULLS) OVER w AS max_read_prop,
         last_value(g.log_abundance IGNORE NULLS) OVER w AS log_abundance,
         last_value(g.dominant_taxon IGNORE NULLS) OVER w AS dominant_taxon,
         g.shannon AS raw_shannon, g.max_read_prop AS raw_max_read_prop, g.log_abundance AS raw_log_abundance,
         g.suspected, g.confirmed, g.strict,
         c.first_suspected, c.first_confirmed, c.first_strict,
         g.subject_id IS NULL AS synthetic
  FROM calendar c LEFT JOIN gappy g ON c.subject_id = g.subject_id AND c.subject_day = g.subject_day
  WINDOW w AS (PARTITION BY c.subject_id ORDER BY c.subject_day ROWS UNBOUNDED PRECEDING))"""
)


def sql(body: str) -> str:
    """A query over ``cohort``, ``gappy`` and ``filled``."""
    return SQL_COHORT + "\n" + body.strip()


def sql_with(ctes: str, body: str) -> str:
    return SQL_COHORT + ",\n" + ctes.strip() + "\n" + body.strip()
