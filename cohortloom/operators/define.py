"""Sample diversity and outcome definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import compare
from cohortloom.plans.joins import SALT


def diversity(
    counts: DataFrame, sample_keys: Sequence[str], taxon: str, n: str, dominated_above: float = 0.5
) -> DataFrame:
    """Shannon index (base e), largest share, dominant taxon and dominated flag per sample.

    Uses H = ln N - sum(n ln n) / N, so a sample needs plain sums only and every partial
    result is combined before the shuffle.  Ties for the dominant taxon go to the larger name.
    """
    per_taxon = counts.where(F.col(n) > 0).groupBy(*sample_keys, taxon).agg(F.sum(n).alias("_n"))
    size = F.col("_n").cast("double")
    sums = per_taxon.groupBy(*sample_keys).agg(
        F.sum(size).alias("_total"),
        F.sum(size * F.log(size)).alias("_nlogn"),
        F.max(F.struct(size.alias("n"), F.col(taxon).alias("taxon"))).alias("_top"),
    )
    share = F.col("_top.n") / F.col("_total")
    return sums.select(
        *sample_keys,
        (F.log("_total") - F.col("_nlogn") / F.col("_total")).alias("shannon"),
        share.alias("max_read_prop"),
        F.col("_top.taxon").alias("dominant_taxon"),
        (share > dominated_above).alias("dominated"),
    )


def within_hours(
    anchors: DataFrame,
    others: DataFrame,
    subject: str,
    ts: str,
    hours: float,
    out: str,
    salts: int = 16,
) -> DataFrame:
    """Flag anchors that have another event of the same subject at most ``hours`` away.

    Time is cut into buckets as wide as the window.  Any event in the anchor's own bucket
    is near enough; of the bucket before only the latest time matters, of the bucket after
    only the earliest.  So the other side shrinks to two times per bucket, and no pairs are formed.
    """
    width = int(hours * 3_600_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(micros / F.lit(width)).cast("long")
    per_bucket = (
        others.select(subject, micros.alias("_t"), bucket.alias("_b"))
        .groupBy(subject, "_b")
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    )
    near = (
        per_bucket.select(
            subject, "_lo", "_hi", F.col("_b").alias("_own"),
            F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"),
        )
        .groupBy(subject, "_b")
        .agg(
            F.bool_or(F.col("_own") == F.col("_b")).alias("_same"),
            F.max(F.when(F.col("_own") < F.col("_b"), F.col("_hi"))).alias("_before"),
            F.min(F.when(F.col("_own") > F.col("_b"), F.col("_lo"))).alias("_after"),
        )
    )
    # Anchors of one busy subject and bucket are spread over several tasks.
    left = anchors.withColumns(
        {
            "_t": micros,
            "_b": bucket,
            SALT: F.pmod(F.xxhash64(*anchors.columns), F.lit(salts)).cast("int"),
        }
    )
    right = near.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, [subject, "_b", SALT], "left")
    hit = (
        F.coalesce(F.col("_same"), F.lit(False))
        | F.coalesce(F.col("_t") - F.col("_before") <= width, F.lit(False))
        | F.coalesce(F.col("_after") - F.col("_t") <= width, F.lit(False))
    )
    return joined.select(*anchors.columns, hit.alias(out))


def define_outcome(
    cultures: DataFrame,
    treatments: DataFrame,
    subject: str,
    ts: str,
    growth: str,
    signs: str,
    window_hours: float = 48,
    names: Sequence[str] = (
        "suspected", "plus_pathogen", "plus_signs_and_pathogen", "plus_abx_and_pathogen_and_signs", "plus_abx_and_pathogen",
    ),
) -> DataFrame:
    """Outcome flags per subject and day.

    A culture order alone; with growth; with growth and signs; with these and a treatment
    change within ``window_hours`` of the culture, before or after; with growth and the change alone.
    """
    # Copies of a culture say nothing new, and would all be sent to one task.
    distinct = cultures.select(subject, ts, growth, signs).distinct()
    flagged = within_hours(distinct, treatments, subject, ts, window_hours, "_treated")
    grown, sick = F.coalesce(growth, F.lit(False)), F.coalesce(signs, F.lit(False))
    tests = [F.lit(True), grown, grown & sick, grown & sick & F.col("_treated"), grown & F.col("_treated")]
    return flagged.groupBy(subject, F.to_date(ts).alias("date")).agg(
        *[F.bool_or(test).alias(name) for test, name in zip(tests, names)]
    )


def case_window(df: DataFrame, date: str, first_date: str, flag: str, days_before: int = 1) -> DataFrame:
    """Set the flag on the first-event date and the given number of days before it."""
    d, first = F.col(date), F.col(first_date)
    return df.withColumn(flag, (d <= first) & (d >= F.date_sub(first, days_before)))


def dichotomise(df: DataFrame, col: str, op: str, threshold: float, out: str) -> DataFrame:
    """Strict threshold test as a boolean column; null stays null."""
    return df.withColumn(out, compare(col, op, threshold))
