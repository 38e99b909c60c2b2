"""A cohort table built from a plain event log.

One subject per user, one sample per user and date.  The event types of a date play the
part of the taxa of a sample, and error events of growing size play the part of stricter
and stricter outcome definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.operators.shape import densify_calendar
from cohortloom.plans.lineage import cut

OUTCOMES = {
    "suspected": ("suspected", "first_suspected", 100.0),
    "confirmed": ("confirmed", "first_confirmed", 150.0),
    "strict": ("strict", "first_strict", 200.0),
}
MEASURES = {
    "shannon": ("<", 0.6),
    "max_read_prop": (">", 0.5),
    "log_abundance": (">", 2.0),
}


def taxon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, summed value and largest error per (subject, date, taxon)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.select(
            F.col("user_id").alias("subject_id"),
            F.to_date("ts").alias("date"),
            F.col("event_type").alias("taxon"),
            "value",
        )
        .groupBy("subject_id", "date", "taxon")
        .agg(
            F.count("*").alias("n"),
            F.sum("value").alias("amount"),
            F.max(F.when(F.col("taxon") == "error", F.col("value"))).alias("worst_error"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and date: diversity, abundance, tokens and outcome flags."""
    counts = taxon_counts(spark, sf_dir)
    size = F.col("n").cast("double")
    sums = counts.groupBy("subject_id", "date").agg(
        F.sum(size).alias("_total"),
        F.sum(size * F.log(size)).alias("_nlogn"),
        F.max(F.struct(size.alias("n"), F.col("taxon"))).alias("_top"),
        F.sum("amount").alias("_amount"),
        F.max("worst_error").alias("_worst"),
        F.array_join(F.array_sort(F.collect_set("taxon")), " ").alias("tokens"),
    )
    return sums.select(
        "subject_id",
        "date",
        F.round(F.log("_total") - F.col("_nlogn") / F.col("_total"), 9).alias("shannon"),
        F.round(F.col("_top.n") / F.col("_total"), 9).alias("max_read_prop"),
        F.round(F.log10("_amount"), 9).alias("log_abundance"),
        F.col("_top.taxon").alias("dominant_taxon"),
        "tokens",
        *[
            F.coalesce(F.col("_worst") >= cut, F.lit(False)).alias(flag)
            for flag, _, cut in OUTCOMES.values()
        ],
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the day since the subject's first date and the first date of each outcome.

    Samples hold one row per subject and date, so a subject has at most as many rows as the
    log has days and a plain window per subject is bounded.  The table is stored: operators
    that scan timelines read their input twice, and the log should be read once.
    """
    w = Window.partitionBy("subject_id")
    firsts = {first: F.min(F.when(F.col(flag), F.col("date"))).over(w) for flag, first, _ in OUTCOMES.values()}
    rows = samples(spark, sf_dir).withColumns({"_start": F.min("date").over(w), **firsts})
    return cut(rows.withColumn("subject_day", F.date_diff("date", "_start").cast("long")).drop("_start"))


def with_missing(df: DataFrame) -> DataFrame:
    """Take out measures by a fixed rule, as the source tables hold no nulls."""
    s, d = F.col("subject_id"), F.col("subject_day")
    keep_sequence = (s * 31 + d) % 7 != 0
    return df.withColumns(
        {
            "shannon": F.when(keep_sequence, F.col("shannon")),
            "max_read_prop": F.when(keep_sequence, F.col("max_read_prop")),
            "dominant_taxon": F.when(keep_sequence & (F.col("max_read_prop") > 0.5), F.col("dominant_taxon")),
            "log_abundance": F.when((s * 17 + d) % 11 != 0, F.col("log_abundance")),
        }
    )


def filled_calendar(df: DataFrame, block_days: int = 7) -> DataFrame:
    """Every day of every subject with measures carried forward, raw measures kept aside.

    Outcome flags stay null on added days; first dates hold for all rows of a subject.
    """
    firsts = [first for _, first, _ in OUTCOMES.values()]
    measures = [*MEASURES, "dominant_taxon"]
    kept = df.withColumns({f"raw_{m}": F.col(m) for m in MEASURES})
    return densify_calendar(
        kept, "subject_id", "subject_day", carry=[*measures, *firsts], date="date",
        block_days=block_days, synthetic="synthetic",
    )
