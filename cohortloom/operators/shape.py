"""Cleaning and shaping a table of repeated measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import matches, nan_to_null, recode, significant, value_label
from cohortloom.plans.blocks import (
    DEFAULT_BLOCK_DAYS,
    as_list,
    attach_block_state,
    attach_subject_value,
    date_block,
    day_block,
    earlier_blocks,
    in_block,
    ordered_in_block,
)
from cohortloom.plans.joins import lookup_join
from cohortloom.plans.ranking import exact_quantiles

GAP_CHUNK = 4096


def baseline_enrich(
    subjects: DataFrame,
    measurements: DataFrame,
    subject: str,
    day: str,
    value: str,
    prior: DataFrame | None = None,
    prior_text: str | None = None,
    pattern: str | None = None,
    flag_name: str = "prior_pattern_noted",
) -> DataFrame:
    """Add each subject's day-0 value, its position against the cohort median, and prior history.

    A subject with two different day-0 values appears twice, as a left join would have it.
    ``<value>_above_median`` is strict and stays null without a value.
    """
    name = f"admission_{value}"
    day0 = measurements.where(F.col(day) == 0).select(subject, F.col(value).alias(name)).distinct()
    out = subjects.join(day0, subject, "left")
    median = exact_quantiles(out, [], name, {"median": 0.5}).select("median")
    out = out.withColumn(f"{name}_above_median", F.col(name) > median.scalar())
    if prior is not None:
        out = out.join(prior, subject, "left")
    if pattern is not None:
        out = out.withColumn(flag_name, matches(prior_text, pattern))
    return out


def locf(
    df: DataFrame,
    subject: str | Sequence[str],
    day: str,
    cols: Sequence[str],
    tie_break: Sequence[str] = (),
    block_days: int = DEFAULT_BLOCK_DAYS,
) -> DataFrame:
    """Carry the last non-null value forward within a subject; leading nulls stay."""
    subject = as_list(subject)
    return _with_carry(df, subject, day, list(cols), list(tie_break), block_days).select(*df.columns)


def _with_carry(
    df: DataFrame, subject: list[str], day: str, cols: list[str], tie_break: list[str], block_days: int
) -> DataFrame:
    order = [day, *tie_break]
    position = F.col(day) if len(order) == 1 else F.struct(*order)
    summary = {f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), position)) for c in cols}
    summary["_first_day"] = F.min(day)

    def state(per_block, w):
        before = earlier_blocks(w)
        carry = {f"_carry_{c}": F.last(f"_last_{c}", ignorenulls=True).over(before) for c in cols}
        return per_block.withColumns({**carry, "_next_first": F.lead("_first_day").over(w)})

    keep = [f"_carry_{c}" for c in cols] + ["_next_first"]
    rows = attach_block_state(df, subject, summary, state, keep, day_block(day, block_days))
    w = in_block(subject, order)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_carry_{c}")) for c in cols}
    return rows.withColumns(filled) if filled else rows


def densify_calendar(
    df: DataFrame,
    subject: str | Sequence[str],
    day: str,
    carry: Sequence[str] = (),
    date: str | None = None,
    tie_break: Sequence[str] = (),
    block_days: int = DEFAULT_BLOCK_DAYS,
    synthetic: str | None = None,
) -> DataFrame:
    """One row for every integer day between a subject's first and last day.

    Added days hold null outside the key; ``carry`` columns are filled forward on all rows,
    ``date`` is counted on from the last present day.  The days to add follow from the
    distance to the subject's next row, so no calendar is joined.
    """
    subject = as_list(subject)
    rows = _with_carry(df, subject, day, list(carry), list(tie_break), block_days)
    next_day = F.coalesce(
        F.lead(day).over(ordered_in_block(subject, [day, *tie_break])), F.col("_next_first")
    )
    rows = rows.withColumn("_emit", F.greatest(F.coalesce(next_day - F.col(day), F.lit(1)), F.lit(1)))
    # Two steps keep the exploded arrays short when a gap is very long.
    chunks = rows.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), ((F.col("_emit") - 1) / GAP_CHUNK).cast("int")))
    )
    start = F.col("_chunk") * GAP_CHUNK
    days = chunks.withColumn(
        "_offset",
        F.explode(F.sequence(start, F.least(start + (GAP_CHUNK - 1), F.col("_emit").cast("int") - 1))),
    )
    added = F.col("_offset") > 0
    out = []
    for c in df.columns:
        if c in subject or c in carry:
            out.append(F.col(c))
        elif c == day:
            out.append((F.col(day) + F.col("_offset")).cast(df.schema[day].dataType).alias(day))
        elif c == date:
            out.append(F.date_add(date, F.col("_offset")).alias(date))
        else:
            out.append(F.when(~added, F.col(c)).alias(c))
    if synthetic:
        out.append(added.alias(synthetic))
    return days.select(*out)


def normalise_missing(
    df: DataFrame,
    subject: str,
    day: str,
    flags: Sequence[str] = (),
    static: Sequence[str] = (),
    nan_columns: Sequence[str] = (),
    block_days: int = DEFAULT_BLOCK_DAYS,
) -> DataFrame:
    """NaN to null; flags default to false; per-subject constants spread to all rows.

    Leave ``flags`` and ``static`` empty to change NaN only.
    """
    out = df
    if nan_columns:
        out = out.withColumns({c: nan_to_null(c) for c in nan_columns})
    if flags:
        out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    if static:
        spread = {f"_all_{c}": (F.max(c), F.max) for c in static}
        out = attach_subject_value(out, subject, day_block(day, block_days), spread)
        out = out.withColumns({c: F.coalesce(c, f"_all_{c}") for c in static}).select(*df.columns)
    return out


def censor_at_first(
    df: DataFrame,
    subject: str,
    date: str,
    first_date: str,
    mode: str = "until",
    null_policy: str = "ignore",
    block_days: int = DEFAULT_BLOCK_DAYS,
) -> DataFrame:
    """Keep rows up to and including the first event, or (``mode="event_day"``) only that day.

    Without an event the limit is the subject's last date.  ``null_policy="propagate"`` makes
    that fallback null, and so drops the subject, when any of its dates is null.

    With the default options the fallback can never exclude a dated row, so the condition
    is a plain filter and needs no shuffle.
    """
    if mode not in ("until", "event_day"):
        raise ValueError(f"unknown mode {mode!r}")
    if null_policy not in ("ignore", "propagate"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    d, first = F.col(date), F.col(first_date)
    if mode == "until" and null_policy == "ignore":
        return df.where(d.isNotNull() & (first.isNull() | (d <= first)))
    state = {"_last_date": (F.max(date), F.max), "_undated": (F.max(d.isNull()), F.max)}
    rows = attach_subject_value(df, subject, date_block(date, block_days), state)
    fallback = F.col("_last_date")
    if null_policy == "propagate":
        fallback = F.when(~F.col("_undated"), fallback)
    limit = F.coalesce(first, fallback)
    kept = rows.where(d <= limit if mode == "until" else d == limit)
    return kept.select(*df.columns)


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled", by: str | None = None, levels: int | None = None) -> DataFrame:
    """Standardise columns over the whole table, or inside each value of ``by``; a constant column gives null.

    Means and deviations come from one aggregate.  Without ``by`` it is read as a scalar; with it, it is
    joined, and ``levels`` is the number of values that the caller can prove.  A null ``by`` is a value.
    """
    moments = [*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]]
    if by is None:
        rows = df.withColumn("_stats", df.agg(F.struct(*moments).alias("s")).scalar())
    else:
        key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
        stats = df.groupBy(key.alias("_by")).agg(F.struct(*moments).alias("_stats"))
        rows = lookup_join(df.withColumn("_by", key), stats, ["_by"], levels, "inner", width=16 * len(cols) + 64).drop("_by")
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col("_stats")[f"m_{c}"]) / F.nullif(F.col("_stats")[f"s_{c}"], F.lit(0.0))
        for c in cols
    }
    return rows.withColumns(scaled).drop("_stats")


def analysis_set(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project, drop incomplete rows, keep distinct rows."""
    return df.select(*cols).dropna().distinct()


def impute(
    raw: DataFrame, filled: DataFrame | None, mode: str, broad_flag: str | None = None, dedup: bool = False
) -> DataFrame:
    """Rows to analyse: ``none`` = raw, ``full`` = the filled calendar, ``event_day`` = raw rows
    plus filled rows of event days under the broadest definition.

    The plain union repeats an event-day row that was measured; ``dedup`` drops such copies.
    """
    if mode == "none":
        return raw
    if mode == "full":
        return filled
    if mode != "event_day":
        raise ValueError(f"unknown mode {mode!r}")
    both = raw.unionByName(filled.where(F.col(broad_flag)), allowMissingColumns=True)
    return both.distinct() if dedup else both


def imputation_share(total: DataFrame, observed: DataFrame, digits: int = 1) -> DataFrame:
    """Row counts with and without imputation, and the percentage of rows added."""
    n_total = total.agg(F.count("*").alias("n_total"))
    n_observed = observed.agg(F.count("*").alias("n"))
    return n_total.withColumn("n_observed", n_observed.scalar()).withColumn(
        "share",
        F.round(F.lit(100.0) * (F.col("n_total") - F.col("n_observed")) / F.nullif("n_total", F.lit(0)), digits),
    )


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    key: str = "measure",
    value: str = "value",
    drop_null: bool = True,
    value_type: str = "double",
) -> DataFrame:
    """Wide to long.  Columns are cast to one type first."""
    cast = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols])
    long = cast.unpivot(list(ids), list(cols), key, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def explode_tokens(
    df: DataFrame,
    col: str,
    out: str,
    sep: str = " ",
    max_parts: int | None = None,
    title_case: bool = True,
    rules: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """One row per token of a multi-valued string, or per token of the first ``max_parts`` where that is asked for."""
    tokens = F.split(F.col(col), rf"\Q{sep}\E")
    if max_parts is not None:
        tokens = F.slice(tokens, 1, max_parts)
    label = F.initcap("_token") if title_case else F.col("_token")
    for pattern, replacement in rules:
        label = F.regexp_replace(label, pattern, replacement)
    return (
        df.withColumn("_token", F.explode(tokens))
        .withColumn(out, label)
        .drop("_token", *([] if out == col else [col]))
    )


def recode_by_pattern(
    df: DataFrame, col: str, rules: Sequence[tuple[str, str]], default_for_null: str | None = None, out: str | None = None
) -> DataFrame:
    """Ordered regex-to-label rules on a string column, with a label for null."""
    return df.withColumn(out or col, recode(col, rules, default_for_null))


def label_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns for an output table."""
    return df.withColumnsRenamed(mapping)


def label_values(df: DataFrame, col: str, labels: dict[str, str], otherwise: Column | None = None, out: str | None = None) -> DataFrame:
    """Replace codes by labels; a code without a label gives null or ``otherwise``."""
    return df.withColumn(out or col, value_label(col, labels, otherwise))


def signif(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """Round columns to significant digits."""
    return df.withColumns({c: significant(c, digits) for c in cols})


__all__ = [
    "analysis_set",
    "baseline_enrich",
    "censor_at_first",
    "densify_calendar",
    "explode_tokens",
    "imputation_share",
    "impute",
    "label_columns",
    "label_values",
    "locf",
    "normalise_missing",
    "recode_by_pattern",
    "signif",
    "to_long",
    "zscore",
]
