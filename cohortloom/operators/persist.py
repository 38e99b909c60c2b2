"""Counting consecutive disrupted observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import compare
from cohortloom.operators.shape import analysis_set, censor_at_first, impute
from cohortloom.plans.blocks import (
    BLOCK,
    DEFAULT_BLOCK_DAYS,
    as_list,
    attach_block_state,
    day_block,
    earlier_blocks,
    in_block,
    ordered_in_block,
)


def persistence_count(
    df: DataFrame,
    subject: str | Sequence[str],
    day: str,
    flag: str,
    tie_break: Sequence[str] = (),
    block_days: int = DEFAULT_BLOCK_DAYS,
    count: str = "low_count",
    episode: str = "episode",
    improved: str = "improved",
) -> DataFrame:
    """Episode number and count of consecutive flagged observations, up to and including the row.

    A row improves when its flag is false and the flag of the row before is true.  It starts a new
    episode at count 0.  Observations are counted, not calendar days.  Rows without a
    flag or a day take no part and are dropped.  Rows of one day follow each other by
    ``tie_break`` and then by all their values, so only rows that are equal are exchangeable.
    """
    subject = as_list(subject)
    order = [day, *tie_break, *[c for c in df.columns if c not in (day, flag, *tie_break, *subject)], flag]
    on = F.col(flag).cast("boolean")
    rows = df.where(on.isNotNull() & F.col(day).isNotNull()).withColumn(BLOCK, day_block(day, block_days))
    upto = in_block(subject, order)
    rows = rows.withColumns(
        {
            "_pos": F.row_number().over(ordered_in_block(subject, order)),
            "_better": ~on & F.coalesce(F.lag(on).over(ordered_in_block(subject, order)), F.lit(False)),
        }
    )
    rows = rows.withColumns(
        {
            "_clear": F.max(F.when(~on, F.col("_pos"))).over(upto),
            "_betters": F.sum(F.col("_better").cast("int")).over(upto),
        }
    )
    summary = {
        "_size": F.max("_pos"),
        "_last_clear": F.max("_clear"),
        "_block_betters": F.max("_betters"),
        "_first_on": F.min_by(on, "_pos"),
        "_last_on": F.max_by(on, "_pos"),
    }

    def state(per_block, w):
        before = earlier_blocks(w)
        starts_better = ~F.col("_first_on") & F.coalesce(F.lag("_last_on").over(w), F.lit(False))
        per_block = per_block.withColumns(
            {
                "_starts_better": starts_better.cast("int"),
                "_rows_before": F.coalesce(F.sum("_size").over(before), F.lit(0)),
            }
        )
        clear_at = F.last(F.col("_rows_before") + F.col("_last_clear"), ignorenulls=True).over(before)
        betters = F.sum(F.col("_block_betters") + F.col("_starts_better")).over(before)
        return per_block.withColumns(
            {
                "_run_before": F.col("_rows_before") - F.coalesce(clear_at, F.lit(0)),
                "_betters_before": F.coalesce(betters, F.lit(0)),
            }
        )

    rows = attach_block_state(
        rows, subject, summary, state, ["_starts_better", "_run_before", "_betters_before"]
    )
    run = F.when(F.col("_clear").isNotNull(), F.col("_pos") - F.col("_clear")).otherwise(
        F.col("_run_before") + F.col("_pos")
    )
    return rows.select(
        *df.columns,
        F.when(F.col("_pos") == 1, F.col("_starts_better") == 1).otherwise(F.col("_better")).alias(improved),
        (F.col("_betters_before") + F.col("_starts_better") + F.col("_betters")).cast("long").alias(episode),
        run.cast("long").alias(count),
    )


def persistence_set(
    raw: DataFrame,
    filled: DataFrame,
    subject: str,
    day: str,
    date: str,
    outcome: str,
    first_date: str,
    measure: str,
    op: str,
    threshold: float,
    mode: str,
    broad_flag: str,
    dedup: str = "before",
    block_days: int = DEFAULT_BLOCK_DAYS,
) -> DataFrame:
    """One persistence analysis set: impute, censor, complete cases, dichotomise, count.

    ``dedup="before"`` removes repeated rows before counting.  ``dedup="after"`` counts
    first, so a measured event day appears twice, with two counts.
    """
    if dedup not in ("before", "after"):
        raise ValueError(f"unknown dedup {dedup!r}")
    rows = censor_at_first(impute(raw, filled, mode, broad_flag), subject, date, first_date)
    cols = [subject, day, measure, outcome]
    complete = analysis_set(rows, cols) if dedup == "before" else rows.select(*cols).dropna()
    flagged = complete.withColumn("disrupted", compare(measure, op, threshold))
    counted = persistence_count(flagged, subject, day, "disrupted", (measure,), block_days)
    return counted if dedup == "before" else counted.distinct()


def persistence_grid(
    calendar: DataFrame,
    subject: str,
    day: str,
    date: str,
    synthetic: str,
    outcomes: dict[str, tuple[str, str]],
    measures: dict[str, tuple[str, str, str, float]],
    broad_flag: str,
    modes: Sequence[str] = ("none", "event_day", "full"),
    flags_missing_together: bool = False,
    block_days: int = DEFAULT_BLOCK_DAYS,
    dedup: str = "before",
) -> DataFrame:
    """All persistence sets of outcomes x measures x imputation modes in one pass.

    ``calendar`` is the densified table with one row per subject and day.  ``outcomes``
    maps a name to (flag, first-event date); ``measures`` maps a name to (raw column,
    carried-forward column, comparison, threshold).

    The sets become columns of one table, so the rows are shuffled once for all of them.
    Imputing an event day means taking the carried value where the raw one is missing, which
    needs no union.  Sets turn into rows at the end, without a shuffle.

    ``flags_missing_together`` says that the outcome flags are null on the same rows; counts
    are then worked out once for all outcomes.

    ``dedup="after"`` counts an imputed event day that has a measurement too as the two rows it is in a union
    of both: the day has multiplicity two in all prefix counts.  As repeated rows go only where they are equal
    in flag, improvement and count, both rows stay on a disrupted day (with counts one apart) and on one
    that improves (both with count 0).
    """
    if dedup not in ("before", "after"):
        raise ValueError(f"unknown dedup {dedup!r}")
    observed = f"NOT `{synthetic}`"
    event_day = f"({observed} AND coalesce(`{broad_flag}`, false))"
    # Censoring keeps the first part of a timeline, and a count looks back only, so the count of a
    # kept row does not depend on the outcome.  Only missing outcome flags can make a difference.
    present = {o: "all" if flags_missing_together else o for o in outcomes}
    codes: dict[tuple[str, str, str], str] = {}
    # How many rows of the union a subject-day is, and the sets in which that may be two.
    weights: dict[tuple[str, str, str], str] = {}
    for mode in modes:
        for measure, (raw, carried, op, threshold) in measures.items():
            value = {
                "none": f"CASE WHEN {observed} THEN `{raw}` END",
                "event_day": f"CASE WHEN {observed} THEN coalesce(`{raw}`, CASE WHEN {event_day} THEN `{carried}` END) END",
                "full": f"`{carried}`",
            }[mode]
            for outcome, (flag, _) in outcomes.items():
                usable = f"`{date}` IS NOT NULL AND `{flag}` IS NOT NULL"
                # 1 = disrupted, 0 = not, null = the row takes no part.
                codes[mode, measure, present[outcome]] = (
                    f"CASE WHEN {usable} THEN CAST({value} {op} {threshold!r} AS TINYINT) END"
                )
                if dedup == "after" and mode == "event_day":
                    weights[mode, measure, present[outcome]] = f"CAST(IF({event_day} AND `{raw}` IS NOT NULL, 2, 1) AS TINYINT)"
    number = {key: i for i, key in enumerate(codes)}
    place = {outcome: i for i, outcome in enumerate(outcomes)}

    def text(name: str) -> str:
        return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"

    # Expressions are written as SQL text here: dozens of sets would otherwise mean
    # thousands of calls into the JVM while the plan is built.
    keys = f"`{subject}`", BLOCK
    upto = f"OVER (PARTITION BY {keys[0]}, {BLOCK} ORDER BY `{day}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    k = range(len(codes))
    # The codes are worked out before the shuffle: one small row per subject-day.
    events = [
        f"CASE WHEN `{date}` IS NOT NULL AND (`{first}` IS NULL OR `{date}` <= `{first}`) THEN `{flag}` END AS _event_{place[outcome]}"
        for outcome, (flag, first) in outcomes.items()
    ]
    twice = {number[key]: weight for key, weight in weights.items()}
    rows = calendar.withColumn(BLOCK, day_block(day, block_days)).selectExpr(
        *keys, f"`{day}`", *events, *[f"{code} AS _s{i}" for i, code in enumerate(codes.values())], *[f"{w} AS _m{i}" for i, w in twice.items()]
    )
    counted = {i: f"sum(CASE WHEN _s{i} IS NOT NULL THEN _m{i} END)" if i in twice else f"count(_s{i})" for i in k}
    rows = rows.selectExpr("*", *[f"CAST(coalesce({counted[i]} {upto}, 0) AS INT) AS _p{i}" for i in k])
    earlier = upto.replace("CURRENT ROW", "1 PRECEDING")
    rows = rows.selectExpr(
        "*", *[f"max(CASE WHEN _s{i} = 0 THEN _p{i} END) {upto} AS _z{i}" for i in k],
        *[f"max(CASE WHEN _s{i} = 0 THEN _p{i} END) {earlier} AS _y{i}" for i in twice],
    )
    summary = {
        "_sizes": F.expr("array(" + ", ".join(f"max(_p{i})" for i in k) + ")"),
        "_lasts": F.expr("array(" + ", ".join(f"max(_z{i})" for i in k) + ")"),
    }

    def state(per_block, w):
        before = f"OVER (PARTITION BY {keys[0]} ORDER BY {BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        per_block = per_block.selectExpr("*", *[f"coalesce(sum(_sizes[{i}]) {before}, 0) AS _b{i}" for i in k])
        runs = [f"_b{i} - coalesce(last(_b{i} + _lasts[{i}], true) {before}, 0)" for i in k]
        return per_block.selectExpr(*keys, f"array({', '.join(runs)}) AS _runs")

    rows = attach_block_state(rows, [subject], summary, state, ["_runs"])
    entries = []
    for mode in modes:
        for measure in measures:
            for outcome in outcomes:
                i = number[mode, measure, present[outcome]]
                named = f"named_struct('mode', {text(mode)}, 'measure', {text(measure)}, 'outcome', {text(outcome)}, 'event', _event_{place[outcome]}, 'low_count', "
                run = f"coalesce(_p{i} - _z{i}, _runs[{i}] + _p{i})"
                kept = f"_s{i} IS NOT NULL AND _event_{place[outcome]} IS NOT NULL"
                entries.append(f"CASE WHEN {kept} THEN {named} CAST({run} AS BIGINT)) END")
                if i in twice:
                    improves = f"_s{i} = 0 AND coalesce(_p{i} - 2 - _y{i}, _runs[{i}] + _p{i} - 2) > 0"
                    entries.append(f"CASE WHEN {kept} AND _m{i} = 2 AND (_s{i} = 1 OR {improves}) THEN {named} CAST(greatest({run} - 1, 0) AS BIGINT)) END")
    long = rows.selectExpr(keys[0], f"`{day}`", f"explode(array({', '.join(entries)})) AS _e")
    return long.where(F.col("_e").isNotNull()).select(subject, day, "_e.*")
