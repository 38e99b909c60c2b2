"""Running computations over a subject's timeline without one task per subject.

A window partitioned by subject puts all rows of one subject into one task.  When one
subject holds a large part of the table that task never ends.  Here a timeline is cut
into blocks of consecutive days.  Row-level windows run inside a block, one aggregate per
block is scanned over the subject's (few) blocks, and the scanned state is joined back on
(subject, block).  The row side is shuffled once, by (subject, block): the join and the
row-level window share that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
DEFAULT_BLOCK_DAYS = 256


def as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def day_block(day: str | Column, width: int = DEFAULT_BLOCK_DAYS) -> Column:
    """Order-preserving block number of an integer day."""
    col = F.col(day) if isinstance(day, str) else day
    return F.floor(col / F.lit(width)).cast("long")


def date_block(date: str | Column, width: int = DEFAULT_BLOCK_DAYS) -> Column:
    """Order-preserving block number of a date; a null date falls into block 0."""
    col = F.col(date) if isinstance(date, str) else date
    return F.coalesce(day_block(F.unix_date(col), width), F.lit(0).cast("long"))


def in_block(subject: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of the block up to and including the current one."""
    return ordered_in_block(subject, order).rowsBetween(Window.unboundedPreceding, 0)


def ordered_in_block(subject: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*subject, BLOCK).orderBy(*order)


def earlier_blocks(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def all_blocks(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def attach_block_state(
    df: DataFrame,
    subject: Sequence[str],
    summary: dict[str, Column],
    state: Callable[[DataFrame, WindowSpec], DataFrame],
    keep: Sequence[str],
    block: Column | None = None,
) -> DataFrame:
    """Join per-block state, scanned along each subject's blocks, onto the rows of a block.

    ``summary`` aggregates the rows of one (subject, block); it is combined before the
    shuffle.  ``state`` receives the block table and the window over a subject's blocks in
    order, and adds the columns named in ``keep``.
    """
    keyed = df if block is None else df.withColumn(BLOCK, block)
    keys = [*subject, BLOCK]
    per_block = keyed.groupBy(*keys).agg(*[agg.alias(name) for name, agg in summary.items()])
    w = Window.partitionBy(*subject).orderBy(BLOCK)
    carried = state(per_block, w).select(*keys, *keep)
    return keyed.join(carried, keys, "left")


def attach_subject_value(
    df: DataFrame,
    subject: str | Sequence[str],
    block: Column,
    aggregates: dict[str, tuple[Column, Callable[[str], Column]]],
) -> DataFrame:
    """Give every row a per-subject aggregate.

    ``aggregates`` maps the new column to (aggregate of rows, aggregate of block results),
    for example ``{"last": (F.max("date"), F.max)}``.
    """
    subject = as_list(subject)

    def state(per_block: DataFrame, w: WindowSpec) -> DataFrame:
        whole = all_blocks(w)
        return per_block.withColumns({n: merge(n).over(whole) for n, (_, merge) in aggregates.items()})

    out = attach_block_state(
        df, subject, {n: agg for n, (agg, _) in aggregates.items()}, state, list(aggregates), block
    )
    return out.drop(BLOCK)
