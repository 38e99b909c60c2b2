"""Pieces that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

RANK_BLOCKS = 4096

#: Stands for a null key, after all others.
LAST_KEY = (1 << 63) - 1


def word_array(text: Column) -> Column:
    """Maximal runs of non-blanks; an empty array for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str,
    blocks: int = RANK_BLOCKS,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order that ``order`` decides.

    A group is cut into ``blocks`` by a hash of ``order``.  Blocks are counted, the counts are
    summed up along each group (at most ``blocks`` rows of it) and rows are numbered inside
    their block, so a group that holds most rows is spread over many tasks.  ``df`` is read
    twice; store what is costly.  ``per_group`` (unique by ``group``) adds its columns.
    Group columns must not be null.
    """
    group = list(group)
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if per_group is not None:
        starts = starts.join(per_group, group)
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    numbered = rows.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.join(starts, [*group, "_block"])
        .withColumn(out, F.col("_start") + F.col("_place") - F.lit(1).cast("long"))
        .drop("_block", "_start", "_place")
    )


def on_worker(name: str, make):
    """An object that is made once in a Python worker and kept until another one is asked for.

    Functions shipped by value get new globals with every task; this outlives them.  A worker
    holds one such object only, as it goes on to other operators and other runs.
    """
    kept = sys.modules.setdefault("_kept_on_worker", types.ModuleType("_kept_on_worker"))
    if getattr(kept, "name", None) != name:
        kept.name = kept.what = None
        kept.what, kept.name = make(), name
    return kept.what


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on after a task, beside the executor's heap."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go() -> None:
    """Drop what ``on_worker`` keeps.  For operators that keep nothing and need the room."""
    kept = sys.modules.get("_kept_on_worker")
    if kept is not None and getattr(kept, "name", None) is not None:
        kept.name = kept.what = None
        give_back()
