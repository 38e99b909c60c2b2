"""Joins against small or skew-prone sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
ROW_BYTES = 64
SALT = "_salt"
#: A key is heavy if it holds more than this share of the left rows.
HEAVY_SHARE = 1 / 64


def salted_join(
    left: DataFrame, unique: DataFrame, keys: Sequence[str], salts: int = 32, how: str = "left"
) -> DataFrame:
    """Equi-join where a few keys may hold most of the left rows.

    Keys with more than ``HEAVY_SHARE`` of the left rows (fewer than its inverse, so they fit
    a broadcast) are found by one count.  Their rows are spread over ``salts`` tasks by a
    hash of the row, and only their right rows are repeated.  Equal rows share a salt: count
    copies into one row before the join where there can be many of them.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    heavy = counts.where(F.col("_n") > F.lit(HEAVY_SHARE) * total).select(*keys, F.lit(salts).alias("_salts"))
    few = F.coalesce("_salts", F.lit(1))
    spread = left.join(F.broadcast(heavy), list(keys), "left").withColumn(SALT, F.pmod(F.xxhash64(*left.columns), few).cast("int"))
    repeated = unique.join(F.broadcast(heavy), list(keys), "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), few - 1)))
    return spread.drop("_salts").join(repeated.drop("_salts"), [*keys, SALT], how).drop(SALT)


def fits_broadcast(row_bound: int | None, width: int = ROW_BYTES) -> bool:
    """Whether so many rows of so many bytes may be sent to every executor."""
    return row_bound is not None and row_bound * width <= BROADCAST_BYTES


def lookup_join(
    left: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    row_bound: int | None,
    how: str = "left",
    salts: int = 32,
    width: int = ROW_BYTES,
) -> DataFrame:
    """Join a right side that is unique by key: broadcast below a proven size, salted otherwise.

    ``row_bound`` is an upper bound the caller can prove (number of measures, of outcome
    definitions, of models), ``width`` the bytes of a row.  ``None`` means no bound is known.  The
    bound is a promise: where it may be wrong, count first (``counted_bound``).
    """
    if fits_broadcast(row_bound, width):
        return left.join(F.broadcast(unique), list(keys), how)
    return salted_join(left, unique, keys, salts, how)


def counted_bound(df: DataFrame, limit: int = BROADCAST_ROWS) -> int | None:
    """Row count of a materialised table when it is at most ``limit``, else ``None``."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None
