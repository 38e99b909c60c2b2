"""Row-level column expressions.  All run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(_col(c)), _col(c))


def matches(c: str | Column, pattern: str) -> Column:
    """Regex test that is false, not null, on a missing string."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def recode(c: str | Column, rules: Sequence[tuple[str, str]], null_label: str | None = None) -> Column:
    """Replace the whole string by a label where a pattern is found.

    Rules apply one after the other, each to the result of the one before.
    """
    out = _col(c) if null_label is None else F.coalesce(_col(c), F.lit(null_label))
    for pattern, label in rules:
        out = F.when(matches(out, pattern), F.lit(label)).otherwise(out)
    return out


def value_label(c: str | Column, labels: dict[str, str], otherwise: Column | None = None) -> Column:
    """Look a code up in a label map; a code outside the map gives null or ``otherwise``."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(table, _col(c))
    return found if otherwise is None else F.coalesce(found, otherwise)


def compare(c: str | Column, op: str, threshold: float | Column) -> Column:
    """Strict or inclusive threshold test; null stays null."""
    value, limit = _col(c), threshold if isinstance(threshold, Column) else F.lit(threshold)
    tests = {"<": value < limit, ">": value > limit, "<=": value <= limit, ">=": value >= limit}
    return tests[op]


def significant(c: str | Column, digits: int) -> Column:
    """Round to a number of significant digits; zero stays zero."""
    x = _col(c).cast("double")
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), F.greatest(places, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-places, F.lit(0)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * up / down) / up * down)


def log10_of(c: str | Column, zero: str = "-inf") -> Column:
    """Base-10 logarithm.  ``zero="-inf"`` keeps minus infinity for zero, ``"null"`` drops it."""
    x = _col(c)
    if zero == "null":
        return F.log10(x)
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def period_of(day: str | Column, periods: Sequence[tuple[str, int, int | None]]) -> Column:
    """Label of the period a day falls into; null outside all periods."""
    return _by_period(day, periods, [label for label, _, _ in periods])


def period_rank(day: str | Column, periods: Sequence[tuple[str, int, int | None]]) -> Column:
    """1-based position of the period, for ordering."""
    return _by_period(day, periods, list(range(1, len(periods) + 1)))


def _by_period(day: str | Column, periods: Sequence[tuple], values: Sequence) -> Column:
    d, out = _col(day), F.lit(None)
    for (_, lower, upper), value in reversed(list(zip(periods, values))):
        inside = d >= lower if upper is None else (d >= lower) & (d < upper)
        out = F.when(inside, F.lit(value)).otherwise(out)
    return out


def inverse_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def unit_hash(seed: int, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the column values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal_hash(seed: int, *cols: str | Column) -> Column:
    """Standard normal number that depends only on the seed and the column values."""
    first, second = unit_hash(seed, *cols, F.lit("a")), unit_hash(seed, *cols, F.lit("b"))
    half = F.lit(0.5 / 4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.ln(first + half)) * F.cos(F.lit(2.0 * math.pi) * second)


def poisson_one_cuts() -> list[float]:
    """Cumulative probabilities of Poisson(1), up to the resolution of ``unit_hash``."""
    cuts, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        if total >= 1.0 - 2.0**-32:
            return cuts
        cuts.append(total)
        k += 1
        term /= k


def poisson_one(uniform: Column) -> Column:
    """Poisson(1) count of a uniform number, by inversion."""
    out = F.lit(0)
    for cut in poisson_one_cuts():
        out = out + (uniform >= F.lit(cut)).cast("int")
    return out
