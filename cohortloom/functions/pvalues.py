"""Tail probabilities of test statistics, for small tables of aggregated results."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of chi-square: the regularised upper incomplete gamma function Q(df/2, x/2)."""
    if x <= 0 or df <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= y / k
            total += term
        return 1.0 - front * total
    # Continued fraction, evaluated from the front.
    b = y + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: total probability of tables no likelier than this one."""
    row, col, total = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - total), min(row, col)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(row - k) + np.log(col - k) - np.log(k + 1) - np.log(total - row - col + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(logp - logp.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


#: Partial tables that may be counted, and tables that are drawn where there are more.
MOST_PARTIAL, DRAWN = 200_000, 9_999


def _compositions(total: int, room: tuple[int, ...]):
    """All ways to split ``total`` over columns with so much room each."""
    if len(room) == 1:
        if total <= room[0]:
            yield (total,)
        return
    rest = sum(room[1:])
    for first in range(max(0, total - rest), min(total, room[0]) + 1):
        for others in _compositions(total - first, room[1:]):
            yield (first, *others)


def exact_table(table: np.ndarray) -> tuple[str, float]:
    """Total probability of the tables with the same margins that are no likelier than this one.

    A table's probability goes with one over the product of its cells' factorials, a whole number, so
    tables compare exactly.  Rows are taken in turn; partial tables that leave the same column sums and have the same product
    are counted together.  Where these are too many, tables are drawn with the margins instead.
    """
    table = table[:, table.sum(axis=0) > 0][table.sum(axis=1) > 0].astype(int)
    rows, columns = table.sum(axis=1).tolist(), table.sum(axis=0).tolist()
    if len(rows) < 2 or len(columns) < 2:
        return "exact", 1.0
    if len(columns) > len(rows):
        return exact_table(table.T)
    factorial = [math.factorial(i) for i in range(table.max(initial=0) + max(rows) + 1)]
    seen = math.prod(factorial[c] for c in table.ravel().tolist())
    partial = {tuple(columns): {1: 1}}
    for total in sorted(rows, reverse=True):
        following: dict[tuple[int, ...], dict[int, int]] = {}
        size = 0
        for room, products in partial.items():
            for part in _compositions(total, room):
                own = math.prod(factorial[c] for c in part)
                to = following.setdefault(tuple(r - c for r, c in zip(room, part)), {})
                before = len(to)
                for product, times in products.items():
                    to[product * own] = to.get(product * own, 0) + times
                size += len(to) - before
                if size > MOST_PARTIAL:
                    return "permutation", _drawn_p(rows, columns, seen, factorial)
        partial = following
    (products,) = partial.values()
    # Products are huge: shares are taken relative to the smallest.
    least = min(products)
    weights = {product: times * (least / product) for product, times in products.items()}
    return "exact", min(1.0, math.fsum(w for product, w in weights.items() if product >= seen) / math.fsum(weights.values()))


def _drawn_p(rows: list[int], columns: list[int], seen: int, factorial: list[int]) -> float:
    rng = np.random.default_rng([16, *rows, *columns])
    logs = np.array([math.lgamma(i + 1) for i in range(len(factorial))])
    at_least = 1
    limit = math.log(seen) - 1e-9
    left = np.tile(np.array(columns, np.int64), (DRAWN, 1))
    value = np.zeros(DRAWN)
    for total in rows:
        part = np.array([rng.multivariate_hypergeometric(c, total) for c in left])
        value += logs[part].sum(axis=1)
        left -= part
    return (at_least + int((value >= limit).sum())) / (DRAWN + 1)


@F.pandas_udf(T.StructType().add("test", "string").add("p", "double"))
def exact_table_p(cells: pd.Series) -> pd.DataFrame:
    found = []
    for entries in cells:
        table = np.zeros((max(e["r"] for e in entries), max(e["c"] for e in entries)))
        for e in entries:
            table[e["r"] - 1, e["c"] - 1] = e["o"]
        found.append(exact_table(table))
    return pd.DataFrame(found, columns=["test", "p"])


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) or pd.isna(f) else chi_square_tail(v, f) for v, f in zip(x, df)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = zip(a, b, c, d)
    return pd.Series(
        [None if any(pd.isna(x) for x in t) else fisher_two_sided(*(int(x) for x in t)) for t in cells],
        dtype="float64",
    )


# Workers get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
