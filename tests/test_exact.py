"""Exact tests of small groups against enumeration, and event days that count twice."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import persist_queries
from cohortloom.functions import pvalues
from cohortloom.operators import describe


def rank_p(first, second):
    """Share of arrangements whose statistic is as far out, both tails by doubling."""
    values = first + second
    u = sum(a > b for a in first for b in second)
    tail = min(u, len(first) * len(second) - u)
    every = [sum(values[i] > values[j] for i in c for j in range(len(values)) if j not in c) for c in itertools.combinations(range(len(values)), len(first))]
    return min(1.0, 2 * sum(x <= tail for x in every) / len(every))


def test_rank_sums_equal_enumeration(spark):
    rng = np.random.default_rng(2)
    sets = {f"v{a}{b}": (rng.normal(size=a).tolist(), (rng.normal(size=b) + 0.8).tolist()) for a, b in [(1, 1), (2, 3), (4, 4), (5, 7), (7, 3), (1, 6)]}
    rows = [(v, g, x) for v, pair in sets.items() for g, values in zip("ab", pair) for x in values]
    rows += [("ties", "a", 1.0), ("ties", "a", 2.0), ("ties", "b", 2.0), ("ties", "b", 5.0), ("alone", "a", 1.0), ("sets", "c", 9.0), ("null", "a", None)]
    df = spark.createDataFrame(rows, "v string, g string, x double")
    got = {r["v"]: r for r in describe.rank_sum_exact(df, "v", "x", "g", "a", "b", 12).collect()}
    for v, (first, second) in sets.items():
        assert got[v]["method"] == "exact" and abs(got[v]["p"] - rank_p(first, second)) < 1e-12
    assert got["ties"]["method"] == "normal" and got["alone"]["p"] is None
    plain = {r["v"]: r["p"] for r in describe.rank_sum_test(df, "v", "x", "g", "a", "b", 12).collect()}
    assert got["ties"]["p"] == plain["ties"]
    by_size = {r["v"]: r["method"] for r in describe.rank_sum_exact(df, "v", "x", "g", "a", "b", 12, exact_below=5).collect()}
    assert by_size["v44"] == "exact" and by_size["v57"] == "normal"


def test_largest_exact_groups_are_near_the_normal_value(spark):
    rng = np.random.default_rng(4)
    rows = [("v", g, float(x)) for g, shift in (("a", 0.0), ("b", 0.4)) for x in rng.normal(size=49) + shift]
    r = describe.rank_sum_exact(spark.createDataFrame(rows, "v string, g string, x double"), "v", "x", "g", "a", "b", 1).first()
    assert r["method"] == "exact" and abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 2e-3


def all_tables(rows, columns):
    if len(rows) == 1:
        yield [list(columns)]
        return
    for part in pvalues._compositions(rows[0], tuple(columns)):
        for rest in all_tables(rows[1:], [c - p for c, p in zip(columns, part)]):
            yield [list(part), *rest]


@pytest.mark.parametrize("table", [[[3, 1], [0, 4], [2, 2]], [[1, 2, 3], [4, 0, 1]], [[2, 1, 1], [0, 3, 1], [1, 1, 2]], [[5, 0], [0, 5], [1, 1], [2, 0], [0, 3]], [[1, 0], [0, 1]], [[4, 3]]])
def test_tables_equal_enumeration(table):
    def weight(t):
        return math.prod(math.factorial(c) for row in t for c in row)

    every = list(all_tables([sum(r) for r in table], [sum(c) for c in zip(*table)]))
    p = sum(1 / weight(t) for t in every if weight(t) >= weight(table)) / sum(1 / weight(t) for t in every)
    test, found = pvalues.exact_table(np.array(table))
    assert test == "exact" and abs(found - p) < 1e-12


def test_tables_beyond_the_limit_are_drawn(monkeypatch):
    table = np.array([[6, 1, 3], [2, 7, 1], [1, 2, 8]])
    exact = pvalues.exact_table(table)[1]
    monkeypatch.setattr(pvalues, "MOST_PARTIAL", 5)
    test, p = pvalues.exact_table(table)
    assert test == "permutation" and abs(p - exact) < 4 * math.sqrt(exact / pvalues.DRAWN) + 2 / pvalues.DRAWN
    assert pvalues.exact_table(table) == (test, p)


def test_tables_of_rows(spark):
    rows = [("small", f"l{i}", g) for i, (a, b) in enumerate([(3, 1), (0, 4), (2, 2)]) for g, n in (("x", a), ("y", b)) for _ in range(n)]
    rows += [("two", l, g) for l, g in (("p", "x"), ("p", "y"), ("q", "y"))] + [("wide", f"l{i}", "xy"[i % 2]) for i in range(70)]
    rows += [("large", f"l{i % 3}", "xy"[(i // 3) % 2]) for i in range(300)] + [("none", None, "x")]
    df = spark.createDataFrame(rows, "v string, l string, g string")
    got = {r["v"]: r for r in describe.contingency_exact(df, "v", "l", "g").collect()}
    assert {v: r["test"] for v, r in got.items()} == {"small": "exact", "two": "fisher", "wide": "chi_square_small_expected", "large": "chi_square"}
    assert abs(got["small"]["p"] - pvalues.exact_table(np.array([[3, 1], [0, 4], [2, 2]]))[1]) < 1e-12


@pytest.mark.parametrize("together", [True, False])
def test_grid_that_counts_twice_equals_single_sets(spark, together):
    sf_dir = "/root/testdata/sf0.001"
    grid = persist_queries.grid_rows(spark, sf_dir, together=together, dedup="after").where("measure = 'shannon' AND outcome = 'confirmed'")
    for mode, dedup in (("event_day", "after"), ("none", "before")):
        single = persist_queries._set(spark, sf_dir, mode, dedup).select("subject_id", "subject_day", F.col("confirmed").alias("event"), "low_count")
        got = sorted(map(tuple, grid.where(F.col("mode") == mode).select("subject_id", "subject_day", "event", "low_count").collect()))
        assert got == sorted(map(tuple, single.collect()))
    before = persist_queries.grid_rows(spark, sf_dir, together=together).where("measure = 'shannon' AND outcome = 'confirmed' AND mode = 'event_day'")
    assert before.count() < grid.where("mode = 'event_day'").count()
