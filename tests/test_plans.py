"""Quantiles beyond one task, joins with heavy keys, storage, and the caps that callers must ask for."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import draws, models, persist, shape
from cohortloom.plans import joins, lineage, ranking


def linear(values, p):
    """Quantile by weights of the two neighbours; NaN is the largest value."""
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    h = (len(v) - 1) * p
    a, b, f = v[math.floor(h)], v[math.ceil(h)], h - math.floor(h)
    return a if a == b or f == 0 else a * (1 - f) + b * f


PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


@pytest.mark.parametrize("window_rows", [1_000_000, 50])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_in_ranges(spark, monkeypatch, window_rows, accuracy):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randrange(5))])) for g in ["a", "b", None] for _ in range(700)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["quantiles"]) for r in ranking.quantile_arrays(df, ["g"], "v", PROBS, None, accuracy).collect()}
    for g in ("a", "b", "c", None):
        own = [v for k, v in rows if k == g]
        assert got[g][0] == len(own)
        assert got[g][1] == pytest.approx([linear(own, p) for p in PROBS])
    alone = ranking.quantile_arrays(df, [], "v", [0.1, 0.5], None, accuracy).first()
    assert alone["quantiles"] == pytest.approx([linear([v for _, v in rows], p) for p in (0.1, 0.5)])


def test_window_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 200)
    for n in (2_000, 20_000):
        df = lineage.cut(spark.range(n).select(F.lit("g").alias("g"), F.lit(0).alias("j"), F.xxhash64("id").cast("double").alias("v"), F.lit(1).cast("long").alias("c")))
        summed = ranking.running_sum(df, ["g"], ["j", "v"], "c", "upto", "n")
        assert summed.agg(F.max("upto"), F.count_distinct("upto"), F.max("n")).first() == (n, n, n)
        placed = df.repartitionByRange(-(-n // 200), "g", "j", "v").groupBy(F.spark_partition_id()).count()
        assert placed.agg(F.max("count")).first()[0] < 600


@pytest.mark.parametrize("bound", [None, 100_000])
def test_infinite_values_agree_both_ways(spark, bound):
    rows = [(float("-inf") if i % 10 < 4 else float(i),) for i in range(3000)] + [(float("inf"),)] * 500
    df = spark.createDataFrame(rows, "v double").withColumn("g", F.lit("x"))
    got = draws.median_qi(df, ["g"], "v", [0.5, 0.9], draws_bound=bound).collect()
    for r in got:
        assert r["median"] == pytest.approx(linear([v for (v,) in rows], 0.5))
        assert r["lower"] == float("-inf") and r["upper"] in (pytest.approx(linear([v for (v,) in rows], (1 + r["width"]) / 2)), float("inf"))


def test_bracket_that_misses_is_widened(spark, monkeypatch):
    seen = []
    real = ranking._brackets

    def narrow(rows, by, probs, accuracy, margin):
        seen.append(margin)
        edges = real(rows, by, probs, accuracy, margin)
        if len(seen) > 1:
            return edges
        return edges.withColumns({c: F.transform(c, lambda x: F.lit(-1.0)) for c in ("_lo", "_hi")})

    monkeypatch.setattr(ranking, "_brackets", narrow)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert ranking.quantile_arrays(df, [], "v", [0.5]).first()["quantiles"] == [499.5]
    assert len(seen) == 2 and seen[1] > seen[0]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_alone_are_repeated(spark, how):
    left = spark.range(10_000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    joined = joins.lookup_join(left, right, ["k"], None, how)
    assert joined.count() == (10_000 if how == "left" else 9_000)
    assert joined.where((F.col("x") != F.col("k") * 2)).count() == 0
    assert joined.where("k = 1 AND x IS NULL").count() == 0


def test_bounds_count_bytes():
    assert joins.fits_broadcast(200_000) and not joins.fits_broadcast(200_000, 96_000)
    assert not joins.fits_broadcast(None)


def test_wide_draws_are_joined_without_a_hint(spark):
    grid = spark.createDataFrame([("m", 0.5)], "model string, x double")
    few = spark.createDataFrame([("m", i, 0.1 * i, 1.0) for i in range(4)], "model string, draw long, a double, b double")
    plan = lambda **k: draws.fitted_draws(grid, few, "model", "draw", "a", {"b": "x"}, **k)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(models=3, draws_bound=4)
    joined = draws.fitted_draws(grid, few, "model", "draw", "a", {"b": "x"}, models=200_000)
    assert joined.count() == 4


def test_no_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_all_tokens_unless_asked(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "id int, t string")
    assert shape.explode_tokens(df, "t", "o").count() == 6
    assert shape.explode_tokens(df, "t", "o", max_parts=5).count() == 5


def test_unconverged_fits_say_so(spark):
    rows = [(1.0, float(x), x > 0) for x in range(-20, 21) if x]
    counts = models.sufficient_counts(spark.createDataFrame(rows, "one double, x double, y boolean").withColumn("m", F.lit("m")), ["m"], "y", ["one", "x"])
    early = models.coefficients(models.logit_fit(counts, ["m"], ["one", "x"], max_rounds=3), ["m"], ["one", "x"]).collect()
    late = models.coefficients(models.logit_fit(counts, ["m"], ["one", "x"], max_rounds=60), ["m"], ["one", "x"]).collect()
    assert not any(r["converged"] for r in early) and all(r["step"] > 1e-9 for r in early)
    assert all(r["converged"] for r in late)


def test_stored_bootstrap_rows_do_not_follow_the_replicates(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(models, "FEW_COUNTS", 0)
    monkeypatch.setattr(models, "cut", lambda df: stored.append(lineage.cut(df)) or stored[-1])
    rows = spark.range(600).select(F.lit("m").alias("m"), (F.col("id") % 60).alias("c"), F.lit(1.0).alias("one"), (F.xxhash64("id") / 2.0**63).alias("x"), (F.col("id") % 3 == 0).alias("y"))
    sizes = []
    for replicates in (5, 50):
        stored.clear()
        out = models.bootstrap_counts(rows, "m", "y", ["one", "x"], "c", replicates, 16)
        assert out.select("replicate").distinct().count() == replicates + 1
        sizes.append([s.count() for s in stored])
    assert sizes[0] == sizes[1] == [600]


def test_rows_without_a_day_and_ties(spark):
    df = spark.createDataFrame([(1, None, True, 0), (1, 1, True, 0), (1, 2, True, 0), (1, 2, False, 1), (1, 3, True, 0)], "s int, d int, f boolean, z int")
    got = sorted(tuple(r) for r in persist.persistence_count(df, "s", "d", "f").select("d", "z", "episode", "low_count").collect())
    assert got == [(1, 0, 0, 1), (2, 0, 0, 2), (2, 1, 1, 0), (3, 0, 1, 1)]


def test_zscore_by(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0), (None, 4.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["v_scaled"] for r in shape.zscore(df, ["v"], by="g").collect()}
    assert got[("a", 1.0)] == pytest.approx(-math.sqrt(0.5)) and got[(None, 4.0)] == pytest.approx(math.sqrt(0.5)) and got[("b", 5.0)] is None
