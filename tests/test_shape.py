"""Small hand-made frames and brute-force checks of the timeline operators."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import fixed_values as fixed
from cohortloom.functions import scalars
from cohortloom.operators import define, persist, shape
from cohortloom.sources.measurements import read_measurements, read_results, write_results


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def hot(spark):
    """Two hundred subjects, one of which holds a third of the rows, with gaps and missing values."""
    rng = random.Random(7)
    data = []
    for s in range(200):
        days = 4000 if s == 0 else 40
        day = rng.randrange(-5, 5)
        for _ in range(days):
            day += rng.choice([1, 1, 1, 2, 3])
            value = None if rng.random() < 0.3 else round(rng.random(), 3)
            data.append((s, day, value, "x" if rng.random() < 0.5 else None))
    frame = pd.DataFrame(data, columns=["s", "day", "v", "label"])
    return spark.createDataFrame(data, "s long, day long, v double, label string"), frame


def test_locf_equals_pandas_over_block_borders(hot):
    df, frame = hot
    expected = frame.sort_values(["s", "day"]).copy()
    expected["v"] = expected.groupby("s")["v"].ffill()
    got = shape.locf(df, "s", "day", ["v", "label"], block_days=9).orderBy("s", "day").toPandas()
    assert got["v"].fillna(-1).tolist() == expected["v"].fillna(-1).tolist()
    label = expected.groupby("s")["label"].ffill()
    assert got["label"].fillna("").tolist() == label.fillna("").tolist()


def test_locf_leading_null_stays_and_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, float("nan")), (1, 3, None)], "s int, day int, v double")
    clean = shape.normalise_missing(df, "s", "day", nan_columns=["v"])
    assert [r[2] for r in rows(shape.locf(clean, "s", "day", ["v"]), "day")] == [None, 2.0, 2.0, 2.0]


def test_densify_equals_brute_force(hot):
    df, frame = hot
    got = shape.densify_calendar(df, "s", "day", carry=["v"], block_days=9, synthetic="added").toPandas()
    spans = frame.groupby("s")["day"].agg(["min", "max"])
    assert len(got) == int((spans["max"] - spans["min"] + 1).sum())
    assert (~got["added"]).sum() == len(frame)
    parts = []
    for s, g in frame.groupby("s"):
        full = g.set_index("day").reindex(range(g["day"].min(), g["day"].max() + 1))
        parts.append(pd.DataFrame({"s": s, "day": full.index, "v": full["v"].ffill().to_numpy(), "label": full["label"].to_numpy()}))
    expected = pd.concat(parts).sort_values(["s", "day"])
    got = got.sort_values(["s", "day"])
    assert got["v"].fillna(-1).tolist() == expected["v"].fillna(-1).tolist()
    assert got["label"].fillna("").tolist() == expected["label"].fillna("").tolist()


def test_densify_long_gap_duplicate_day_and_date(spark):
    day0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, 0, day0, 1.0), (1, 0, day0, 2.0), (1, 10000, day0 + dt.timedelta(10000), 3.0)], "s int, day int, d date, v double"
    )
    got = shape.densify_calendar(df, "s", "day", date="d", tie_break=["v"])
    assert got.count() == 10002
    assert got.where("day = 9999").first().d == day0 + dt.timedelta(9999)
    assert got.where("day between 1 and 9999 and v is null").count() == 9999


def brute_persistence(frame, flag):
    out = {}
    for s, g in frame.groupby("s"):
        episode = count = 0
        previous = False
        for day, on in zip(g["day"], g[flag]):
            improved = previous and not on
            if improved:
                episode, count = episode + 1, 0
            count += int(on)
            out[s, day] = (improved, episode, count)
            previous = on
    return out


def test_persistence_equals_brute_force_on_a_hot_subject(hot):
    df, frame = hot
    kept = frame.dropna(subset=["v"]).sort_values(["s", "day"]).copy()
    kept["low"] = kept["v"] < 0.9
    flagged = define.dichotomise(df, "v", "<", 0.9, "low").select("s", "day", "low")
    got = persist.persistence_count(flagged, "s", "day", "low", block_days=4)
    assert {(r.s, r.day): (r.improved, r.episode, r.low_count) for r in got.collect()} == brute_persistence(kept, "low")


def test_persistence_small_example_and_double_counting(spark):
    data = [(1, d, v) for d, v in ((0, 1.0), (2, 2.5), (4, 1.5), (5, 1.2), (6, 1.1))]
    df = define.dichotomise(spark.createDataFrame(data, "s int, day int, v double"), "v", "<", 2, "low")
    counts = [r.low_count for r in persist.persistence_count(df, "s", "day", "low").orderBy("day").collect()]
    assert counts == [1, 0, 1, 2, 3]
    doubled = df.unionAll(df.where("day = 6"))
    counts = [r.low_count for r in persist.persistence_count(doubled, "s", "day", "low").orderBy("day", "low_count").collect()]
    assert counts == [1, 0, 1, 2, 3, 4]


def test_censoring_modes_and_null_policy(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    data = [(1, d(0), d(3)), (1, d(3), d(3)), (1, d(4), d(3)), (2, d(0), None), (2, d(5), None), (3, d(0), None), (3, None, None)]
    df = spark.createDataFrame(data, "s int, date date, first date")
    assert [r[:2] for r in rows(shape.censor_at_first(df, "s", "date", "first"), "s", "date")] == [
        (1, d(0)), (1, d(3)), (2, d(0)), (2, d(5)), (3, d(0))
    ]
    strict = shape.censor_at_first(df, "s", "date", "first", null_policy="propagate", block_days=2)
    assert [r[:2] for r in rows(strict, "s", "date")] == [(1, d(0)), (1, d(3)), (2, d(0)), (2, d(5))]
    day = shape.censor_at_first(df, "s", "date", "first", mode="event_day", block_days=2)
    assert [r[:2] for r in rows(day, "s", "date")] == [(1, d(3)), (2, d(5)), (3, d(0))]


def test_default_censoring_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), None)], "s int, date date, first date")
    plan = shape.censor_at_first(df, "s", "date", "first")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_zscore_of_constant_is_null_and_needs_no_window(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = shape.zscore(df, ["a", "b"])
    assert [tuple(r) for r in out.select("a_scaled", "b_scaled").collect()] == [(-1.0, None), (0.0, None), (1.0, None)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "staphylococcus_aureus staphylococcus")], "s int, t string")
    five = shape.explode_tokens(df, "t", "organism", max_parts=5, rules=fixed.ORGANISM_RULES)
    assert rows(five.where("s = 1"), "s", "organism") == [(1, x) for x in "ABCDE"]
    out = shape.explode_tokens(df, "t", "organism", rules=fixed.ORGANISM_RULES)
    assert rows(out, "s", "organism") == [
        (1, "A"), (1, "B"), (1, "C"), (1, "D"), (1, "E"), (1, "F"),
        (3, "Staphylococcus (non-aureus)"), (3, "Staphylococcus aureus"),
    ]


def test_indications(spark):
    data = [("stroke",), ("lung carcinoma",), (None,), ("pneumonia",)]
    df = spark.createDataFrame(data, "t string")
    out = shape.recode_by_pattern(df, "t", fixed.INDICATION_RULES, fixed.INDICATION_WHEN_MISSING)
    assert [r.t for r in out.collect()] == ["neurologic disorder", "cancer", "prior records not available", "pneumonia"]
    assert [r[0] for r in df.select(scalars.matches("t", fixed.PNEUMONIA_PATTERN)).collect()] == [False, False, False, True]


def test_significant_digits(spark):
    df = spark.createDataFrame([(0.012345,), (1234.0,), (0.0,), (-98765.0,), (None,)], "x double")
    assert [r.x for r in shape.signif(df, ["x"], 3).collect()] == [0.0123, 1230.0, 0.0, -98800.0, None]


def test_log10_of_zero(spark):
    df = spark.createDataFrame([(0.0,), (100.0,)], "x double")
    assert [r[0] for r in df.select(scalars.log10_of("x")).collect()] == [-math.inf, 2.0]
    assert [r[0] for r in df.select(scalars.log10_of("x", "null")).collect()] == [None, 2.0]


def test_read_and_write(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,x,flag\n1,Undetermined,TRUE\n2,1000,NA\n3,NA,FALSE\n")
    df = read_measurements(spark, str(tmp_path / "m.csv"), "id int, x string, flag boolean", numeric=["x"], log10={"x": "lx"})
    assert rows(df, "id") == [(1, None, True, None), (2, 1000.0, None, 3.0), (3, None, False, None)]
    for file_format in ("parquet", "csv", "tsv"):
        path = str(tmp_path / file_format)
        write_results(df.select("id", "x", "lx"), path, ["id"], file_format)
        back = read_results(spark, path, "x double, lx double, id int", file_format)
        assert rows(back.select("id", "x", "lx"), "id") == [(1, None, None), (2, 1000.0, 3.0), (3, None, None)]


def test_impute_modes(spark):
    raw = spark.createDataFrame([(1, 0, 1.0, True), (1, 1, None, True)], "s int, day int, v double, f boolean")
    filled = shape.locf(raw, "s", "day", ["v"])
    assert shape.impute(raw, filled, "event_day", "f").count() == 4
    assert shape.impute(raw, filled, "event_day", "f", dedup=True).count() == 3
    assert shape.impute(raw, filled, "none").count() == 2
    with pytest.raises(ValueError):
        shape.impute(raw, filled, "other", "f")


def test_grid_equals_single_sets(spark, hot):
    """The one-pass grid and the step-by-step sets agree, also with missing outcome flags."""
    df, _ = hot
    day0 = dt.date(2024, 1, 1)
    base = df.withColumns(
        {
            "date": F.date_add(F.lit(day0), F.col("day").cast("int")),
            "broad": F.when(F.col("day") % 11 != 3, (F.col("s") + F.col("day")) % 17 == 0),
            "narrow": F.when(F.col("day") % 13 != 5, (F.col("s") + F.col("day")) % 23 == 0),
        }
    )
    firsts = base.groupBy("s").agg(
        F.min(F.when(F.col("broad"), F.col("date"))).alias("first_broad"), F.min(F.when(F.col("narrow"), F.col("date"))).alias("first_narrow")
    )
    base = base.join(firsts, "s").where("s < 40")
    filled = shape.densify_calendar(
        base.withColumn("raw_v", F.col("v")), "s", "day", carry=["v", "first_broad", "first_narrow"], date="date",
        synthetic="synthetic", block_days=9,
    )
    outcomes = {"broad": ("broad", "first_broad"), "narrow": ("narrow", "first_narrow")}
    grid = persist.persistence_grid(
        filled, "s", "day", "date", "synthetic", outcomes, {"v": ("raw_v", "v", "<", 0.5)}, "broad", block_days=9
    ).cache()
    cols = ["s", "day", "date", "v", "broad", "narrow", "first_broad", "first_narrow"]
    for mode in ("none", "event_day", "full"):
        for outcome, (flag, first) in outcomes.items():
            one = persist.persistence_set(
                base.select(*cols), filled.select(*cols), "s", "day", "date", flag, first, "v", "<", 0.5, mode, "broad", block_days=9
            ).select("s", "day", F.col(flag).alias("event"), "low_count")
            many = grid.where((F.col("mode") == mode) & (F.col("outcome") == outcome)).select("s", "day", "event", "low_count")
            assert one.count() == many.count() > 0
            assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_within_hours_equals_brute_force(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    def make(n):
        return [(0 if rng.random() < 0.4 else rng.randrange(1, 9), base + dt.timedelta(seconds=rng.randrange(0, 60 * 86400))) for _ in range(n)]
    a, b = make(300), make(60)
    left = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(a)], "i int, s int, ts timestamp")
    right = spark.createDataFrame(b, "s int, ts timestamp")
    got = {r.i: r.hit for r in define.within_hours(left, right, "s", "ts", 5, "hit").collect()}
    limit = dt.timedelta(hours=5)
    assert got == {i: any(s == s2 and abs(t - t2) <= limit for s2, t2 in b) for i, (s, t) in enumerate(a)}


def test_case_window(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    df = spark.createDataFrame([(n, d(n), d(2)) for n in range(4)], "n int, date date, first date")
    assert [r.f for r in define.case_window(df, "date", "first", "f").orderBy("n").collect()] == [False, True, True, False]
