"""Association between measures on the raw rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.models import cluster_weights
from cohortloom.plans.joins import counted_bound, lookup_join
from cohortloom.plans.lineage import cut

NORMAL_975 = 1.959963984540054


def _interval(r: Column, n: Column) -> tuple[Column, Column]:
    """Fisher-z 95 % interval; null with fewer than four pairs."""
    half = F.when(n > 3, F.lit(NORMAL_975) / F.sqrt(n.cast("double") - 3))
    inside = F.when(F.abs(r) < 1, F.atanh(r))
    return F.tanh(inside - half), F.tanh(inside + half)


def _pearson(x: Column, y: Column) -> Column:
    """Correlation of rows that have both values; null, not an error, for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def _shares_sign(*cols: str) -> Column:
    above, below = F.lit(True), F.lit(True)
    for c in cols:
        above, below = above & (F.col(c) > 0), below & (F.col(c) < 0)
    return F.coalesce(above | below, F.lit(False))


def correlate(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation with its 95 % interval for several pairs of measures, in one pass."""
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [
            _pearson(F.when(both, F.col(x)), F.when(both, F.col(y))).alias(f"_r{i}"),
            F.count_if(both).alias(f"_n{i}"),
        ]
    entries = F.array(
        *[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_n{i}").alias("n"), F.col(f"_r{i}").alias("estimate"))
            for i, (x, y) in enumerate(pairs)
        ]
    )
    out = df.agg(*aggs).select(F.explode(entries).alias("_e")).select("_e.*")
    low, high = _interval(F.col("estimate"), F.col("n"))
    return out.withColumns({"lower": low, "upper": high})


def correlate_by(
    df: DataFrame, stratum: str, x: str, y: str, min_n: int = 5, null_label: str | None = None, center: str = "stratum"
) -> DataFrame:
    """Correlation per stratum with more than ``min_n`` pairs, strongest first.

    ``center="stratum"`` is Pearson's r.  ``center="table"`` measures both deviations from
    the means of the whole table, as a zero-mean model of globally standardised values does.
    """
    if center not in ("stratum", "table"):
        raise ValueError(f"unknown center {center!r}")
    label = F.col(stratum) if null_label is None else F.coalesce(stratum, F.lit(null_label))
    pairs = df.select(label.alias(stratum), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(
        subset=["_x", "_y"]
    )
    if center == "stratum":
        r = _pearson(F.col("_x"), F.col("_y"))
    else:
        means = pairs.agg(F.struct(F.avg("_x").alias("x"), F.avg("_y").alias("y")).alias("m"))
        pairs = pairs.withColumn("_m", means.scalar()).select(
            stratum, (F.col("_x") - F.col("_m.x")).alias("_x"), (F.col("_y") - F.col("_m.y")).alias("_y")
        )
        r = F.try_divide(
            F.sum(F.col("_x") * F.col("_y")),
            F.sqrt(F.sum(F.col("_x") * F.col("_x")) * F.sum(F.col("_y") * F.col("_y"))),
        )
    out = pairs.groupBy(stratum).agg(F.count("*").alias("n"), r.alias("estimate")).where(F.col("n") > min_n)
    low, high = _interval(F.col("estimate"), F.col("n"))
    out = out.withColumns({"lower": low, "upper": high})
    return out.withColumn("same_sign", _shares_sign("estimate", "lower", "upper")).orderBy(
        F.desc(F.abs("estimate")), stratum
    )


def correlate_resampled(
    df: DataFrame, pairs: Sequence[tuple[str, str]], subject: str, replicates: int, seed: int = 16, level: float = 0.95
) -> DataFrame:
    """Pearson correlation of several pairs with an interval that resamples subjects as a whole.

    A subject reduces to its six moments per pair.  Its Poisson(1) weights in all replicates are hashes, worked
    out once; one aggregation sums weighted moments for all replicates.  ``lower`` and ``upper`` are percentiles of the
    replicates' correlations, ``replicates`` how many of them have one (a replicate in which a measure does
    not vary has none).  A missing subject is a subject like others.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(f"m{i}_{k}") for i, pair in enumerate(pairs) for k, c in enumerate(pair)]).alias("m")).scalar()
    entries = []
    for i, (x, y) in enumerate(pairs):
        a, b = (F.col(c).cast("double") - F.col("_m")[f"m{i}_{k}"] for k, c in enumerate((x, y)))
        entries.append(F.struct(F.lit(i).alias("pair"), a.alias("a"), b.alias("b")))
    who = F.coalesce(F.concat(F.lit("="), F.col(subject).cast("string")), F.lit("")).alias("_who")
    rows = df.withColumn("_m", means).select(F.col(subject).alias("_subject"), who, F.inline(F.array(*entries))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    a, b = F.col("a"), F.col("b")
    moments = {"n": F.count("*").cast("double"), "sa": F.sum(a), "sb": F.sum(b), "aa": F.sum(a * a), "bb": F.sum(b * b), "ab": F.sum(a * b)}
    per_subject = cut(rows.groupBy("pair", "_who", "_subject").agg(*[m.alias(c) for c, m in moments.items()]))
    weights = cut(cluster_weights(per_subject.select("_subject", "_who"), "_subject", replicates, seed).withColumn(
        "_who", F.coalesce(F.concat(F.lit("="), F.col("_subject").cast("string")), F.lit(""))
    ))
    joined = lookup_join(per_subject.drop("_subject"), weights.drop("_subject"), ["_who"], counted_bound(weights), "inner", width=replicates + 128)
    drawn = joined.select("pair", *moments, F.posexplode("_w").alias("replicate", "w")).where(F.col("w") > 0)
    sums = drawn.groupBy("pair", "replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in moments])
    n = F.col("n")
    vary = (F.col("aa") - F.col("sa") * F.col("sa") / n) * (F.col("bb") - F.col("sb") * F.col("sb") / n)
    sums = sums.withColumn("r", F.when(vary > 0, (F.col("ab") - F.col("sa") * F.col("sb") / n) / F.sqrt(vary)))
    again = F.when(F.col("replicate") > 0, F.col("r"))
    # At most ``replicates`` values per pair.
    q = F.percentile(again, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    own = F.col("replicate") == 0
    out = sums.groupBy("pair").agg(
        F.max(F.when(own, F.col("n"))).cast("long").alias("n"), F.max(F.when(own, F.col("r"))).alias("estimate"), q.alias("_q"), F.count(again).alias("replicates")
    )
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])[F.col("pair")]
    return out.select(names["x"].alias("x"), names["y"].alias("y"), "n", "estimate", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "replicates")


def subject_trend(long: DataFrame, subject: str, day: str, measure: str, value: str) -> DataFrame:
    """Within-subject slope of each measure on the day, with subject-clustered standard error.

    Each subject reduces to its count, variance and covariance, so rows of one subject
    are combined before the shuffle.
    """
    x, y = F.col(day).cast("double"), F.col(value)
    per_subject = (
        long.where(x.isNotNull() & y.isNotNull())
        .groupBy(measure, subject)
        .agg(
            F.count("*").alias("_n"),
            (F.covar_pop(x, y) * F.count("*")).alias("_sxy"),
            (F.var_pop(x) * F.count("*")).alias("_sxx"),
        )
    )
    sums = per_subject.groupBy(measure).agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("subjects"),
        F.sum("_sxy").alias("_xy"),
        F.sum("_sxx").alias("_xx"),
        F.sum(F.col("_sxy") * F.col("_sxy")).alias("_s0"),
        F.sum(F.col("_sxy") * F.col("_sxx")).alias("_s1"),
        F.sum(F.col("_sxx") * F.col("_sxx")).alias("_s2"),
    )
    b = F.col("slope")
    score = F.greatest(F.col("_s0") - 2 * b * F.col("_s1") + b * b * F.col("_s2"), F.lit(0.0))
    out = sums.withColumn("slope", F.try_divide("_xy", "_xx")).withColumn(
        "std_error", F.try_divide(F.sqrt(score), F.col("_xx"))
    )
    return out.select(
        measure, "n", "subjects", "slope", "std_error",
        (b - NORMAL_975 * F.col("std_error")).alias("lower"),
        (b + NORMAL_975 * F.col("std_error")).alias("upper"),
    )


def affine_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Intercept and slope of y on x; on a standardised x these are the mean and deviation of y."""
    return df.agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
    )


def _fold(rows: Column, term) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, g: acc + term(g))


def _gls(rows: Column, totals: Column, lam: Column, intercept: bool) -> dict[str, Column]:
    """Generalised least squares at a variance ratio, from sums of subjects of equal size.

    A subject's inverse covariance is the identity less c = lam / (1 + lam n) in every cell, so its
    part of each cross product is the raw one less c times the product of its sums.
    """

    def less(name: str) -> Column:
        return _fold(rows, lambda g: g[name] * lam / (1.0 + lam * g["n"]))

    xx, xy, yy = (totals[c] - less(f"s{c}") for c in ("xx", "xy", "yy"))
    if not intercept:
        slope = F.try_divide(xy, xx)
        return {"slope": slope, "level": F.lit(0.0), "information": xx, "rss": yy - slope * xy}
    # Each c n m, c n x and c n y of the intercept's own cross products.
    nn = totals["n"] - _fold(rows, lambda g: g["m"] * g["n"] * g["n"] * lam / (1.0 + lam * g["n"]))
    x1 = totals["x"] - _fold(rows, lambda g: g["n"] * g["sx"] * lam / (1.0 + lam * g["n"]))
    y1 = totals["y"] - _fold(rows, lambda g: g["n"] * g["sy"] * lam / (1.0 + lam * g["n"]))
    information = xx - x1 * x1 / nn
    slope = F.try_divide(xy - x1 * y1 / nn, information)
    level = (y1 - slope * x1) / nn
    return {"slope": slope, "level": level, "information": information, "rss": yy - slope * xy - level * y1}


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _profile_slope(rows: Column, totals: Column, lam: Column, intercept: bool) -> Column:
    """Derivative of -2 log profile likelihood by the variance ratio."""
    fit = _gls(rows, totals, lam, intercept)

    def total(f: Column) -> Column:
        a, b = f["level"], f["slope"]

        def squares(g: Column) -> Column:
            own = g["syy"] - 2.0 * b * g["sxy"] + b * b * g["sxx"]
            own = own - 2.0 * a * g["n"] * (g["sy"] - b * g["sx"]) + a * a * g["n"] * g["n"] * g["m"]
            return own / ((1.0 + lam * g["n"]) * (1.0 + lam * g["n"]))

        spread = _fold(rows, lambda g: g["m"] * g["n"] / (1.0 + lam * g["n"]))
        return spread - F.try_divide(totals["n"] * _fold(rows, squares), f["rss"])

    return _bound(F.struct(*[c.alias(n) for n, c in fit.items()]), total)


def random_intercept(
    long: DataFrame, subject: str, day: str, measure: str, value: str, intercept: bool = False, rounds: int = 110
) -> DataFrame:
    """``value ~ day + (1 | subject)`` by maximum likelihood for every measure; ``intercept`` adds a common one.

    ``n``, ``subjects``, ``slope``, ``std_error``, ``lower``, ``upper``, ``level`` (null without a common intercept),
    ``sd_subject``, ``sd_residual`` and ``minus_2_loglik`` per measure.

    A subject counts through its number of rows and its sums alone, and subjects of equal size
    through sums over them, so what a measure is fitted from is one array as long as there are different sizes.  The ratio
    of the variances is where the derivative of the profile likelihood changes sign, by halving its
    logarithm's range; it is 0 where the likelihood falls from there.  Rows without day or value are
    left out; a missing subject is a subject like others.  Slope and error are null where nothing varies.
    """
    x, y = F.col(day).cast("double"), F.col(value).cast("double")
    rows = long.where(x.isNotNull() & y.isNotNull()).groupBy(measure, subject)
    per_subject = rows.agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"),
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"),
    )
    raw = ["x", "y", "xx", "xy", "yy"]
    by_size = per_subject.groupBy(measure, "n").agg(
        F.count("*").cast("double").alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        *[F.sum(c).alias(c) for c in raw],
    )
    entry = F.struct("n", "m", "sx", "sy", "sxx", "sxy", "syy")
    whole = F.struct(F.sum(F.col("n") * F.col("m")).alias("n"), F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in raw])
    gathered = by_size.groupBy(measure).agg(F.array_sort(F.collect_list(entry)).alias("_g"), whole.alias("_t"))
    g, t = F.col("_g"), F.col("_t")

    def halve(s: Column, _: Column) -> Column:
        def narrowed(mid: Column) -> Column:
            falls = _profile_slope(g, t, F.exp(mid), intercept) < 0
            return F.struct(F.when(falls, mid).otherwise(s["lo"]).alias("lo"), F.when(falls, s["hi"]).otherwise(mid).alias("hi"))

        return _bound((s["lo"] + s["hi"]) / 2.0, narrowed)

    start = F.struct(F.lit(-40.0).alias("lo"), F.lit(40.0).alias("hi"))
    # Halving is a fold over round numbers.
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, i: halve(s, i), lambda s: F.exp((s["lo"] + s["hi"]) / 2.0))
    at_zero = _profile_slope(g, t, F.lit(0.0), intercept)
    ratio = F.when(at_zero < 0, steps).otherwise(0.0)
    solved = gathered.withColumn("_lam", ratio)
    fit = F.struct(*[c.alias(n) for n, c in _gls(g, t, F.col("_lam"), intercept).items()])
    done = solved.withColumn("_f", fit).withColumn("_s2", F.greatest(F.col("_f.rss"), F.lit(0.0)) / t["n"])
    spread = _fold(g, lambda r: r["m"] * F.log1p(F.col("_lam") * r["n"]))
    slope, error = F.col("_f.slope"), F.try_divide(F.sqrt("_s2"), F.sqrt("_f.information"))
    minus2 = t["n"] * (F.log(2.0 * math.pi * F.col("_s2")) + 1.0) + spread
    return done.select(
        measure, t["n"].cast("long").alias("n"), t["m"].cast("long").alias("subjects"), slope.alias("slope"), error.alias("std_error"),
        (slope - NORMAL_975 * error).alias("lower"), (slope + NORMAL_975 * error).alias("upper"),
        (F.col("_f.level") if intercept else F.lit(None).cast("double")).alias("level"),
        F.sqrt(F.col("_lam") * F.col("_s2")).alias("sd_subject"), F.sqrt("_s2").alias("sd_residual"), minus2.alias("minus_2_loglik"),
    )
