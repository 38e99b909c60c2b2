"""Logistic regression for many models at once, with cluster-bootstrap draws.

The estimator is a marginal logistic regression; subjects are resampled as a whole, so
draws carry the within-subject dependence.  Results differ from posterior draws of a
mixed-effect model: there is no prior and no subject intercept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalars import inverse_logit, normal_hash, poisson_one, unit_hash
from cohortloom.plans.joins import BROADCAST_ROWS, ROW_BYTES, SALT, counted_bound, lookup_join
from cohortloom.plans.lineage import cut

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLICATE = "replicate"
MAX_STEP = 4.0
# Weak penalty on every coefficient.  It gives separated data, common among bootstrap
# replicates, a finite and unique estimate and hardly moves any other.
RIDGE = 1e-3
FEW_COUNTS = 1_000_000
#: Tasks that work out the weights of clusters.
WEIGHT_TASKS = 64
#: Covariate patterns of a key that may travel as one array.
PATTERNS_IN_ROW = 4096
#: Numbers a task holds at once while it adds up weighted counts.
CELLS = 4 << 20
FIT = "n double, events double, beta array<double>, std_error array<double>, covariance array<double>, step double"


def sufficient_counts(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Rows with equal keys and covariates collapse to a count ``n`` and a count of events ``events``."""
    complete = df.select(
        *keys, *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("int").cast("double").alias("_y")
    ).dropna(subset=[*xs, "_y"])
    return complete.groupBy(*keys, *xs).agg(
        F.count("*").cast("double").alias("n"), F.sum("_y").alias("events")
    )


def cluster_weights(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """``cluster`` and ``_w``, its weight in replicates 0 (always 1) to ``replicates``, of every distinct cluster.

    A weight is Poisson(1) by a hash of seed, replicate and cluster, so no sample is drawn and any
    task can compute any weight again.
    """
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: unit_hash(seed, r, cluster))
    weights = F.transform(drawn, lambda u: poisson_one(u).cast("tinyint"))
    # A few bytes per cluster would otherwise end up in one task, which then works out all hashes.
    spread = clusters.select(cluster).distinct().repartition(WEIGHT_TASKS, cluster)
    return spread.withColumn("_w", F.concat(F.array(F.lit(1).cast("tinyint")), weights))


def bootstrap_counts(
    df: DataFrame, model: str, y: str, xs: Sequence[str], cluster: str | None, replicates: int, seed: int
) -> DataFrame:
    """Counts per (model, replicate, covariates); replicate 0 is the data as it is.

    A pass over the data works out a cluster's weights once, as one array, whatever the number of models and
    covariates.  What is stored has a row per (model, cluster, covariates), however many replicates there are.  Where covariates repeat so much that the counts of all replicates are
    no more rows than that, or than ``FEW_COUNTS``, these are stored instead; else weights are applied in every round.
    """
    if not replicates:
        return cut(sufficient_counts(df, [model], y, xs)).withColumn(REPLICATE, F.lit(0))
    per_cluster = cut(sufficient_counts(df, [model, cluster], y, xs))
    weights = cluster_weights(per_cluster, cluster, replicates, seed)
    clusters = counted_bound(per_cluster.select(cluster).distinct())
    # A missing cluster is a cluster like others, so the join needs a key that is never null.
    keyed = [t.withColumn("_weights_of", F.coalesce(F.concat(F.lit("="), F.col(cluster).cast("string")), F.lit(""))).drop(cluster) for t in (per_cluster, weights)]
    joined = lookup_join(*keyed, ["_weights_of"], clusters, "inner", width=replicates + 2 * ROW_BYTES)
    collapsed = per_cluster.select(model, *xs).distinct().count() * (replicates + 1)
    if collapsed <= max(FEW_COUNTS, per_cluster.count()):
        sums = _weighted_sums(joined.select(model, *xs, "n", "events", "_w"), [model, *xs], replicates + 1)
        each = sums.select(model, *xs, F.posexplode(F.arrays_zip("n", "events")).alias(REPLICATE, "_e")).select(model, REPLICATE, *xs, "_e.*").where(F.col("n") > 0)
        return cut(each.groupBy(model, REPLICATE, *xs).agg(F.sum("n").alias("n"), F.sum("events").alias("events")))
    weighted = joined.select(model, *xs, "n", "events", F.posexplode("_w").alias(REPLICATE, "_w")).where(F.col("_w") > 0)
    n, events = F.col("n") * F.col("_w"), F.col("events") * F.col("_w")
    return weighted.select(model, REPLICATE, *xs, n.alias("n"), events.alias("events"))


def _weighted_sums(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Arrays ``n`` and ``events`` per key: sums of both times each of the ``width`` weights in ``_w``.

    A task adds up its rows' arrays per key and passes on what it holds when that grows large, so a key
    comes in several rows, which are still to be added up.
    """
    keys = list(keys)

    def added(table: pa.Table, values: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        numbered = table.append_column("_row", pa.array(np.arange(len(table))))
        groups = numbered.group_by(keys, use_threads=False).aggregate([("_row", "list")])
        listed = groups.column("_row_list").combine_chunks()
        size = listed.value_lengths().to_numpy()
        order = listed.flatten().to_numpy()
        return groups.select(keys), np.add.reduceat(values[order], np.cumsum(size) - size, axis=0)

    def told(table: pa.Table, values: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * width)
        arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (values[:, :width], values[:, width:])]
        return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in keys], *arrays], names=[*keys, "n", "events"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Table, np.ndarray] | None = None
        most = max(1, CELLS // (2 * width))
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.slice(at, most)
                w = batch.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
                n, events = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("n", "events"))
                found = added(pa.Table.from_batches([batch.select(keys)]), np.hstack([w * n, w * events]))
                held = found if held is None else added(pa.concat_tables([held[0], found[0]]), np.vstack([held[1], found[1]]))
                if held[1].size > CELLS:
                    yield told(*held)
                    held = None
        if held is not None:
            yield told(*held)

    return rows.mapInArrow(summed, f"{_key_types(rows, keys)}, n array<double>, events array<double>")


def newton_sums(counts: DataFrame, beta: DataFrame | None, keys: Sequence[str], xs: Sequence[str], bound: int | None) -> DataFrame:
    """Gradient and information of the log-likelihood per key, as plain sums.

    ``beta`` is null at the start, which means zero for every coefficient.
    """
    k = len(xs)
    if beta is None:
        rows = counts.withColumns({f"_b{i}": F.lit(0.0) for i in range(k)})
    else:
        current = beta.select(*keys, *[F.col("beta")[i].alias(f"_b{i}") for i in range(k)])
        rows = lookup_join(counts, current, keys, bound, "inner", width=8 * k + 64)
    eta = F.lit(0.0)
    for i, x in enumerate(xs):
        eta = eta + F.col(f"_b{i}") * F.col(x)
    rows = rows.withColumn("_p", inverse_logit(eta))
    residual = F.col("events") - F.col("n") * F.col("_p")
    weight = F.col("n") * F.col("_p") * (1 - F.col("_p"))
    gradient = [F.sum(F.col(x) * residual).alias(f"_g{i}") for i, x in enumerate(xs)]
    information = [
        F.sum(F.col(xs[i]) * F.col(xs[j]) * weight).alias(f"_h{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    return rows.groupBy(*keys).agg(
        *[F.first(f"_b{i}").alias(f"_b{i}") for i in range(k)],
        F.sum("n").alias("n"), F.sum("events").alias("events"), *gradient, *information,
    )


def _solve(g: np.ndarray, h: np.ndarray, beta: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next coefficients, covariances and largest step of many small systems."""
    h = h + np.eye(h.shape[-1]) * ridge
    step = np.linalg.solve(h, (g - ridge * beta)[:, :, None])[:, :, 0]
    largest = np.abs(step).max(axis=1, initial=0.0)
    scale = np.minimum(1.0, MAX_STEP / np.maximum(largest, 1e-300))
    return beta + step * scale[:, None], np.linalg.inv(h), largest * scale


def _errors(covariance: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diagonal(covariance, axis1=1, axis2=2), 0.0))


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{key}` {df.schema[key].dataType.simpleString()}" for key in keys)


def _newton_step(sums: DataFrame, keys: Sequence[str], k: int, ridge: float) -> DataFrame:
    """Solve the small system of each key.  Only aggregated rows pass through Python."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = len(batch)
            g = np.column_stack([batch[f"_g{i}"].to_numpy(float) for i in range(k)]) if m else np.zeros((0, k))
            h = np.zeros((m, k, k))
            for i in range(k):
                for j in range(i, k):
                    h[:, i, j] = h[:, j, i] = batch[f"_h{i}_{j}"].to_numpy(float)
            beta = np.column_stack([batch[f"_b{i}"].to_numpy(float) for i in range(k)]) if m else np.zeros((0, k))
            beta, covariance, step = _solve(g, h, beta, ridge)
            yield batch[[*keys, "n", "events"]].assign(
                beta=list(beta), std_error=list(_errors(covariance)), covariance=list(covariance.reshape(m, -1)), step=step
            )

    return sums.mapInPandas(solve, f"{_key_types(sums, keys)}, {FIT}")


def _fit_in_rows(counts: DataFrame, keys: Sequence[str], xs: Sequence[str], max_rounds: int, tolerance: float, ridge: float) -> DataFrame:
    """All rounds of a key at once, from its covariate patterns as one array.  For keys of few patterns."""
    k = len(xs)
    patterns = counts.groupBy(*keys).agg(F.collect_list(F.array(*xs, "n", "events")).alias("_patterns"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rows in batch["_patterns"]:
                table = np.array([*rows], float)
                x, n, events = table[:, :k], table[:, k], table[:, k + 1]
                beta = np.zeros((1, k))
                for _ in range(max_rounds):
                    with np.errstate(over="ignore"):
                        p = 1.0 / (1.0 + np.exp(-(x @ beta[0])))
                    g, h = x.T @ (events - n * p), (x.T * (n * p * (1 - p))) @ x
                    beta, covariance, step = _solve(g[None], h[None], beta, ridge)
                    if step[0] < tolerance:
                        break
                found.append((n.sum(), events.sum(), beta[0], _errors(covariance)[0], covariance.ravel(), step[0]))
            yield pd.concat([batch[[*keys]], pd.DataFrame(found, columns=["n", "events", "beta", "std_error", "covariance", "step"], index=batch.index)], axis=1)

    return cut(patterns.mapInPandas(solve, f"{_key_types(counts, keys)}, {FIT}"))


def logit_fit(
    counts: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    max_rounds: int = 24,
    tolerance: float = 1e-9,
    ridge: float = RIDGE,
    bound: int | None = None,
    start: DataFrame | None = None,
    in_rows: int = PATTERNS_IN_ROW,
) -> DataFrame:
    """Newton iterations for every key at once: keys, n, events, ``beta``, ``std_error``, ``covariance`` (row by row), ``step``, ``converged``.

    Where every key has ``in_rows`` covariate patterns at most, a key's patterns are one array and
    its rounds take one job in all.  Otherwise a round is one aggregation of the counts with the coefficients of the
    round before, and keys that have converged leave; ``counts`` is read once per round, so store what is
    costly.  ``bound`` is a proven number of keys; without it they are counted.  ``start``
    (some of the keys, ``beta``) is where the rounds begin, zero without it.  A covariate that is zero in all rows
    of a key keeps coefficient 0, so models with different terms share one call.  ``ridge``
    keeps separated data finite; ``step`` tells how far a key is from convergence, ``converged``
    whether it got there within ``max_rounds``.
    """
    keys = list(keys)
    sizes = cut(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("patterns")))
    if (sizes.agg(F.max("patterns")).first()[0] or 0) <= in_rows:
        fit = _fit_in_rows(counts, keys, xs, max_rounds, tolerance, ridge)
        return fit.withColumn("converged", F.col("step") < tolerance)
    bound = counted_bound(sizes, BROADCAST_ROWS) if bound is None else bound
    beta = None
    if start is not None:
        known = [key for key in keys if key in start.columns]
        beta = sizes.join(start.select(*known, "beta"), known).select(*keys, "beta")
    settled = []
    for _ in range(max_rounds):
        seen = Observation()
        stepped = _newton_step(newton_sums(counts, beta, keys, xs, bound), keys, len(xs), ridge)
        state = cut(stepped.observe(seen, F.max("step").alias("step")))
        settled.append(state.where(F.col("step") < tolerance))
        beta = state.where(F.col("step") >= tolerance)
        if (seen.get["step"] or 0.0) < tolerance:
            break
    else:
        settled.append(beta)
    return reduce(DataFrame.union, settled).withColumn("converged", F.col("step") < tolerance)


def coefficients(fit: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """One row per key and coefficient, with ``converged`` and the last ``step`` of the key's fit."""
    entries = F.array(
        *[
            F.struct(F.lit(x).alias("param"), F.col("beta")[i].alias("value"), F.col("std_error")[i].alias("std_error"))
            for i, x in enumerate(xs)
        ]
    )
    return fit.select(*keys, "converged", "step", F.explode(entries).alias("_e")).select(*keys, "_e.*", "converged", "step")


def logit_many(
    df: DataFrame,
    model: str,
    y: str,
    xs: Sequence[str],
    cluster: str | None = None,
    replicates: int = 0,
    seed: int = 16,
    **options,
) -> DataFrame:
    """Fit every model and every bootstrap replicate; long table (model, replicate, param, value, std_error, converged, step).

    Replicate 0 is the estimate; replicates 1..B are draws for the operators on draws tables.
    """
    counts = bootstrap_counts(df, model, y, xs, cluster, replicates, seed)
    keys = [model, REPLICATE]
    if replicates:
        # Replicates begin at the estimate, from which a few rounds lead to each.
        counted = cut(counts.where(F.col(REPLICATE) == 0))
        options = {"start": logit_fit(counted, [model], xs, **options).select(model, "beta"), **options}
    return coefficients(logit_fit(counts, keys, xs, **options), keys, xs)


def top_strata(df: DataFrame, stratum: str, k: int) -> DataFrame:
    """The ``k`` most frequent strata; ties go to the smaller name."""
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(stratum)).limit(k)


def stratum_slopes(
    df: DataFrame, stratum: str, x: str, y: str, k: int = 10, labels: DataFrame | None = None, **options
) -> DataFrame:
    """Slope of the outcome on x in each of the top-k strata, shrunk towards the pooled slope.

    Every stratum has its own intercept and slope.  The shrinkage weight is that of a random
    slope whose variance is estimated by moments from the spread of the slopes.
    """
    # k is a setting, so the chosen strata are a bounded table.
    chosen = F.broadcast(top_strata(df, stratum, k))
    rows = df.join(chosen, stratum).withColumn("_one", F.lit(1.0))
    xs = ["_one", x]
    fit = logit_fit(cut(sufficient_counts(rows, [stratum], y, xs)), [stratum], xs, bound=k, **options)
    slopes = fit.select(
        stratum, "converged", F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"),
        F.col("beta")[1].alias("slope"), F.col("std_error")[1].alias("std_error"),
    )
    w = 1.0 / (F.col("std_error") * F.col("std_error"))
    first = slopes.agg(
        F.struct(
            (F.sum(w * F.col("slope")) / F.sum(w)).alias("mean"),
            F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("slope") * F.col("slope")).alias("ws2"),
            F.count("*").alias("k"),
        ).alias("s")
    )
    s = F.col("_s")
    q = s["ws2"] - s["w"] * s["mean"] * s["mean"]
    tau2 = F.greatest(F.try_divide(q - (s["k"] - 1), s["w"] - s["w2"] / s["w"]), F.lit(0.0))
    moved = slopes.withColumn("_s", first.scalar()).withColumn("_tau2", F.coalesce(tau2, F.lit(0.0)))
    keep = F.col("_tau2") / (F.col("_tau2") + F.col("std_error") * F.col("std_error"))
    out = moved.select(
        stratum, "n", "events", "slope", "std_error", F.col("_s.mean").alias("pooled"),
        (keep * F.col("slope") + (1 - keep) * F.col("_s.mean")).alias("shrunk"), "converged",
    )
    if labels is None:
        return out
    # One label per stratum: joining a label table keyed more finely would repeat the slopes.
    names = [c for c in labels.columns if c != stratum]
    return out.join(labels.groupBy(stratum).agg(*[F.min(c).alias(c) for c in names]), stratum, "left")


def _posterior(s: Column, r: Column) -> Column:
    """Posterior mean (``m0``, ``m1``) and covariance (``c00``, ``c01``, ``c11``) of a stratum under the mean and covariance ``s``."""

    def at(q: Column) -> Column:
        # Gain: covariance of the strata times the inverse of that plus the estimate's own.
        g00 = (s["s00"] * q["b"] - s["s01"] * q["c"]) / q["det"]
        g01 = (s["s01"] * q["a"] - s["s00"] * q["c"]) / q["det"]
        g10 = (s["s01"] * q["b"] - s["s11"] * q["c"]) / q["det"]
        g11 = (s["s11"] * q["a"] - s["s01"] * q["c"]) / q["det"]
        d0, d1 = r["b0"] - s["m0"], r["b1"] - s["m1"]
        return F.struct(
            (s["m0"] + g00 * d0 + g01 * d1).alias("m0"), (s["m1"] + g10 * d0 + g11 * d1).alias("m1"),
            (s["s00"] - g00 * s["s00"] - g01 * s["s01"]).alias("c00"), (s["s01"] - g00 * s["s01"] - g01 * s["s11"]).alias("c01"),
            (s["s11"] - g10 * s["s01"] - g11 * s["s11"]).alias("c11"),
        )

    a, b, c = s["s00"] + r["v00"], s["s11"] + r["v11"], s["s01"] + r["v01"]
    parts = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b - c * c).alias("det"))
    return F.transform(F.array(parts), at)[0]


def _moments(posteriors: Column) -> Column:
    """Mean and covariance that the posteriors of all strata imply."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "m0", "m1", "s00", "s01", "s11")])

    def add(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["n"] + 1.0).alias("n"), (acc["m0"] + p["m0"]).alias("m0"), (acc["m1"] + p["m1"]).alias("m1"),
            (acc["s00"] + p["c00"] + p["m0"] * p["m0"]).alias("s00"), (acc["s01"] + p["c01"] + p["m0"] * p["m1"]).alias("s01"),
            (acc["s11"] + p["c11"] + p["m1"] * p["m1"]).alias("s11"),
        )

    def finish(acc: Column) -> Column:
        m0, m1 = acc["m0"] / acc["n"], acc["m1"] / acc["n"]
        return F.struct(
            m0.alias("m0"), m1.alias("m1"), (acc["s00"] / acc["n"] - m0 * m0).alias("s00"),
            (acc["s01"] / acc["n"] - m0 * m1).alias("s01"), (acc["s11"] / acc["n"] - m1 * m1).alias("s11"),
        )

    return F.aggregate(posteriors, zero, add, finish)


def stratum_effects(df: DataFrame, stratum: str, x: str, y: str, k: int = 10, rounds: int = 500, **options) -> DataFrame:
    """Intercept and slope of each of the top-k strata, varying together around a common mean.

    Strata are fitted on their own; their estimates then are noisy values of intercepts and slopes from one
    two-dimensional normal distribution, whose mean and covariance come from ``rounds`` of EM: posteriors of the
    strata, then the moments they imply.  ``k`` is a setting, so all strata are one array.

    Per stratum: ``n``, ``events``, own estimates ``b0``, ``b1``, posterior ``intercept``, ``slope`` and their covariance
    ``c00``, ``c01``, ``c11``, and the distribution ``mean_intercept``, ``mean_slope``, ``s00``, ``s01``, ``s11`` with
    ``change``, by how much the last round moved it.
    """
    chosen = F.broadcast(top_strata(df, stratum, k).select(stratum))
    rows = df.join(chosen, stratum).withColumn("_one", F.lit(1.0))
    xs = ["_one", x]
    fit = logit_fit(cut(sufficient_counts(rows, [stratum], y, xs)), [stratum], xs, bound=k, **options)
    entry = F.struct(
        F.col(stratum).alias("stratum"), F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"),
        *[F.col("beta")[i].alias(f"b{i}") for i in (0, 1)], *[F.col("covariance")[i].alias(c) for i, c in ((0, "v00"), (1, "v01"), (3, "v11"))],
    )
    gathered = fit.agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    own = F.transform("_r", lambda r: F.struct(r["b0"].alias("m0"), r["b1"].alias("m1"), r["v00"].alias("c00"), r["v01"].alias("c01"), r["v11"].alias("c11")))
    names = ("m0", "m1", "s00", "s01", "s11")

    def again(both: Column, _: Column) -> Column:
        now = both["now"]
        return F.struct(_moments(F.transform("_r", lambda r: _posterior(now, r))).alias("now"), now.alias("before"))

    first = F.struct(_moments(own).alias("now"), _moments(own).alias("before"))
    found = gathered.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again))
    now, before = F.col("_s.now"), F.col("_s.before")
    per = found.withColumn("_p", F.transform("_r", lambda r: F.struct(r.alias("r"), _posterior(now, r).alias("p")))).select("_s", F.explode("_p").alias("_e"))
    change = F.greatest(*[F.abs(now[c] - before[c]) for c in names])
    return per.select(
        F.col("_e.r.stratum").alias(stratum), "_e.r.n", "_e.r.events", "_e.r.b0", "_e.r.b1",
        F.col("_e.p.m0").alias("intercept"), F.col("_e.p.m1").alias("slope"), "_e.p.c00", "_e.p.c01", "_e.p.c11",
        now["m0"].alias("mean_intercept"), now["m1"].alias("mean_slope"), *[now[c].alias(c) for c in names[2:]], change.alias("change"),
    )


def stratum_draws(effects: DataFrame, stratum: str, draws: int, seed: int) -> DataFrame:
    """``stratum``, ``draw``, ``b_0``, ``b_1``: intercept and slope drawn together from each stratum's posterior, by hash."""
    l00 = F.sqrt(F.greatest("c00", F.lit(0.0)))
    l10 = F.coalesce(F.try_divide(F.col("c01"), l00), F.lit(0.0))
    l11 = F.sqrt(F.greatest(F.col("c11") - l10 * l10, F.lit(0.0)))
    drawn = effects.select(stratum, "intercept", "slope", l00.alias("_l00"), l10.alias("_l10"), l11.alias("_l11")).withColumn(
        "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))
    )
    z = [normal_hash(seed, stratum, "draw", F.lit(i)) for i in (0, 1)]
    b1 = F.col("slope") + F.col("_l10") * F.col("_z0") + F.col("_l11") * F.col("_z1")
    return drawn.withColumns({"_z0": z[0], "_z1": z[1]}).select(
        stratum, "draw", (F.col("intercept") + F.col("_l00") * F.col("_z0")).alias("b_0"), b1.alias("b_1")
    )


def sample_by_size(
    df: DataFrame, group: str, unique_id: Sequence[str], sizes: Sequence[int], seed: int, salts: int = 64
) -> DataFrame:
    """For each size, that many rows per group without replacement, as (rows x ``sample_size``).

    Rows are ordered by a hash of seed and id; samples of growing size contain each other.
    The largest sample is found in two steps, first inside parts of a group and then
    among the survivors, so a large group is never sorted in one task.
    """
    most = max(sizes)
    u = unit_hash(seed, *unique_id)
    rows = df.withColumns({"_u": u, SALT: F.pmod(F.xxhash64(*unique_id), F.lit(salts)).cast("int")})
    part = Window.partitionBy(group, SALT).orderBy("_u", *unique_id)
    survivors = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most)
    whole = Window.partitionBy(group).orderBy("_u", *unique_id)
    ranked = survivors.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= most)
    wanted = F.filter(F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: s >= F.col("_r"))
    return ranked.withColumn("sample_size", F.explode(wanted)).drop("_r", "_u", SALT)


def sample_size_sweep(
    df: DataFrame,
    group: str,
    unique_id: Sequence[str],
    y: str,
    x: str,
    sizes: Sequence[int],
    replicates: int,
    seed: int = 16,
    **options,
) -> DataFrame:
    """Refit y ~ 1 + x on samples of every size and summarise the odds ratio.

    Per (group, size): estimate and bootstrap interval of the log-odds, odds ratio, whether
    the interval excludes zero, the share of draws with the sign opposite to the full data's, and
    whether all fits converged.
    """
    xs = ["_one", x]
    keyed = df.withColumn("_one", F.lit(1.0))
    sampled = sample_by_size(keyed, group, unique_id, sizes, seed).withColumn("_cluster", F.concat_ws("|", *unique_id))
    name = F.concat_ws("|", F.col(group).cast("string"), F.col("sample_size").cast("string"))
    draws = logit_many(sampled.withColumn("_model", name), "_model", y, xs, "_cluster", replicates, seed, **options)
    full = logit_many(keyed.withColumn("_model", F.col(group).cast("string")), "_model", y, xs, **options)
    slope = draws.where(F.col("param") == x)
    parts = F.split("_model", r"\|")
    slope = slope.select(
        F.element_at(parts, -1).cast("int").alias("sample_size"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "|").alias(group),
        REPLICATE, "value", "converged",
    )
    truth = full.where(F.col("param") == x).select(
        F.col("_model").alias(group), F.col("value").alias("full_value"), F.col("converged").alias("_full_converged")
    )
    rows = slope.join(truth, group)
    drawn = F.when(F.col(REPLICATE) > 0, F.col("value"))
    q = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    opposite = F.when(F.col(REPLICATE) > 0, (F.signum("value") != F.signum("full_value")).cast("double"))
    out = rows.groupBy(group, "sample_size").agg(
        F.max(F.when(F.col(REPLICATE) == 0, F.col("value"))).alias("estimate"), q.alias("_q"), F.avg(opposite).alias("sign_error_share"),
        F.bool_and(F.col("converged") & F.col("_full_converged")).alias("converged"),
    )
    return out.select(
        group, "sample_size", "estimate", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"),
        F.exp("estimate").alias("odds_ratio"),
        ((F.col("_q")[0] > 0) | (F.col("_q")[1] < 0)).alias("detected"), "sign_error_share", "converged",
    )


def detection_share(sweep: DataFrame) -> DataFrame:
    """Share of groups in which an effect is detected, per sample size."""
    return sweep.groupBy("sample_size").agg(
        F.avg(F.col("detected").cast("double")).alias("detection_share"),
        F.avg("sign_error_share").alias("sign_error_share"),
    )
