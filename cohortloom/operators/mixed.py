"""Logistic regression with a normal intercept per subject, for many models at once.

The marginal likelihood of a subject is an integral over its intercept, taken as a weighted sum
over Gauss-Hermite nodes.  A subject is one row with its covariate patterns as an array, so a
Newton round over fixed effects and the log of the intercept's standard deviation is a map over
subjects and one small aggregation per model; rows of data are shuffled once, before the first round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.functions.hashes import unit_numbers
from cohortloom.functions.scalars import normal_hash
from cohortloom.operators.models import _key_types, logit_fit, sufficient_counts
from cohortloom.plans.joins import counted_bound, lookup_join
from cohortloom.plans.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = 20
#: Patterns of one row; a subject of more is dealt into several rows.
PATTERNS = 2048
#: Smallest log of the intercept's standard deviation; a fit that ends there has no spread between subjects.
LEAST_LOG_SD = -5.0
MAX_STEP = 2.0
#: Numbers a task holds at once while it sums over nodes.
CELLS = 4 << 20
STATE = (
    "theta array<double>, base array<double>, base_loglik double, move array<double>, covariance array<double>, "
    "n double, events double, subjects double, step double"
)


def subject_rows(df: DataFrame, model: str, subject: str, y: str, xs: Sequence[str], most: int = PATTERNS) -> DataFrame:
    """``model``, ``subject``, ``_parts`` (rows of the subject) and ``_patterns``: covariates, rows, events of each pattern.

    Rows with a missing covariate or outcome are left out; a missing subject is a subject like others.
    """
    counts = sufficient_counts(df, [model, subject], y, xs).withColumn(
        "_subject", F.coalesce(F.concat(F.lit("="), F.col(subject).cast("string")), F.lit(""))
    )
    counts = cut(counts)
    large = cut(
        counts.groupBy(model, "_subject").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        .select(model, "_subject", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    )
    dealt = lookup_join(counts, large, [model, "_subject"], counted_bound(large), "left")
    parts = F.coalesce("_parts", F.lit(1))
    part = F.pmod(F.xxhash64(*xs), parts)
    rows = dealt.groupBy(model, "_subject", parts.alias("_parts"), part.alias("_part")).agg(
        F.first(subject).alias(subject), F.collect_list(F.array(*xs, "n", "events")).alias("_patterns")
    )
    return rows.select(model, subject, "_subject", "_parts", "_patterns")


def quadrature(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rule for exp(-t^2), and the logs of its weights over the root of pi."""
    t, w = np.polynomial.hermite.hermgauss(nodes)
    return t, np.log(w) - 0.5 * np.log(np.pi)


def node_sums(x, n, events, starts, beta, sd, u) -> np.ndarray:
    """Sums over a subject's patterns at each of its nodes: log-likelihood, its slopes and curvatures (terms, subjects, nodes).

    ``starts`` are the subjects' first patterns; ``beta``, ``sd`` and ``u`` have a row per subject.
    """
    k = x.shape[1]
    size = np.diff(np.append(starts, len(x)))
    # The first patterns of all subjects, then the second ones, and so on, longest subjects first: sums are then of whole slices.
    order = np.argsort(-size, kind="stable")
    reach = np.searchsorted(-size[order], -np.arange(size.max()))
    ends = np.cumsum(reach)
    owner = np.concatenate([order[:c] for c in reach])
    rows = starts[owner] + np.repeat(np.arange(len(reach)), reach)
    x, n, events = x[rows], n[rows, None], events[rows, None]
    eta = (x * beta[owner]).sum(axis=1)[:, None] + (sd[:, None] * u)[owner]
    # One exponential, of a number that is never above zero, gives the probability and the logarithm.
    small = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
    r, w = events - n * p, n * p * (1.0 - p)
    sums = np.empty((k * (k + 1) // 2 + 2 * k + 3, *u.shape))

    def add(to: int, t: np.ndarray) -> None:
        total = t[: reach[0]].copy()
        for c, end in zip(reach[1:], ends[1:]):
            total[:c] += t[end - c : end]
        sums[to][order] = total

    add(0, events * eta - n * (np.maximum(eta, 0.0) + np.log1p(small)))
    at = k + 2
    for i in range(k):
        add(1 + i, x[:, [i]] * r)
        weighted = x[:, [i]] * w
        add(len(sums) - 1 - k + i, weighted)
        for j in range(i, k):
            add(at, weighted * x[:, [j]])
            at += 1
    add(k + 1, r)
    add(len(sums) - 1, w)
    return sums


def subject_terms(sums: np.ndarray, logw: np.ndarray, u: np.ndarray, sd: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Log-likelihood, gradient and Hessian of each subject, and mean and variance of its standard normal intercept."""
    a = sums[0] + logw
    top = a.max(axis=1, keepdims=True)
    total = np.exp(a - top).sum(axis=1, keepdims=True)
    share = np.exp(a - top) / total
    v = sd[:, None] * u
    r, w = sums[k + 1], sums[-1]
    g = [*sums[1 : k + 1], v * r]
    h = {}
    at = k + 2
    for i in range(k):
        for j in range(i, k):
            h[i, j] = -sums[at]
            at += 1
    for j in range(k):
        h[j, k] = -v * sums[at + j]
    h[k, k] = -v * v * w + v * r
    shared = [each * share for each in g]
    score = np.stack([each.sum(axis=1) for each in shared])
    curve = np.empty((k + 1, k + 1, len(sd)))
    for i, j in h:
        curve[i, j] = curve[j, i] = np.einsum("sn,sn->s", h[i, j], share) + np.einsum("sn,sn->s", g[i], shared[j]) - score[i] * score[j]
    mean = (u * share).sum(axis=1)
    return {
        "loglik": (top + np.log(total))[:, 0], "score": score.T, "curve": np.moveaxis(curve, 2, 0),
        "mean": mean, "var": np.maximum((u * u * share).sum(axis=1) - mean * mean, 0.0),
    }


def _evaluated(rows: DataFrame, keys: Sequence[str], k: int, nodes: int, per_subject: bool) -> DataFrame:
    """Likelihood terms of subject rows that carry ``_theta`` and their node centres ``_mu``, ``_sd``.

    ``per_subject`` gives a row per subject with its intercept's mean and variance, otherwise subjects of
    one key (``keys``, the model) are summed up within a batch.  Subjects of several rows are put
    together from their node sums first.
    """
    t, lw = quadrature(nodes)
    carried = [*keys, "_subject"] if per_subject else list(keys)
    out = f"{_key_types(rows, carried)}, loglik double, score array<double>, curve array<double>, mean double, var double, subjects double"
    width = k * (k + 1) // 2 + 2 * k + 3

    def at_nodes(batch: pa.RecordBatch):
        mu, spread = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("_mu", "_sd"))
        theta = batch.column("_theta").flatten().to_numpy(zero_copy_only=False).reshape(-1, k + 1)
        u = mu + spread * np.sqrt(2.0) * t
        return theta, u, lw + t * t + np.log(spread) - 0.5 * u * u

    def pattern_sums(batch: pa.RecordBatch, theta: np.ndarray, u: np.ndarray) -> np.ndarray:
        patterns = batch.column("_patterns")
        size = np.array(patterns.value_lengths())
        table = patterns.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, k + 2)
        return node_sums(table[:, :k], table[:, k], table[:, k + 1], np.cumsum(size) - size, theta[:, :k], np.exp(theta[:, k]), u)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            size = np.cumsum(np.array(batch.column("_patterns").value_lengths()) + 1) * len(t) * width
            while at < len(batch):
                stop = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + CELLS, "right")), at + 1)
                yield batch.slice(at, stop - at)
                at = stop

    def told(batch: pa.RecordBatch, sums: np.ndarray, theta, u, logw) -> pa.RecordBatch:
        found = subject_terms(sums, logw, u, np.exp(theta[:, k]), k)
        frame = batch.select(carried).to_pandas()
        arrays = {c: found[c].reshape(len(frame), -1) for c in ("loglik", "score", "curve", "mean", "var")}
        if not per_subject:
            place, frame = pd.factorize(pd.MultiIndex.from_frame(frame)) if len(keys) > 1 else pd.factorize(frame[keys[0]], use_na_sentinel=False)
            added = {c: np.zeros((len(frame), v.shape[1])) for c, v in arrays.items()}
            for c, v in arrays.items():
                np.add.at(added[c], place, v)
            arrays, subjects = added, np.bincount(place, minlength=len(frame)).astype(float)
            frame = frame.to_frame(index=False, name=keys) if len(keys) > 1 else pd.DataFrame({keys[0]: frame})
        else:
            subjects = np.ones(len(frame))
        for c in ("loglik", "mean", "var"):
            frame[c] = arrays[c][:, 0]
        for c in ("score", "curve"):
            frame[c] = list(arrays[c])
        frame["subjects"] = subjects
        return frame[[*carried, "loglik", "score", "curve", "mean", "var", "subjects"]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            theta, u, logw = at_nodes(batch)
            yield pa.RecordBatch.from_pandas(told(batch, pattern_sums(batch, theta, u), theta, u, logw), schema, preserve_index=False)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            theta, u, _ = at_nodes(batch)
            sums = np.moveaxis(pattern_sums(batch, theta, u), 0, 1).reshape(len(batch), -1)
            columns = [batch.column(c) for c in [*keys, "_subject", "_theta", "_mu", "_sd"]]
            ends = pa.array(np.arange(len(batch) + 1) * sums.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[*keys, "_subject", "_theta", "_mu", "_sd", "_sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                theta, u, logw = at_nodes(batch)
                sums = batch.column("_sums").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1, len(t))
                yield pa.RecordBatch.from_pandas(told(batch, np.moveaxis(sums, 1, 0), theta, u, logw), schema, preserve_index=False)

    schema = _arrow_schema(rows, carried)
    held = [*keys, "_subject", "_theta", "_mu", "_sd"]
    single = rows.where(F.col("_parts") == 1).select(*held, "_patterns").mapInArrow(whole, out)
    several = rows.where(F.col("_parts") > 1).select(*held, "_patterns").mapInArrow(parts, f"{_key_types(rows, held)}, _sums array<double>")
    cells = several.select(*held, F.posexplode("_sums").alias("_at", "_v")).groupBy(*held, "_at").agg(F.sum("_v").alias("_v"))
    entry = F.array_sort(F.collect_list(F.struct("_at", "_v")))
    together = cells.groupBy(*held).agg(F.transform(entry, lambda e: e["_v"]).alias("_sums"))
    return single.union(together.mapInArrow(joined, out))


def _arrow_schema(rows: DataFrame, keys: Sequence[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(c, to_arrow_type(rows.schema[c].dataType)) for c in keys]
    fields += [pa.field("loglik", pa.float64()), pa.field("score", pa.list_(pa.float64())), pa.field("curve", pa.list_(pa.float64()))]
    return pa.schema([*fields, *[pa.field(c, pa.float64()) for c in ("mean", "var", "subjects")]])


def _summed(terms: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    m = k + 1
    return terms.groupBy(*keys).agg(
        F.sum("loglik").alias("loglik"), F.sum("subjects").alias("subjects"),
        F.array(*[F.sum(F.col("score")[i]) for i in range(m)]).alias("score"),
        F.array(*[F.sum(F.col("curve")[i]) for i in range(m * m)]).alias("curve"),
    )


def next_point(state: dict, loglik: float, score: np.ndarray, curve: np.ndarray, ridge: float) -> dict:
    """One guarded Newton step of one model.

    A point that lowers the (penalised) likelihood is taken back halfway.  Directions in which the
    likelihood is not concave are turned uphill; no step is longer than ``MAX_STEP``.  The log standard
    deviation stays at ``LEAST_LOG_SD`` while the likelihood falls with it.
    """
    theta, base, move = (np.array(state[c], float) for c in ("theta", "base", "move"))
    value = loglik - 0.5 * ridge * (theta[:-1] ** 2).sum()
    if value < state["base_loglik"] - 1e-9 * (1.0 + abs(value)):
        move = (theta - base) / 2
        return {**state, "theta": base + move, "move": move, "step": float(np.abs(move).max())}
    penalty = np.full(len(theta), ridge)
    penalty[-1] = 0.0
    g, h = score - penalty * theta, -curve + np.diag(penalty)
    free = np.ones(len(theta), bool)
    free[-1] = not (theta[-1] <= LEAST_LOG_SD and g[-1] <= 0)
    values, vectors = np.linalg.eigh(h[np.ix_(free, free)])
    values = np.maximum(np.abs(values), 1e-8)
    inverse = (vectors / values) @ vectors.T
    move, covariance = np.zeros(len(theta)), np.zeros((len(theta), len(theta)))
    move[free] = inverse @ g[free]
    covariance[np.ix_(free, free)] = inverse
    move *= min(1.0, MAX_STEP / max(np.abs(move).max(), 1e-300))
    move[-1] = max(theta[-1] + move[-1], LEAST_LOG_SD) - theta[-1]
    return {**state, "theta": theta + move, "base": theta, "base_loglik": value, "move": move, "covariance": covariance.ravel(), "step": float(np.abs(move).max())}


def _stepped(sums: DataFrame, keys: Sequence[str], k: int, ridge: float) -> DataFrame:
    """The next state of every model; one aggregated row per model passes through Python."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                score, curve = np.array(row.pop("score")), np.array(row.pop("curve")).reshape(k + 1, k + 1)
                rows.append(next_point(row, row.pop("loglik"), score, curve, ridge))
            yield pd.DataFrame(rows, columns=[*keys, *[f.split()[0] for f in STATE.split(", ")]])

    return sums.mapInPandas(step, f"{_key_types(sums, keys)}, {STATE}")


def _with_point(rows: DataFrame, state: DataFrame, keys: Sequence[str], bound: int | None, k: int) -> DataFrame:
    return lookup_join(rows, state.select(*keys, F.col("theta").alias("_theta")), keys, bound, "inner", width=8 * k + 64)


def _climbed(rows, start, keys, k, nodes, bound, max_rounds, tolerance, ridge) -> DataFrame:
    """Rounds until every model's step is below ``tolerance``; models that are there leave."""
    open_, settled = start, []
    for _ in range(max_rounds):
        seen = Observation()
        terms = _summed(_evaluated(_with_point(rows, open_, keys, bound, k), keys, k, nodes, False), keys, k)
        sums = lookup_join(terms, open_.drop("subjects"), keys, bound, "inner", width=8 * (k + 2) ** 2 + 256)
        state = cut(_stepped(sums, keys, k, ridge).observe(seen, F.max("step").alias("step")))
        settled.append(state.where(F.col("step") < tolerance))
        open_ = state.where(F.col("step") >= tolerance)
        if (seen.get["step"] or 0.0) < tolerance:
            return cut(reduce(DataFrame.union, settled))
    return cut(reduce(DataFrame.union, [*settled, open_]))


def mixed_logit(
    df: DataFrame,
    model: str,
    y: str,
    xs: Sequence[str],
    subject: str,
    nodes: int = NODES,
    recentre: int = 0,
    max_rounds: int = 40,
    tolerance: float = 1e-9,
    ridge: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """Fit ``y ~ xs + (1 | subject)`` for every model.  Returns the fits and the subjects' intercepts.

    Fits: ``model``, n, events, subjects, ``theta`` (coefficients, then the log standard deviation of the
    intercept), ``covariance`` (inverse information, row by row), ``loglik``, ``step``, ``converged``.
    Intercepts: ``model``, ``subject``, ``effect`` and ``effect_sd``, posterior mean and standard deviation at the fit.

    Nodes are the same for all subjects, scaled by the standard deviation.  With ``recentre`` they are
    moved that many times to where each subject's posterior lies and the rounds go on from there, which few nodes
    need where a subject has many rows.  ``ridge`` is a weak penalty on the coefficients, as in
    ``logit_fit``, where the rounds start.
    """
    k = len(xs)
    keys = [model]
    rows = cut(subject_rows(df, model, subject, y, xs))
    entry = F.col("_pattern")
    counts = rows.select(model, F.explode("_patterns").alias("_pattern")).select(
        model, *[entry[i].alias(x) for i, x in enumerate(xs)], entry[k].alias("n"), entry[k + 1].alias("events")
    )
    plain = cut(logit_fit(cut(counts.groupBy(model, *xs).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))), keys, xs, ridge=ridge))
    bound = counted_bound(plain)
    point = F.concat("beta", F.array(F.lit(0.0)))
    none = F.lit(None).cast("array<double>")
    state = plain.select(
        model, point.alias("theta"), point.alias("base"), F.lit(float("-inf")).alias("base_loglik"), F.transform(point, lambda _: F.lit(0.0)).alias("move"),
        none.alias("covariance"), "n", "events", F.lit(0.0).alias("subjects"), F.lit(1.0).alias("step"),
    )
    centred = rows.withColumns({"_mu": F.lit(0.0), "_sd": F.lit(1.0)})
    for again in range(recentre + 1):
        state = _climbed(centred, state, keys, k, nodes, bound, max_rounds, tolerance, ridge)
        met = cut(_evaluated(_with_point(centred, state, keys, bound, k), keys, k, nodes, True))
        if again < recentre:
            places = met.select(model, "_subject", F.col("mean").alias("_mu"), F.greatest(F.sqrt("var"), F.lit(1e-3)).alias("_sd"))
            centred = cut(rows.join(places, [model, "_subject"]))
            state = state.withColumns({"base_loglik": F.lit(float("-inf")), "step": F.lit(1.0)})
    # The same step once more, at the point where the rounds ended, for the information there.
    sums = lookup_join(_summed(met, keys, k), state.drop("subjects").withColumn("base_loglik", F.lit(float("-inf"))), keys, bound, "inner", width=8 * (k + 2) ** 2 + 256)
    ended = _stepped(sums, keys, k, ridge)
    loglik = met.groupBy(model).agg(F.sum("loglik").alias("loglik"))
    reached = state.select(model, (F.col("step") < tolerance).alias("converged"))
    fits = ended.join(loglik, model).join(reached, model).select(
        model, "n", "events", "subjects", F.col("base").alias("theta"), "covariance", "loglik", "step", "converged"
    )
    named = rows.groupBy(model, "_subject").agg(F.first(subject).alias(subject))
    sd = F.exp(F.col("theta")[k])
    effects = lookup_join(met.join(named, [model, "_subject"]), state.select(model, "theta"), keys, bound, "inner", width=8 * k + 64).select(
        model, subject, (sd * F.col("mean")).alias("effect"), (sd * F.sqrt("var")).alias("effect_sd")
    )
    return cut(fits), effects


def loglik_at(df: DataFrame, model: str, y: str, xs: Sequence[str], subject: str, points: DataFrame, nodes: int = NODES, bound: int | None = None) -> DataFrame:
    """``model``, ``loglik``, ``score``, ``curve``, ``subjects`` at given ``theta`` (``points``: model, theta), without fitting."""
    rows = subject_rows(df, model, subject, y, xs).withColumns({"_mu": F.lit(0.0), "_sd": F.lit(1.0)})
    placed = _with_point(cut(rows), points, [model], bound, len(xs))
    return _summed(_evaluated(placed, [model], len(xs), nodes, False), [model], len(xs))


def parameter_table(fits: DataFrame, model: str, xs: Sequence[str]) -> DataFrame:
    """One row per coefficient and ``log_sd``: ``model``, ``param``, ``value``, ``std_error``, ``converged``."""
    m = len(xs) + 1
    entries = [
        F.struct(F.lit(x).alias("param"), F.col("theta")[i].alias("value"), F.sqrt(F.col("covariance")[i * m + i]).alias("std_error"))
        for i, x in enumerate([*xs, "log_sd"])
    ]
    return fits.select(model, F.inline(F.array(*entries)), "converged")


def _factor(m: int) -> list[list[Column]]:
    """Lower triangular factor of the covariance, column by column, as expressions; a zero pivot gives a zero column."""
    c = F.col("covariance")
    low: list[list[Column]] = [[F.lit(0.0)] * m for _ in range(m)]
    for j in range(m):
        low[j][j] = F.sqrt(F.greatest(c[j * m + j] - sum((low[j][i] * low[j][i] for i in range(j)), F.lit(0.0)), F.lit(0.0)))
        for r in range(j + 1, m):
            rest = c[r * m + j] - sum((low[r][i] * low[j][i] for i in range(j)), F.lit(0.0))
            low[r][j] = F.when(low[j][j] > 0, rest / low[j][j]).otherwise(0.0)
    return low


def parameter_draws(fits: DataFrame, model: str, xs: Sequence[str], draws: int, seed: int) -> DataFrame:
    """``model``, ``draw`` (0 to ``draws`` - 1) and a column per coefficient (``b_<x>``), from the normal approximation at the fit.

    The normal numbers behind a draw are hashes of seed, model, draw and place, so every task draws the same.
    """
    m = len(xs) + 1
    low = _factor(m)
    factored = fits.select(model, "theta", F.array(*[low[i][j] for i in range(m) for j in range(m)]).alias("_low"))
    drawn = factored.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    drawn = drawn.withColumn("_z", F.array(*[normal_hash(seed, model, "draw", F.lit(i)) for i in range(m)]))
    value = [
        (F.col("theta")[i] + sum((F.col("_low")[i * m + j] * F.col("_z")[j] for j in range(i + 1)), F.lit(0.0))).alias(f"b_{x}") for i, x in enumerate(xs)
    ]
    return drawn.select(model, "draw", *value)


def effect_draws(effects: DataFrame, model: str, subject: str, draws: Sequence[int], seed: int, packed: bool = False) -> DataFrame:
    """``model``, ``subject``, ``draw``, ``effect``: each subject's intercept drawn from its posterior mean and deviation, by hash.

    The normal numbers are those of ``normal_hash``, worked out a batch of subjects at a time.  ``packed`` keeps a
    subject's draws as one array ``draws`` of draw and effect.
    """
    numbers = np.array([int(d) for d in draws], np.int64)
    tails = [f"|{d}|{part}".encode() for d in numbers for part in "ab"]
    text = F.concat_ws("|", F.lit(str(seed)), F.col(model).cast("string"), F.col(subject).cast("string"))
    rows = effects.select(model, subject, "effect", "effect_sd", text.alias("_text"))
    most = max(1, CELLS // max(1, 8 * len(numbers)))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.slice(at, most)
                heads = [t.encode() for t in batch.column("_text").to_pylist()]
                u = unit_numbers([b""], heads, tails).reshape(len(batch), len(numbers), 2)
                z = np.sqrt(-2.0 * np.log(u[:, :, 0] + 0.5 / 4294967296.0)) * np.cos(2.0 * np.pi * u[:, :, 1])
                mean, sd = (batch.column(c).to_pandas().to_numpy(float)[:, None] for c in ("effect", "effect_sd"))
                value = pa.array((mean + sd * z).ravel(), mask=np.repeat(batch.column("effect").is_null().to_numpy(zero_copy_only=False) | batch.column("effect_sd").is_null().to_numpy(zero_copy_only=False), len(numbers)))
                entries = pa.StructArray.from_arrays([pa.array(np.tile(numbers, len(batch))), value], names=["draw", "effect"])
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(numbers))
                yield pa.RecordBatch.from_arrays([batch.column(model), batch.column(subject), pa.ListArray.from_arrays(ends, entries)], names=[model, subject, "draws"])

    found = rows.mapInArrow(drawn, f"{_key_types(rows, [model, subject])}, draws array<struct<draw: bigint, effect: double>>")
    return found if packed else found.select(model, subject, F.inline("draws"))
