"""Everything computed from a table of parameter draws.

A draws table is long: (model, draw, parameter, value).  Where the caller can prove how
many draws a group holds (``draws_bound``), built-in percentiles apply; otherwise quantiles
come from ``quantile_arrays``, which has no limit on the size of a group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, StringType, StructField, StructType

from cohortloom.functions.hashes import unit_numbers
from cohortloom.functions.scalars import inverse_logit, unit_hash, value_label
from cohortloom.plans.joins import lookup_join
from cohortloom.plans.lineage import cut
from cohortloom.plans.ranking import distinct_rows, quantile_arrays

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMMARY = ("estimate", "est_error", "q2_5", "q97_5")


DRAWS_IN_ONE_TASK = 100_000
# Draws per model where the caller names no other bound.
DRAWS_EXPECTED = 4000
#: Tasks that work out the predictions of a packed grid.
GRID_TASKS = 64


def _quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], draws_bound: int | None, group_bound: int | None
) -> DataFrame:
    """One row per group with the wanted quantiles as an array."""
    packed = isinstance(rows.schema[value].dataType, ArrayType)
    if not packed and draws_bound is not None and draws_bound <= DRAWS_IN_ONE_TASK:
        return rows.groupBy(*by).agg(F.percentile(value, F.lit(list(probs))).alias("quantiles"))
    return quantile_arrays(rows, by, value, probs, group_bound).drop("n")


def draws_summary(
    draws: DataFrame,
    by: Sequence[str],
    value: str = "value",
    draws_bound: int | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Mean, standard deviation and 95 % interval per group, and ``exp`` of each as ``_or``.

    Note that ``est_error_or`` is the exponential of a standard error, not the error of an odds ratio.
    """
    by = list(by)
    moments = draws.groupBy(*by).agg(F.avg(value).alias("estimate"), F.stddev_samp(value).alias("est_error"))
    q = _quantiles(draws, by, value, [0.025, 0.975], draws_bound, group_bound)
    bounds = q.select(*by, F.col("quantiles")[0].alias("q2_5"), F.col("quantiles")[1].alias("q97_5"))
    out = moments.join(bounds, by, "left").select(*by, *SUMMARY)
    return out.withColumns({f"{c}_or": F.exp(c) for c in SUMMARY})


def estimates_grid(
    estimates: DataFrame, model: str, param: str, measures: Sequence[str], outcomes: dict[str, str]
) -> DataFrame:
    """Read measure and outcome out of the model name; keep the parameters of that measure."""
    measure = F.regexp_extract(F.col(model), "|".join(measures), 0)
    code = F.regexp_extract(F.col(model), "|".join(sorted(outcomes, key=len, reverse=True)), 0)
    return (
        estimates.withColumns({"measure": measure, "_code": code})
        .where((F.col("measure") != "") & F.contains(F.col(param), F.col("measure")))
        .withColumn("outcome", value_label("_code", outcomes))
        .drop("_code")
    )


def _interval_probs(widths: Sequence[float]) -> list[float]:
    return [p for w in widths for p in ((1 - w) / 2, (1 + w) / 2)]


def median_qi(
    draws: DataFrame,
    by: Sequence[str],
    value: str,
    widths: Sequence[float] = (0.95,),
    draws_bound: int | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Median and central intervals at several widths, one row per group and width.  ``value`` may hold many draws as an array."""
    q = _quantiles(draws, by, value, [0.5, *_interval_probs(widths)], draws_bound, group_bound)
    listed = ", ".join(f"{float(w)!r}D" for w in widths)
    per_width = (
        f"inline(transform(array({listed}), (w, i) -> "
        "named_struct('width', w, 'lower', quantiles[2 * i + 1], 'upper', quantiles[2 * i + 2])))"
    )
    return q.selectExpr(*[f"`{b}`" for b in by], "quantiles[0] AS median", per_width)


def direction_share(draws: DataFrame, by: Sequence[str], value: str, threshold: float = 0.0) -> DataFrame:
    """Share of draws above a threshold (0 for log-odds, 1 for odds ratios)."""
    return draws.groupBy(*by).agg(
        F.count(value).alias("draws"), F.avg((F.col(value) > threshold).cast("double")).alias("share_above")
    )


def binned_density(draws: DataFrame, by: Sequence[str], value: str, low: float, width: float) -> DataFrame:
    """Counts of draws in bins of equal width, counted from ``low``."""
    bin_no = F.floor((F.col(value) - low) / width).cast("long")
    counts = draws.where(F.col(value).isNotNull()).groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("draws"))
    total = F.sum("draws").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.col("draws") / (total * F.lit(width)))


def smooth_density(
    draws: DataFrame,
    by: Sequence[str],
    value: str,
    points: int = 128,
    cut_at: float = 3.0,
    draws_bound: int | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """``point``, ``x``, ``density`` and ``bandwidth``: a Gaussian kernel estimate at ``points`` equally spaced values per group.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5), the sd alone where the quartiles coincide.  The grid reaches
    ``cut_at`` bandwidths beyond the draws.  Each draw is shared by its two neighbours on the grid in proportion to its
    distance from them, which is one aggregation; the kernel then runs over grid points alone, as one array per
    group.  Groups whose draws are all equal, or with a single draw, have no density and no rows.
    """
    by = list(by)
    rows = draws.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    q = _quantiles(rows, by, "_v", [0.25, 0.75], draws_bound, group_bound)
    stats = rows.groupBy(*by).agg(F.count("*").cast("double").alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spread = (F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34
    width = F.when(spread > 0, F.least("_sd", spread)).otherwise(F.col("_sd"))
    shaped = stats.join(q, by).withColumn("bandwidth", 0.9 * width * F.pow("_n", F.lit(-0.2))).where(F.col("bandwidth") > 0)
    first = F.col("_lo") - cut_at * F.col("bandwidth")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut_at * F.col("bandwidth")) / float(points - 1)
    shaped = cut(shaped.select(*by, "_n", "bandwidth", first.alias("_first"), step.alias("_step")))
    placed = lookup_join(rows, shaped, by, group_bound, "inner").withColumn("_at", (F.col("_v") - F.col("_first")) / F.col("_step"))
    left = F.floor("_at")
    shares = F.array(
        F.struct(left.cast("int").alias("bin"), (1.0 - (F.col("_at") - left)).alias("w")), F.struct((left + 1).cast("int").alias("bin"), (F.col("_at") - left).alias("w"))
    )
    bins = placed.select(*by, F.inline(shares)).groupBy(*by, "bin").agg(F.sum("w").alias("w"))
    packed = bins.groupBy(*by).agg(F.collect_list(F.struct("bin", "w")).alias("_bins")).join(shaped, by)
    ratio = F.col("_step") / F.col("bandwidth")

    def at(j: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            z = (b["bin"] - j) * ratio
            return acc + b["w"] * F.exp(-0.5 * z * z)

        total = F.aggregate("_bins", F.lit(0.0), add) / (F.col("_n") * F.col("bandwidth") * math.sqrt(2.0 * math.pi))
        return F.struct(j.alias("point"), (F.col("_first") + F.col("_step") * j).alias("x"), total.alias("density"))

    return packed.select(*by, "bandwidth", F.inline(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)))


def prediction_grid(
    df: DataFrame,
    x: str,
    subject: str,
    model: str,
    models: int,
    n: int = 100,
    levels: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``n`` equally spaced values over each model's range of x, for each of its subjects.

    ``models`` is the proven number of models.  ``levels`` adds a column that runs over given values.
    """
    return unpack_grid(packed_grid(df, x, subject, model, models, n, levels))


def packed_grid(
    df: DataFrame,
    x: str,
    subject: str,
    model: str,
    models: int,
    n: int = 100,
    levels: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The prediction grid with all points of a (model, subject) as one array ``points``."""
    span = df.groupBy(model).agg(F.min(x).cast("double").alias("_low"), F.max(x).cast("double").alias("_high"))
    subjects = df.select(model, subject).distinct()
    step = (F.col("_high") - F.col("_low")) / F.lit(float(max(n - 1, 1)))

    def point(i: Column) -> Column:
        return F.struct(i.alias("point"), (F.col("_low") + step * i).alias(x))

    def at_level(v):
        return lambda i: F.struct(i.alias("point"), (F.col("_low") + step * i).alias(x), F.lit(v).alias(levels[0]))

    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    if levels is None:
        points = F.transform(numbers, point)
    else:
        points = F.flatten(F.array(*[F.transform(numbers, at_level(v)) for v in levels[1]]))
    grid = lookup_join(subjects, span, [model], models, "inner")
    return grid.select(model, subject, points.alias("points"))


def unpack_grid(grid: DataFrame) -> DataFrame:
    return grid.select(*[c for c in grid.columns if c != "points"], F.inline("points"))


def choose_draws(draws: DataFrame, draw: str, total: int, n: int, seed: int) -> DataFrame:
    """Keep the same ``n`` of the draws 0..total-1 for all models, fixed by the seed.

    Draw numbers are ordered by a hash; ``total`` is a setting, not data.
    """
    spark = draws.sparkSession
    picked = (
        spark.range(total)
        .select(F.col("id").alias(draw), unit_hash(seed, F.col("id")).alias("_u"))
        .orderBy("_u", draw)
        .limit(n)
        .select(draw)
    )
    return draws.join(F.broadcast(picked), draw, "left_semi")


def packed_draws(draws: DataFrame, model: str, draw: str, params: Sequence[str]) -> DataFrame:
    """One row per model with its draws as an array, from a wide draws table."""
    entry = F.struct(F.col(draw).alias("_draw"), *[F.col(p).alias(p) for p in params])
    return draws.groupBy(model).agg(F.array_sort(F.collect_list(entry)).alias("_draws"))


def _packed_effects(effects: DataFrame, keys: Sequence[str], draw: str, effect: str) -> DataFrame:
    """One row per key with ``_effects``, an array of ``_draw`` and ``_effect`` by draw."""
    if "draws" in effects.columns:
        entries = F.transform("draws", lambda d: F.struct(d[draw].alias("_draw"), d[effect].cast("double").alias("_effect")))
        return effects.select(*keys, entries.alias("_effects"))
    # A missing key or draw meets nothing, so it need not form a group.
    known = effects.dropna(subset=[*keys, draw])
    entry = F.struct(F.col(draw).alias("_draw"), F.col(effect).cast("double").alias("_effect"))
    return known.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_effects"))


def fitted_draws(
    grid: DataFrame,
    draws: DataFrame,
    model: str,
    draw: str,
    intercept: str | None,
    terms: dict[str, str],
    models: int,
    effects: DataFrame | None = None,
    effect_keys: Sequence[str] = (),
    effect: str = "effect",
    draws_bound: int = DRAWS_EXPECTED,
    packed: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """Predicted probability per grid row and draw; ``packed`` gives those of a grid row as one array, in the order of draws.

    Packed predictions are worked out in numpy, each time they are read; ``numbered`` adds their draws, as an array of the same order.
    What they are worked out from is stored first where a packed grid meets ``effects``.

    ``terms`` maps coefficient columns of the wide draws table to grid columns.  The draws
    of a model travel to the grid as one array per model: by broadcast where ``models`` times
    ``draws_bound`` draws are small, else by a join.  ``effects``
    holds subject or level effects per draw, joined on ``effect_keys`` and the draw.

    A subject's effects travel as one array: the join with them shuffles one row per subject, not one per draw, and is a
    sort-merge join, as Spark takes such arrays for small and would send them through the driver.  ``effects`` may come
    so packed (array column ``draws`` of draw and effect, a row per key with every draw).  A packed grid (array column ``points``) is unpacked last.
    """
    params = [*([intercept] if intercept else []), *terms]
    of_model = packed_draws(draws, model, draw, params)
    if effects is None and "points" in grid.columns:
        # The few bytes of a subject become all its predictions; a table of them would end up in one task.
        grid = grid.repartition(GRID_TASKS, *[c for c in grid.columns if c != "points"])
    if effects is not None:
        number = F.col("_draws._draw")
        once = (F.size(F.array_distinct(number)) == F.size(number)) & ~F.exists(number, lambda d: d.isNull())
        of_model = of_model.withColumn("_once", once)
        grid = grid.join(_packed_effects(effects, effect_keys, draw, effect).hint("merge"), list(effect_keys), "left").select(*grid.columns, "_effects")
        if packed and "points" in grid.columns:
            grid = cut(grid)
    rows = lookup_join(grid, of_model, [model], models, "inner", width=draws_bound * (8 * len(params) + 24))
    if effects is None:
        if not packed:
            rows = rows.select(*grid.columns, F.inline("_draws")).withColumnRenamed("_draw", draw)
    else:
        rows = rows.withColumn("_effect", F.col("_effects._effect"))

        def matched(d: Column) -> Column:
            mine = F.filter("_effects", lambda e: e["_draw"] == d["_draw"])
            found = F.transform(mine, lambda e: F.struct(d.alias("_draws"), e["_effect"].alias("_effect")))
            return F.when(F.size(mine) > 0, found).otherwise(F.array(F.struct(d.alias("_draws"), F.lit(0.0).alias("_effect"))))

        # The same draws in the same order on both sides meet place by place; any others by their number.
        same = F.coalesce(F.col("_once") & (F.col("_effects._draw") == F.col("_draws._draw")), F.lit(False))
        both = F.when(same, F.arrays_zip("_draws", "_effect")).otherwise(F.flatten(F.transform("_draws", matched)))
        kept = [c for c in grid.columns if c != "_effects"]
        if packed:
            rows = rows.select(*kept, both.alias("_both"))
        else:
            rows = rows.select(*kept, F.inline(both)).select(*kept, "_draws.*", F.coalesce("_effect", F.lit(0.0)).alias(effect)).withColumnRenamed("_draw", draw)
    if packed:
        return _packed_predictions(rows, [c for c in grid.columns if c not in ("points", "_effects")], draw, intercept, terms, numbered)
    if "points" in grid.columns:
        rows = unpack_grid(rows)
    eta = F.col(intercept) if intercept else F.lit(0.0)
    for coefficient, column in terms.items():
        eta = eta + F.col(coefficient) * F.col(column)
    if effects is not None:
        eta = eta + F.col(effect)
    kept = [c for c in rows.columns if c not in (*params, draw, effect)]
    return rows.select(*kept, draw, inverse_logit(eta).alias("fitted"))


def _packed_predictions(rows: DataFrame, kept: Sequence[str], draw: str, intercept: str | None, terms: dict[str, str], numbered: bool) -> DataFrame:
    """``kept``, the fields of ``points`` if there are any, and ``fitted``, an array over the row's draws (``_draws``, or ``_both`` with effects)."""
    both, points = "_both" in rows.columns, "points" in rows.columns
    held = rows.schema["_both" if both else "_draws"].dataType.elementType
    number = (held["_draws"].dataType if both else held)["_draw"].dataType
    fields = rows.schema["points"].dataType.elementType.fields if points else []
    names = [*kept, *[f.name for f in fields], *([draw] if numbered else []), "fitted"]
    listed = [StructField("fitted", ArrayType(DoubleType()))]
    schema = StructType([*[rows.schema[c] for c in kept], *fields, *([StructField(draw, ArrayType(number))] if numbered else []), *listed])

    def known(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.float64())
        return column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("_both" if both else "_draws")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        effect = pc.fill_null(pc.struct_field(flat, "_effect"), 0.0).to_numpy(zero_copy_only=False) if both else 0.0
        of_draw = pc.struct_field(flat, "_draws") if both else flat
        columns = {c: batch.column(c) for c in kept}
        row = np.arange(len(batch))
        if points:
            row = np.repeat(row, batch.column("points").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            columns = {c: v.take(pa.array(row)) for c, v in columns.items()}
            at = batch.column("points").flatten()
            columns |= {f.name: pc.struct_field(at, f.name) for f in fields}
        ends = np.append(0, np.cumsum(size[row]))
        place = np.repeat((np.cumsum(size) - size)[row] - ends[:-1], size[row]) + np.arange(ends[-1])
        value, valid = known(pc.struct_field(of_draw, intercept)) if intercept else (np.zeros(len(flat)), np.ones(len(flat), bool))
        total, there = value[place], valid[place]
        for coefficient, column in terms.items():
            (b, b_known), (x, x_known) = known(pc.struct_field(of_draw, coefficient)), known(columns[column])
            total += b[place] * np.repeat(x, size[row])
            there &= b_known[place] & np.repeat(x_known, size[row])
        if both:
            total += effect[place]
        with np.errstate(over="ignore"):
            fitted = pa.array(1.0 / (1.0 + np.exp(-total)), mask=~there)
        arrays = [fitted] if not numbered else [pc.struct_field(of_draw, "_draw").take(pa.array(place)), fitted]
        bounds = pa.array(ends.astype(np.int32))
        return pa.RecordBatch.from_arrays([*columns.values(), *[pa.ListArray.from_arrays(bounds, a) for a in arrays]], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            width = [whole.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (["points"] if points else []) + ["_both" if both else "_draws"]]
            ends, at = np.cumsum(np.prod(width, axis=0) + 1), 0
            while at < len(whole):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PREDICTED, "right")), at + 1)
                yield predicted(whole.slice(at, stop - at))
                at = stop

    return rows.select(*kept, *(["points"] if points else []), "_both" if both else "_draws").mapInArrow(pieces, schema)


def ribbon(
    fitted: DataFrame,
    scales: DataFrame,
    scale_keys: Sequence[str],
    scale_bound: int,
    by: Sequence[str],
    x: str,
    widths: Sequence[float] = (0.5, 0.8, 0.95),
    group_bound: int | None = None,
) -> DataFrame:
    """Intervals of the prediction along x, with x back on its original scale.  ``fitted`` is worked out once and stored, packed predictions are not stored.

    ``scales`` has one row per ``scale_keys`` with ``mean`` and ``sd`` of the censored set.
    """
    rows = fitted.select(*dict.fromkeys([*by, x]), "fitted")
    packed = isinstance(fitted.schema["fitted"].dataType, ArrayType)
    bands = median_qi(rows if packed else cut(rows), [*by, x], "fitted", widths, None, group_bound)
    scaled = lookup_join(bands, scales.select(*scale_keys, "mean", "sd"), list(scale_keys), scale_bound, "inner")
    return scaled.withColumn(f"{x}_raw", F.col(x) * F.col("sd") + F.col("mean")).drop("mean", "sd")


def contrast(
    fitted: DataFrame,
    by: Sequence[str],
    unit: Sequence[str],
    level: str,
    levels: Sequence[str],
    minuend: str,
    subtrahend: str,
    value: str = "fitted",
    width: float = 0.95,
    group_bound: int | None = None,
) -> DataFrame:
    """Median and interval of each level's prediction and of the difference of two levels.

    Differences are taken within a draw of a subject (``unit``), never by row position.  Where ``value`` holds the draws of a row
    as an array, those of a unit's rows meet by their place in it and ``unit`` names no draw.
    """
    bound = None if group_bound is None else group_bound * (len(levels) + 1)
    if isinstance(fitted.schema[value].dataType, ArrayType):
        long = cut(_packed_contrast(fitted, by, unit, level, levels, minuend, subtrahend, value))
        return median_qi(long, [*by, "posterior"], "value", [width], None, bound).withColumnRenamed("median", "estimate")
    at = [F.max(F.when(F.col(level) == F.lit(x), F.col(value))).alias(x) for x in levels]
    wide = fitted.groupBy(*by, *unit).agg(*at)
    wide = wide.withColumn("contrast", F.col(minuend) - F.col(subtrahend))
    long = cut(wide.unpivot([*by], [*levels, "contrast"], "posterior", "value"))
    return median_qi(long, [*by, "posterior"], "value", [width], None, bound).withColumnRenamed("median", "estimate")


def _packed_contrast(
    fitted: DataFrame, by: Sequence[str], unit: Sequence[str], level: str, levels: Sequence[str], minuend: str, subtrahend: str, value: str
) -> DataFrame:
    """``by``, ``posterior`` (a level or ``contrast``) and the array ``value``: a unit's largest prediction per draw and level, and the difference."""
    known = fitted.where(F.col(level).isin(list(levels)) & F.col(value).isNotNull())
    entry = F.struct(F.col(level).cast("string").alias("level"), F.col(value).cast("array<double>").alias("value"))
    units = known.groupBy(*by, *unit).agg(F.collect_list(entry).alias("_levels")).select(*by, "_levels")
    schema = StructType([*[units.schema[b] for b in by], StructField("posterior", StringType()), StructField("value", ArrayType(DoubleType()))])

    def told(labels: list[pa.Array], name: str, values: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        listed = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=~there.ravel()))
        return pa.RecordBatch.from_arrays([*labels, pa.array([name] * len(values), pa.string()), listed], names=[*by, "posterior", "value"])

    def compared(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        entries = batch.column("_levels")
        owner = np.repeat(np.arange(len(batch)), entries.value_lengths().to_numpy(zero_copy_only=False))
        flat = entries.flatten()
        lists, names = pc.struct_field(flat, "value"), np.array(pc.struct_field(flat, "level").to_pylist())
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        numbers = lists.flatten()
        values, there = numbers.to_numpy(zero_copy_only=False).astype(float), numbers.is_valid().to_numpy(zero_copy_only=False)
        starts = np.cumsum(size) - size
        draws_of = np.zeros(len(batch), np.int64)
        draws_of[owner] = size
        if (draws_of[owner] != size).any():
            raise ValueError("predictions of a unit differ in their number of draws")
        for d in np.unique(size):
            units_here = np.flatnonzero(draws_of == d)
            labels = [batch.column(b).take(pa.array(units_here)) for b in by]
            found = {}
            for name in levels:
                rows = np.flatnonzero((size == d) & (names == name))
                places = starts[rows][:, None] + np.arange(d)
                best, given = np.full((len(batch), d), -np.inf), np.zeros((len(batch), d), bool)
                first = np.flatnonzero(np.append(True, np.diff(owner[rows]) > 0)) if len(rows) else rows
                if len(rows):
                    best[owner[rows][first]] = np.maximum.reduceat(np.where(there[places], values[places], -np.inf), first, axis=0)
                    given[owner[rows][first]] = np.logical_or.reduceat(there[places], first, axis=0)
                found[name] = best[units_here], given[units_here]
                yield told(labels, name, *found[name])
            (high, high_given), (low, low_given) = found[minuend], found[subtrahend]
            with np.errstate(invalid="ignore"):
                yield told(labels, "contrast", high - low, high_given & low_given)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            entries = whole.column("_levels")
            inner = pc.struct_field(entries.flatten(), "value").value_lengths().to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(inner))[np.append(0, np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False)))[1:]]
            at = 0
            while at < len(whole):
                stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PREDICTED, "right")), at + 1)
                yield from compared(whole.slice(at, stop - at))
                at = stop

    return units.mapInArrow(pieces, schema)


def pointwise_loglik(
    df: DataFrame, draws: DataFrame, model: str, draw: str, intercept: str | None, terms: dict[str, str], event: str, models: int,
    draws_bound: int = DRAWS_EXPECTED,
) -> DataFrame:
    """Bernoulli log-likelihood of every observation as an array over the model's draws.

    Adds ``loglik`` without a shuffle of the observations.
    """
    params = [*([intercept] if intercept else []), *terms]
    rows = lookup_join(df, packed_draws(draws, model, draw, params), [model], models, "inner", width=draws_bound * (8 * len(params) + 24))

    def one(d: Column) -> Column:
        eta = d[intercept] if intercept else F.lit(0.0)
        for coefficient, column in terms.items():
            eta = eta + d[coefficient] * F.col(column)
        signed = F.when(F.col(event).cast("boolean"), eta).otherwise(-eta)
        # log of the inverse logit, without overflow on either side
        return F.least(signed, F.lit(0.0)) - F.log1p(F.exp(-F.abs(signed)))

    return rows.withColumn("loglik", F.transform("_draws", one)).drop("_draws")


def loglik_arrays(loglik: DataFrame, model: str, obs: Sequence[str], value: str) -> DataFrame:
    """Collect a long log-likelihood table to one array per (model, observation); its length is the number of draws.

    ``value`` may hold a row's draws as an array already; missing ones are left out.
    """
    if isinstance(loglik.schema[value].dataType, ArrayType):
        known = F.filter(F.col(value), lambda v: v.isNotNull())
        return loglik.groupBy(model, *obs).agg(F.flatten(F.collect_list(known)).alias("loglik"))
    return loglik.groupBy(model, *obs).agg(F.collect_list(value).alias("loglik"))


def pointwise_scores(arrays: DataFrame) -> DataFrame:
    """WAIC and importance-sampling LOO terms of each observation from its ``loglik`` array."""
    s = F.size("loglik").cast("double")
    top, low = F.array_max("loglik"), F.array_min("loglik")

    def total(f) -> Column:
        return F.aggregate("loglik", F.lit(0.0), lambda acc, v: acc + f(v))

    scored = arrays.withColumns({"_s": s, "_top": top, "_low": low, "_mean": total(lambda v: v) / s})
    scored = scored.withColumns(
        {
            "lpd": F.col("_top") + F.log(total(lambda v: F.exp(v - F.col("_top"))) / F.col("_s")),
            "p_waic": F.try_divide(total(lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))), F.col("_s") - 1),
            "elpd_loo": F.log(F.col("_s")) + F.col("_low") - F.log(total(lambda v: F.exp(F.col("_low") - v))),
        }
    )
    return scored.withColumn("elpd_waic", F.col("lpd") - F.col("p_waic")).drop("loglik", "_s", "_top", "_low", "_mean")


#: Least number of values in a tail that is smoothed, and weight and centre of the weak prior on its shape.
LEAST_TAIL, SHAPE_WEIGHT, SHAPE_CENTRE = 5, 10.0, 0.5
SMOOTHED = ("pareto_k", "lpd", "p_waic", "elpd_loo", "elpd_waic")
#: Numbers a task holds at once while it scores arrays, and predictions of one batch.
CELLS, PREDICTED = 4 << 20, 1 << 17


def smoothed_scores(arrays: DataFrame) -> DataFrame:
    """``pointwise_scores`` with the tail of the importance weights smoothed, and ``pareto_k``, the shape of that tail.

    The largest min(S / 5, 3 sqrt(S)) of an observation's S weights are replaced by the middle quantiles of a
    generalised Pareto distribution fitted to them (Zhang and Stephens's mean over a grid of scales, with a
    weak prior on the shape), and no weight exceeds the largest raw one.  ``pareto_k`` above 0.7 says that
    the observation's score is unreliable.  It is null where nothing is smoothed: with fewer than ``LEAST_TAIL`` values in the
    tail, or where a quarter of the tail does not exceed the rest.  Arrays of one length are scored together, a batch of rows at a time.
    """
    kept = [c for c in arrays.columns if c != "loglik"]
    schema = StructType([*[arrays.schema[c] for c in kept], *[StructField(c, DoubleType()) for c in SMOOTHED]])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("loglik")
            known = ~listed.is_null().to_numpy(zero_copy_only=False)
            size = np.where(known, listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            if (known & (size == 0)).any():
                raise ValueError("an observation without a log-likelihood has no scores")
            values = listed.flatten()
            starts = np.cumsum(size) - size
            gap = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
            whole = (size > 0) & (gap[starts + size] == gap[starts])
            flat = values.to_numpy(zero_copy_only=False).astype(float)
            found = np.full((len(SMOOTHED), len(batch)), np.nan)
            given = np.zeros(found.shape, bool)
            for s in np.unique(size[whole]):
                rows = np.flatnonzero(whole & (size == s))
                most = max(1, CELLS // (int(s) * 8 + 40 * _tail(int(s))))
                for at in range(0, len(rows), most):
                    some = rows[at : at + most]
                    found[:, some], given[:, some] = smoothed_batch(flat[starts[some][:, None] + np.arange(s)])
            columns = [pa.array(v, mask=~g) for v, g in zip(found, given)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *SMOOTHED])

    return arrays.select(*kept, "loglik").mapInArrow(scored, schema)


def _tail(s: int) -> int:
    return int(min(math.floor(s / 5.0), math.ceil(3.0 * math.sqrt(s))))


def smoothed_batch(loglik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns ``SMOOTHED`` of observations with the same number of draws (rows, draws), and which of them are known."""
    with np.errstate(all="ignore"):
        rows, s = loglik.shape
        top, low, mean = loglik.max(axis=1), np.fmin.reduce(loglik, axis=1), loglik.mean(axis=1)
        lpd = top + np.log(np.exp(loglik - top[:, None]).sum(axis=1) / s)
        p_waic = ((loglik - mean[:, None]) ** 2).sum(axis=1) / (s - 1) if s > 1 else np.full(rows, np.nan)
        # Log weights, ascending; the largest is 0.
        w = np.sort(low[:, None] - loglik, axis=1)
        new, k = w.copy(), np.full(rows, np.nan)
        m = _tail(s)
        if m >= LEAST_TAIL:
            edge = np.exp(w[:, s - m - 1])
            quarter = np.exp(w[:, s - m + math.floor(m / 4.0 + 0.5) - 1]) - edge
            smooth = np.flatnonzero(quarter > 0)
            x, edge, quarter = np.exp(w[smooth, s - m :]) - edge[smooth, None], edge[smooth, None], quarter[smooth]
            points = math.floor(30.0 + math.sqrt(m))
            j = np.arange(1, points + 1)
            b = (1.0 - np.sqrt(points / (j - 0.5))) / (3.0 * quarter[:, None]) + 1.0 / x[:, -1:]
            inner = -b[:, :, None] * x[:, None, :]
            shape = np.where((inner <= -1.0).any(axis=2), np.nan, np.log1p(inner).mean(axis=2))
            ratio = np.where(shape == 0.0, np.nan, -b / shape)
            level = np.where(ratio > 0, m * (np.log(ratio) - shape - 1.0), np.nan)
            weight = np.exp(level - level.max(axis=1, keepdims=True))
            b = (weight * b).sum(axis=1) / weight.sum(axis=1)
            inner = -b[:, None] * x
            raw = np.where((inner <= -1.0).any(axis=1), np.nan, np.log1p(inner).mean(axis=1))
            found = (raw * m + SHAPE_WEIGHT * SHAPE_CENTRE) / (m + SHAPE_WEIGHT)
            sigma = np.where(b == 0.0, np.nan, -raw / b)[:, None]
            above = sigma * np.where(found[:, None] == 0.0, np.nan, np.expm1(-found[:, None] * np.log1p(-(np.arange(m) + 0.5) / m)) / found[:, None])
            # No weight exceeds the largest raw one, nor does one that cannot be worked out.
            value = np.where(above + edge > 0, np.minimum(np.log(above + edge), 0.0), 0.0)
            k[smooth] = found
            new[smooth, s - m :] = np.where(np.isnan(found)[:, None], new[smooth, s - m :], value)
        # A draw's likelihood is exp(low - w) for its raw log weight w.
        loo = low + np.log(np.exp(new - w).sum(axis=1) / np.exp(new).sum(axis=1))
        out = np.stack([k, lpd, p_waic, loo, lpd - p_waic])
    given = np.ones(out.shape, bool)
    given[0] = ~np.isnan(k)
    given[[2, 4]] = s > 1
    return out, given


def compare_models(scores: DataFrame, model: str, obs: Sequence[str], criterion: str = "elpd_loo") -> DataFrame:
    """Rank models by summed ``criterion`` and compare each with the best, observation by observation.

    ``scores`` is the result of ``pointwise_scores`` for models that share their observations.
    It is stored first, as it is costly to work out and read more than once.
    """
    scores = cut(scores)
    sums = scores.groupBy(model).agg(
        F.count("*").alias("observations"),
        F.sum("elpd_waic").alias("elpd_waic"),
        F.sum("p_waic").alias("p_waic"),
        (F.lit(-2.0) * F.sum("elpd_waic")).alias("waic"),
        F.sum("elpd_loo").alias("elpd_loo"),
        F.sum(F.col("lpd") - F.col("elpd_loo")).alias("p_loo"),
        F.sqrt(F.count("*") * F.var_samp(criterion)).alias("se"),
    )
    best = sums.orderBy(F.desc(criterion), F.asc(model)).limit(1).select(model)
    # An observation has one score per model, so this window holds a handful of rows.
    mine = scores.select(model, *obs, F.col(criterion).alias("_e")).withColumn("_best", best.scalar())
    w = Window.partitionBy(*obs)
    against = mine.withColumn("_d", F.col("_e") - F.max(F.when(F.col(model) == F.col("_best"), F.col("_e"))).over(w))
    differences = against.groupBy(model).agg(
        F.sum("_d").alias("elpd_diff"), F.sqrt(F.count("*") * F.var_samp("_d")).alias("se_diff")
    )
    return sums.join(differences, model).orderBy(F.desc(criterion), F.asc(model))


def predictive_check(
    fitted: DataFrame, by: Sequence[str], draw: str, obs: Sequence[str], event: str, seed: int, value: str = "fitted"
) -> DataFrame:
    """Replicated and observed event rate per draw.

    An outcome is replicated by comparing the fitted probability with a uniform number that
    depends on seed, draw and observation only.  ``value`` may hold an observation's predictions as an array and ``draw`` their draws, numbers or text.
    """
    if isinstance(fitted.schema[value].dataType, ArrayType):
        return _packed_check(fitted, by, draw, obs, event, seed, value)
    u = unit_hash(seed, draw, *obs)
    return fitted.groupBy(*by, draw).agg(
        F.avg((u < F.col(value)).cast("double")).alias("replicated_rate"),
        F.avg(F.col(event).cast("double")).alias("observed_rate"),
        F.avg(value).alias("expected_rate"),
    )


def _packed_check(fitted: DataFrame, by: Sequence[str], draw: str, obs: Sequence[str], event: str, seed: int, value: str) -> DataFrame:
    """``predictive_check`` of arrays: the hashes of ``unit_hash``, and a task's sums per group and draw of a batch."""
    number = fitted.schema[draw].dataType.elementType
    if not isinstance(number, (IntegralType, StringType)):
        raise TypeError(f"packed draws are numbered by {number.simpleString()}")
    # Null values are no part of the hashed text, nor is their separator.
    text = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in obs])
    rows = fitted.select(*by, draw, F.col(value).cast("array<double>").alias("_value"), F.col(event).cast("double").alias("_event"), text.alias("_text"))
    sums = ["_replicated", "_observed", "_expected", "_known", "_seen"]
    schema = StructType([*[rows.schema[b] for b in by], StructField(draw, number), *[StructField(c, DoubleType()) for c in sums]])

    def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, listed = batch.column(draw), batch.column("_value")
        size = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if (numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) != size).any():
            raise ValueError("predictions and their draws differ in number")
        codes = numbers.flatten().dictionary_encode(null_encoding="encode")
        labels, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        heads = [str(seed).encode() if d is None else f"{seed}|{d}".encode() for d in labels.to_pylist()]
        tails = [t.encode() for t in batch.column("_text").to_pylist()]
        row = np.repeat(np.arange(len(batch)), size)
        if len(heads) * len(tails) <= 4 * len(code):
            u = unit_numbers(heads, tails)[code, row, 0]
        else:
            # Rows of different draws: far fewer pairs than rows times draws.
            u = np.array([unit_numbers([heads[c]], [tails[r]])[0, 0, 0] for c, r in zip(code.tolist(), row.tolist())])
        flat = listed.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        fit = np.where(known, flat.to_numpy(zero_copy_only=False).astype(float), 0.0)
        seen = batch.column("_event").is_valid().to_numpy(zero_copy_only=False)
        happened = np.where(seen, batch.column("_event").to_numpy(zero_copy_only=False), 0.0)
        groups, owner = distinct_rows(pa.Table.from_batches([batch.select(by)]).append_column("_all", pa.array(np.zeros(len(batch), np.int8))))
        cell = owner[row] * len(labels) + code
        # A NaN is above every number.
        parts = [known & ((u < fit) | np.isnan(fit)), happened[row], fit, known, seen[row]]
        added = [np.bincount(cell, p.astype(float), minlength=len(groups) * len(labels)) for p in parts]
        here = np.flatnonzero(np.bincount(cell, minlength=len(groups) * len(labels)))
        named = groups.select(by).take(pa.array(here // max(1, len(labels)))).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in named.columns]
        return pa.RecordBatch.from_arrays([*columns, labels.take(pa.array(here % max(1, len(labels)))), *[pa.array(a[here]) for a in added]], names=[*by, draw, *sums])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(whole.column("_value").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(whole):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PREDICTED, "right")), at + 1)
                yield checked(whole.slice(at, stop - at))
                at = stop

    total = rows.mapInArrow(pieces, schema).groupBy(*by, draw).agg(*[F.sum(c).alias(c) for c in sums])
    return total.select(
        *by, draw, F.try_divide("_replicated", "_known").alias("replicated_rate"), F.try_divide("_observed", "_seen").alias("observed_rate"),
        F.try_divide("_expected", "_known").alias("expected_rate"),
    )


def predictive_check_summary(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Interval of the replicated rate over draws, and share of draws at or above the observed rate."""
    q = F.percentile("replicated_rate", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = checks.groupBy(*by).agg(
        F.first("observed_rate").alias("observed_rate"),
        q.alias("_q"),
        F.avg((F.col("replicated_rate") >= F.col("observed_rate")).cast("double")).alias("share_at_or_above"),
    )
    return out.select(
        *by, "observed_rate", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("upper"), "share_at_or_above",
    )
