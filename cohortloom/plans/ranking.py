"""Exact quantiles and mid-ranks of groups of any size.

Built-in ``percentile`` keeps every distinct value of a group in one task, and a rank
window sorts a whole group in one task.  Both stop working once a group (a measure over
the whole cohort) holds a large part of the data.

``exact_quantiles`` brackets each wanted rank with a sketch, keeps exact values only inside
the brackets and mere counts outside, and reads the exact order statistics from what is left.
What is left grows with the data; it is summed up in sorted ranges, never in one task.  A rank
outside its bracket widens the brackets and counts again.

Values that come as arrays are counted by the leading bits of their keys, in numpy, and those of the few cells that
hold a wanted rank once more, as they are.  Cells are exact, so no rank is ever outside its own.

``midrank_counts`` cuts the value range into blocks of about equal size, ranks distinct
values inside each block and adds the number of rows in the blocks before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cohortloom.plans.joins import fits_broadcast, lookup_join
from cohortloom.plans.lineage import cut

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ACCURACY = 10_000
# A group of at most this many values per unit of accuracy is ranked whole.  Above it, the bracket
# margin is worth several ranks more than the error of the sketch.
WHOLE_GROUP = 2
# Rows that one window task sorts at most when counts are summed up in value order.
WINDOW_ROWS = 1_000_000
# Rows per block of a ranking; more blocks than the second number make the sketch of their edges large.
BLOCK_ROWS, MOST_BLOCKS = 100_000, 16_384
# Low bits of a key that the first, second and last count of values in arrays leave out.  The second is skipped
# where at most ``KEPT_VALUES`` values share a cell with a wanted rank.
SHIFTS, KEPT_VALUES = (42, 32, 0), 1 << 26
# Cells of a task's counts, those of a table that has a place for each, and values counted at once, few enough for the processor's cache.
CELLS, DENSE, COUNTED = 4 << 20, 1 << 20, 1 << 17


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    group_bound: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group; nulls are left out.

    ``quantiles`` maps result columns to probabilities.  ``group_bound`` is a proven upper
    bound on the number of groups, when there is one.  Returns ``by``, ``n`` and the
    quantile columns; a group without values has no row.
    """
    probs = list(quantiles.values())
    found = quantile_arrays(df, by, value, probs, group_bound, accuracy)
    return found.select(*by, "n", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(quantiles)])


def quantile_arrays(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    group_bound: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``by``, ``n`` and an array ``quantiles`` in the order of ``probs``.

    ``value`` may be an array column: all values of a group's arrays are ranked together.  ``df`` is then read two or three times.
    """
    by = list(by)
    wanted, probs = list(probs), sorted(set(probs))
    if isinstance(df.schema[value].dataType, ArrayType):
        hits = _hits(_array_cells(df, by, value, probs, group_bound), by, probs)
    else:
        hits = _bracketed_hits(df, by, value, probs, group_bound, accuracy)
    bounds = [
        f"CASE WHEN _upto >= {r} AND _from < {r} THEN _kept END AS {name}"
        for name, r in (("_a", "least(floor((n - 1) * p) + 1, n)"), ("_b", "least(floor((n - 1) * p) + 2, n)"))
    ]
    stats = (
        hits.selectExpr(*[f"`{b}`" for b in by], "n", "i", "p", *bounds)
        .groupBy(*by, "n", "i", "p")
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    h = (F.col("n") - 1) * F.col("p")
    share = h - F.floor(h)
    # Weights rather than a difference, which infinite neighbours do not have.
    between = F.col("_a") * (1 - share) + F.col("_b") * share
    q = F.when((F.col("_a") == F.col("_b")) | (share == 0), F.col("_a")).otherwise(between)
    found = stats.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("_q"))
    places = ", ".join(str(probs.index(p)) for p in wanted)
    return found.selectExpr(*[f"`{b}`" for b in by], "n", f"transform(array({places}), k -> _q[k].q) AS quantiles")


def _bracketed_hits(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], group_bound: int | None, accuracy: int
) -> DataFrame:
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    rows = rows.withColumn("_times", F.lit(1).cast("long"))
    if by and not fits_broadcast(group_bound, 16 * len(probs) + 64):
        # Equal values would all get the same salt, so they are counted before the salted join.
        rows = rows.groupBy(*by, "_v").agg(F.sum("_times").alias("_times"))
    while True:
        cells = cut(_cells(rows, by, probs, group_bound, accuracy, margin))
        hits = _hits(cells, by, probs)
        if margin >= 1.0 or not hits.where("_kept IS NULL").limit(1).count():
            break
        # A rank outside its bracket: the sketch was off by more than its margin.
        margin *= 16
    return hits


def _cells(
    rows: DataFrame, by: Sequence[str], probs: Sequence[float], group_bound: int | None, accuracy: int, margin: float
) -> DataFrame:
    """Counts ``_c`` of values inside a bracket (``_kept``) and, per gap between brackets, of all others (null)."""
    edges = _brackets(rows, by, probs, accuracy, margin)
    if by:
        # A sketch that is worked out again after a lost executor may differ; stored edges do not.
        edges = cut(edges)
        # Null group labels must meet their own bracket, so the key is null-safe text.
        keyed, keys = _null_safe(rows, by)
        edge_rows, _ = _null_safe(edges, by)
        joined = lookup_join(keyed, edge_rows.drop(*by), keys, group_bound, "inner", width=16 * len(probs) + 64).drop(*keys)
    else:
        packed = edges.select(F.struct("_lo", "_hi").alias("e"))
        joined = rows.withColumn("_e", packed.scalar()).select("_v", "_times", "_e._lo", "_e._hi")
    # The first bracket that does not end below the value is the only one that may hold it.
    return (
        count_below(joined, "_hi", len(probs), "_v", "_j")
        .select(*by, "_j", F.when(F.get("_lo", F.col("_j")) <= F.col("_v"), F.col("_v")).alias("_kept"), "_times")
        .groupBy(*by, "_j", "_kept")
        .agg(F.sum("_times").alias("_c"))
    )


def _hits(cells: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The cells that hold a wanted order statistic, with their ranks (``_from``, ``_upto``] and the group's size ``n``."""
    ranked = running_sum(cells, by, ["_j", "_kept"], "_c", "_upto", "n")
    return ranked.selectExpr(*[f"`{b}`" for b in by], "n", "_kept", "_upto - _c AS _from", "_upto", f"inline({_held_ranks(probs)})")


def _held_ranks(probs: Sequence[float]) -> str:
    """The probabilities (``i``, ``p``) for which a cell holds the order statistic below or the one above."""
    literals = ", ".join(f"{p!r}D" for p in probs)
    targets = f"transform(array({literals}), (p, i) -> named_struct('i', i, 'p', p))"
    rank = "least(floor((n - 1) * t.p) + {up}, n)"
    return f"filter({targets}, t -> _upto >= {rank.format(up=1)} AND _upto - _c < {rank.format(up=2)})"


def _array_cells(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], group_bound: int | None) -> DataFrame:
    """Counts ``_c`` of equal values (``_kept``) near the wanted ranks and, elsewhere, of the values of a cell (null), in the order of ``_j``."""
    rows = df.select(*by, F.col(value).cast("array<double>").alias("_values"))
    names = [f"`{b}`" for b in by]
    keyed, keys = _null_safe(rows, by)
    cells = cut(_array_counts(rows, by, SHIFTS[0], None))
    before = SHIFTS[0]
    while before:
        ranked = running_sum(cells, by, ["_j", "_kept"], "_c", "_upto", "n")
        marked = cut(ranked.selectExpr(*names, "_j", "_kept", "_c", f"size({_held_ranks(probs)}) > 0 AS _hit"))
        hit = marked.where("_hit")
        near = hit.agg(F.sum("_c")).first()[0] or 0
        shift = SHIFTS[1] if before == SHIFTS[0] and near > KEPT_VALUES else SHIFTS[-1]
        wanted = hit.groupBy(*by).agg(F.sort_array(F.collect_list("_j")).alias("_wanted"))
        if by:
            marks, _ = _null_safe(cut(wanted), by)
            placed = lookup_join(keyed, marks.drop(*by), keys, group_bound, "inner", width=16 * len(probs) + 64).drop(*keys)
        else:
            placed = rows.withColumn("_wanted", wanted.scalar())
        cells = cut(marked.where("NOT _hit").drop("_hit").unionByName(_array_counts(placed, by, shift, before)))
        before = shift
    return cells


def _order_keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: one for both zeros, one for all NaN, above infinity."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    return _turned(values.view(np.int64))


def _turned(keys: np.ndarray) -> np.ndarray:
    return keys ^ ((keys >> 63) & np.iinfo(np.int64).max)


def distinct_rows(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The distinct rows of a table, and for each row the number of its own."""
    groups = table.append_column("_row", pa.array(np.arange(len(table)))).group_by(table.column_names, use_threads=False).aggregate([("_row", "list")])
    listed = groups.column("_row_list").combine_chunks()
    number = np.empty(len(table), np.int64)
    number[listed.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), listed.value_lengths().to_numpy())
    return groups.select(table.column_names), number


def _array_counts(rows: DataFrame, by: Sequence[str], shift: int, before: int | None) -> DataFrame:
    """Counts ``_c`` of the values of ``_values`` by ``_j``, their key without its ``shift`` last bits; ``_kept`` is the value itself if ``shift`` is 0.

    After a first count only the values are counted whose key without ``before`` bits is in ``_wanted``.  A task passes its
    counts on when they grow large.
    """
    by = list(by)
    schema = StructType([*[rows.schema[b] for b in by], StructField("_j", LongType()), StructField("_kept", DoubleType()), StructField("_c", LongType())])

    def in_batch(batch: pa.RecordBatch):
        listed = batch.column("_values")
        size = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = listed.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(float)
        groups, owner = distinct_rows(pa.Table.from_batches([batch.select(by)]).append_column("_all", pa.array(np.zeros(len(batch), np.int8))))
        group = np.repeat(owner, size)
        if flat.null_count:
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            values, group = values[known], group[known]
        key = _order_keys(values)
        if before is not None:
            # A group's rows hold the same list; the first row's stands for all.
            first = np.full(len(groups), len(batch))
            np.minimum.at(first, owner, np.arange(len(batch)))
            lists = batch.column("_wanted").take(pa.array(first))
            marks = np.repeat(np.arange(len(groups)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) << 32
            marks = marks + (lists.flatten().to_numpy(zero_copy_only=False) >> before) + (1 << 31)
            mine = (group << 32) + (key >> before) + (1 << 31)
            near = np.flatnonzero(np.append(marks, -1)[np.searchsorted(marks, mine)] == mine)
            key, group = key[near], group[near]
        return groups, group, key >> shift

    def added(group: np.ndarray, place: np.ndarray, count: np.ndarray):
        order = np.lexsort((place, group))
        group, place, count = group[order], place[order], count[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])))
        return group[first], place[first], np.add.reduceat(count, first)

    def together(held: list):
        groups, number = distinct_rows(pa.concat_tables([h[0] for h in held]))
        ends = np.cumsum([len(h[0]) for h in held])
        group = np.concatenate([number[h[1] + end - len(h[0])] for h, end in zip(held, ends)])
        return groups, *added(group, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))

    def told(groups: pa.Table, group: np.ndarray, place: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(place), 1 << 16):
            some = slice(at, at + (1 << 16))
            labels = groups.select(by).take(pa.array(group[some])).combine_chunks()
            kept = pa.nulls(len(place[some]), pa.float64()) if shift else pa.array(_turned(place[some]).view(np.float64))
            columns = [*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in labels.columns], pa.array(place[some] << shift), kept, pa.array(count[some])]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "_j", "_kept", "_c"])

    def sparse(table):
        groups, low, counts = table
        group, place = np.nonzero(counts)
        return groups, group, place + low, counts[group, place]

    def wider(table, groups: pa.Table, place: np.ndarray):
        """The table with a place for every cell of a batch, and the batch's groups by their place; None if it would be too large."""
        low, stop = int(place.min()), int(place.max()) + 1
        number = np.arange(len(groups))
        if table is not None:
            both, number = distinct_rows(pa.concat_tables([table[0], groups]))
            mine, number = number[: len(table[0])], number[len(table[0]) :]
            width = table[2].shape[1]
            if len(both) == len(table[0]) and low >= table[1] and stop <= table[1] + width:
                return (both, table[1], table[2] if (np.diff(mine) == 1).all() else table[2][np.argsort(mine)]), number
            low, stop, groups = min(low, table[1]), max(stop, table[1] + width), both
        if len(groups) * (stop - low) > DENSE:
            return None
        counts = np.zeros((len(groups), stop - low), np.int64)
        if table is not None:
            counts[mine, table[1] - low : table[1] - low + width] = table[2]
        return (groups, low, counts), number

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, cells = None, [], 0
        for whole in batches:
            ends = np.cumsum(whole.column("_values").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(whole):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")), at + 1)
                groups, group, place = in_batch(whole.slice(at, stop - at))
                at = stop
                if not len(place):
                    continue
                fits = wider(table, groups, place)
                if fits:
                    table, number = fits
                    groups, low, counts = table
                    counts += np.bincount(number[group] * counts.shape[1] + (place - low), minlength=counts.size).reshape(counts.shape)
                    continue
                held.append((groups, *added(group, place, np.ones(len(place), np.int64))))
                cells += len(held[-1][1])
                if cells > CELLS:
                    held = [together(held)]
                    cells = len(held[0][1])
                    if cells > CELLS // 2:
                        yield from told(*held.pop())
                        cells = 0
        if table is not None:
            held.append(sparse(table))
        if held:
            yield from told(*together(held))

    held_columns = [*by, "_values"] if before is None else [*by, "_values", "_wanted"]
    return rows.select(*held_columns).mapInArrow(counted, schema).groupBy(*by, "_j", "_kept").agg(F.sum("_c").alias("_c"))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, upto: str, total: str) -> DataFrame:
    """``value`` summed up along ``order`` in each group (``upto``), and over the group (``total``).

    ``df`` is a stored table.  Up to ``WINDOW_ROWS`` rows a window does it.  Beyond, rows are
    sorted into ranges of about so many rows; sums run inside a range and along the ranges, so no task
    holds a group.
    """
    n = df.count()
    in_order = [F.asc_nulls_first(c) for c in order]
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if n <= WINDOW_ROWS:
        along = whole.orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({upto: F.sum(value).over(along), total: F.sum(value).over(whole)})
    ranges = -(-n // WINDOW_ROWS)
    keys = [F.asc_nulls_first(c) for c in by]
    placed = cut(df.repartitionByRange(ranges, *keys, *in_order).withColumn("_range", F.spark_partition_id()))
    group = [F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")).alias(f"_g{i}") for i, b in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    keyed = placed.select("*", *group)
    sums = keyed.groupBy(*names, "_range").agg(F.sum(value).alias("_sum"))
    per_group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = per_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(before), F.lit(0)), total: F.sum("_sum").over(per_group)}).drop("_sum")
    inside = Window.partitionBy("_range", *names).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(starts, ["_range", *names]).withColumn(upto, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_range", *names)


def count_below(df: DataFrame, edges: str, k: int, value: str, out: str) -> DataFrame:
    """Number of the ``k`` sorted edges that are smaller than the value, by binary search.

    Each halving is a projection of its own, so the generated code stays short.
    """
    size = 1 << k.bit_length()
    padded = f"concat(`{edges}`, array_repeat(double('inf'), {size - 1 - k}))" if size - 1 > k else f"`{edges}`"
    df = df.withColumn("_padded", F.expr(padded)).withColumn(out, F.lit(0))
    while size > 1:
        size //= 2
        df = df.withColumn(out, F.expr(f"`{out}` + CASE WHEN get(_padded, `{out}` + {size - 1}) < `{value}` THEN {size} ELSE 0 END"))
    return df.drop("_padded")


def _brackets(rows: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int, margin: float) -> DataFrame:
    lower = [max(0.0, p - margin) for p in probs]
    upper = [min(1.0, p + margin) for p in probs]
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx("_v", [*lower, *upper], accuracy).alias("_s"),
        (F.count("*") <= WHOLE_GROUP * accuracy).alias("_small"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    k = len(probs)
    first = ", ".join("_min" if p == 0.0 else f"_s[{i}]" for i, p in enumerate(lower))
    last = ", ".join("_max" if p == 1.0 else f"_s[{k + i}]" for i, p in enumerate(upper))
    return sketch.selectExpr(
        *[f"`{b}`" for b in by],
        f"CASE WHEN _small THEN array_repeat(_min, {k}) ELSE array({first}) END AS _lo",
        f"CASE WHEN _small THEN array_repeat(_max, {k}) ELSE array({last}) END AS _hi",
    )


def _null_safe(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [f"_k{i}" for i in range(len(by))]
    return (
        df.withColumns(
            {k: F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")) for k, b in zip(keys, by)}
        ),
        keys,
    )


def midrank_counts(
    df: DataFrame, by: str, value: str, counts: dict[str, Column], levels: int, blocks: int | None = None
) -> DataFrame:
    """Distinct values per ``by`` with their mid-rank, tie count and extra counts.

    ``levels`` is the proven number of distinct ``by`` values (for example the number of
    unpivoted measures).  Blocks are as many as keep them near ``BLOCK_ROWS`` rows, unless
    their number is given.  The block edges are written out before use, so that the
    row branch and the block-total branch see the same edges.
    """
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("ties"), *[c.alias(n) for n, c in counts.items()])
    )
    if blocks is None:
        blocks = min(MOST_BLOCKS, max(2, -(-df.count() // BLOCK_ROWS)))
    probs = [i / blocks for i in range(1, blocks)]
    edges = cut(
        df.where(F.col(value).isNotNull())
        .groupBy(by)
        .agg(F.percentile_approx(F.col(value).cast("double"), probs, 4 * blocks).alias("_edges"))
    )
    joined = lookup_join(distinct, edges, [by], levels, "inner")
    placed = count_below(joined, "_edges", blocks - 1, "_v", "_block").drop("_edges")
    totals = placed.groupBy(by, "_block").agg(F.sum("ties").alias("_rows"))
    w = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(by, "_block", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(by, "_block").orderBy("_v")
    upto = F.sum("ties").over(inner)
    return placed.join(before, [by, "_block"]).select(
        by,
        F.col("_v").alias(value),
        "ties",
        *counts,
        (F.col("_before") + upto - F.col("ties") + (F.col("ties") + 1) / 2.0).alias("midrank"),
    )
