"""Describing outcomes and the cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.pvalues import chi_square_p, exact_table_p, fisher_p, normal_p
from cohortloom.functions.scalars import period_of, period_rank
from cohortloom.operators.shape import to_long
from cohortloom.plans.joins import lookup_join
from cohortloom.plans.ranking import exact_quantiles, midrank_counts

OVERALL = "overall"


def first_event_rollup(df: DataFrame, subject: str, day: str, flags: Sequence[str]) -> DataFrame:
    """Per subject and flag: ``any_<flag>`` and ``<flag>_day``, the first flagged day or else the last day."""
    aggs = [F.max(day).alias("_last")]
    for flag in flags:
        aggs += [
            F.coalesce(F.bool_or(flag), F.lit(False)).alias(f"any_{flag}"),
            F.min(F.when(F.col(flag), F.col(day))).alias(f"{flag}_day"),
        ]
    out = df.groupBy(subject).agg(*aggs)
    return out.withColumns({f"{f}_day": F.coalesce(f"{f}_day", "_last") for f in flags}).drop("_last")


def _definitions(rollup: DataFrame, subject: str, flags: Sequence[str]) -> DataFrame:
    """One row per subject and definition, with its yes/no and its day on the same row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("definition"),
                F.col(f"any_{f}").alias("occurred"),
                F.col(f"{f}_day").cast("double").alias("days"),
            )
            for f in flags
        ]
    )
    return rollup.select(subject, F.explode(entries).alias("_e")).select(subject, "_e.*")


def definition_prevalence(rollup: DataFrame, subject: str, flags: Sequence[str]) -> DataFrame:
    """Number of subjects by definition and yes/no."""
    return (
        _definitions(rollup, subject, flags)
        .groupBy("definition", "occurred")
        .agg(F.count("*").alias("subjects"))
    )


def time_to_event_summary(rollup: DataFrame, subject: str, flags: Sequence[str]) -> DataFrame:
    """Days to the event (or exit) by definition and yes/no: n, mean, sd, median, IQR.

    The label carries the number of subjects with the event.
    """
    long = _definitions(rollup, subject, flags)
    groups, bound = ["definition", "occurred"], 2 * len(flags)
    moments = long.groupBy(*groups).agg(
        F.count("*").alias("subjects"), F.avg("days").alias("mean"), F.stddev_samp("days").alias("sd")
    )
    quartiles = exact_quantiles(long, groups, "days", {"q1": 0.25, "median": 0.5, "q3": 0.75}, bound)
    joined = moments.join(quartiles.drop("n"), groups, "left")
    events = F.sum(F.when(F.col("occurred"), F.col("subjects")).otherwise(0)).over(
        Window.partitionBy("definition")
    )
    return joined.select(
        F.concat("definition", F.lit(" ("), events.cast("string"), F.lit(" subjects)")).alias("definition"),
        "occurred", "subjects", "mean", "sd", "median", (F.col("q3") - F.col("q1")).alias("iqr"),
    )


def frequency(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Counts of a column's values, most frequent first, then by value."""
    return df.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(col))


def same_day_concordance(
    cultures: DataFrame, samples: DataFrame, keys: Sequence[str], organism: str, dominant: str
) -> DataFrame:
    """Per subject and date with a culture and a dominant taxon: does any cultured organism match it?

    Both sides become (keys, name) marks that are combined by aggregation; nothing is joined.
    """
    marks = cultures.select(*keys, F.col(organism).alias("_name"), F.lit(True).alias("_grown")).unionByName(
        samples.where(F.col(dominant).isNotNull()).select(*keys, F.col(dominant).alias("_name"), F.lit(False).alias("_grown"))
    )
    names = marks.groupBy(*keys, "_name").agg(
        F.bool_or("_grown").alias("_c"), F.bool_or(~F.col("_grown")).alias("_d")
    )
    dates = names.groupBy(*keys).agg(
        F.bool_or(F.col("_c") & F.col("_d")).alias("any_match"),
        F.bool_or("_c").alias("_any_c"),
        F.bool_or("_d").alias("_any_d"),
    )
    return dates.where(F.col("_any_c") & F.col("_any_d")).select(*keys, "any_match")


def specimen_totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Number of non-null values per measure."""
    counts = df.agg(*[F.count(m).alias(m) for m in measures])
    return counts.unpivot([], list(measures), "measure", "specimens")


def period_activity(
    df: DataFrame,
    subject: str,
    day: str,
    measures: Sequence[str],
    periods: Sequence[tuple[str, int, int | None]],
) -> DataFrame:
    """Distinct subjects and specimens per measure and period.

    Rows are first counted per (measure, period, subject), so that the distinct count is a
    count of groups and no subject set is held in memory.
    """
    long = to_long(df, [subject, day], measures).select(
        "measure", subject, period_of(day, periods).alias("period"), period_rank(day, periods).alias("period_order")
    )
    per_subject = long.groupBy("measure", "period", "period_order", subject).agg(F.count("*").alias("_n"))
    return per_subject.groupBy("measure", "period", "period_order").agg(
        F.count(subject).alias("subjects"), F.sum("_n").alias("specimens")
    )


def box_summary(long: DataFrame, by: Sequence[str], value: str, group_bound: int | None = None) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, and number of outliers per group."""
    by = list(by)
    quartiles = exact_quantiles(long, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group_bound)
    fences = quartiles.withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    counted = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_times"))
    rows = lookup_join(counted, fences, by, group_bound, "inner")
    inside = F.col(value).between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return rows.groupBy(*by).agg(
        F.first("n").alias("n"),
        *[F.first(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_times")).otherwise(0)).alias("outliers"),
    )


def baseline_table(
    subjects: DataFrame,
    by: str,
    by_levels: Sequence[str],
    continuous: Sequence[str],
    categorical: Sequence[str] = (),
    flags: Sequence[str] = (),
    add_p: bool = False,
) -> DataFrame:
    """Baseline characteristics, overall and per group, as a long table.

    Continuous variables give median and quartiles (``level`` empty), categorical ones count
    and percentage per level, flags count and percentage of TRUE only.  Percentages are of
    non-missing values.  Subjects whose group is null count in the overall column only.
    ``add_p`` compares the first two groups: each variable gets its ``test`` and ``p`` (rank sum for
    continuous ones; chi-square, or Fisher where a 2x2 table has small expected counts, for others).
    """
    groups = F.array(F.lit(OVERALL), F.col(by).cast("string"))
    doubled = subjects.withColumn("_group", F.explode(groups)).where(
        F.col("_group").isin(OVERALL, *by_levels)
    )
    parts = []
    if continuous:
        long = to_long(doubled, ["_group"], continuous, "variable", "_value")
        bound = len(continuous) * (len(by_levels) + 1)
        q = exact_quantiles(long, ["variable", "_group"], "_value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, bound)
        parts.append(
            q.select("variable", F.lit("").alias("level"), "_group", F.col("n").alias("count"),
                     F.lit(None).cast("double").alias("percent"), "median", "q1", "q3")
        )
    named = [*categorical, *flags]
    if named:
        long = to_long(doubled, ["_group"], named, "variable", "level", value_type="string")
        counts = long.groupBy("variable", "_group", "level").agg(F.count("*").alias("count"))
        totals = counts.groupBy("variable", "_group").agg(F.sum("count").alias("_total"))
        shares = lookup_join(counts, totals, ["variable", "_group"], len(named) * (len(by_levels) + 1), "inner")
        shares = shares.withColumn("percent", F.lit(100.0) * F.col("count") / F.col("_total"))
        shown = ~F.col("variable").isin(*flags) | (F.col("level") == "true") if flags else F.lit(True)
        none = F.lit(None).cast("double")
        parts.append(
            shares.where(shown).select(
                "variable", F.when(F.col("variable").isin(*flags), F.lit("TRUE")).otherwise(F.col("level")).alias("level")
                if flags else F.col("level"),
                "_group", "count", "percent", none.alias("median"), none.alias("q1"), none.alias("q3"),
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumnRenamed("_group", "group")
    if not add_p:
        return out
    tests = _group_tests(subjects, by, by_levels, continuous, named)
    return lookup_join(out, tests, ["variable"], len(continuous) + len(named), "left")


def _group_tests(subjects: DataFrame, by: str, by_levels: Sequence[str], continuous: Sequence[str], named: Sequence[str]) -> DataFrame:
    """``variable``, ``test`` and ``p`` of the difference between the first two groups."""
    first, second = by_levels[:2]
    two = subjects.where(F.col(by).isin(first, second))
    parts = []
    if continuous:
        ranks = rank_sum_test(to_long(two, [by], continuous, "variable"), "variable", "value", by, first, second, len(continuous))
        parts.append(ranks.select("variable", F.lit("rank_sum").alias("test"), "p"))
    if named:
        levels = to_long(two, [by], named, "variable", "level", value_type="string")
        parts.append(contingency_test(levels, "variable", "level", by).select("variable", "test", "p"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rank_sum_statistics(
    long: DataFrame, variable: str, value: str, group: str, first: str, second: str, variables: int,
    continuity: bool = True, blocks: int | None = None, keep_ties: bool = False,
) -> DataFrame:
    """Wilcoxon rank-sum statistic of two groups per variable, with tie-corrected z.

    Only distinct values and their counts are ranked, block by block.  ``keep_ties`` adds ``tied``,
    whether any value occurs twice.
    """
    two = long.where(F.col(group).isin(first, second))
    counts = {"_n1": F.count_if(F.col(group) == first)}
    ranked = midrank_counts(two, variable, value, counts, variables, blocks)
    sums = ranked.groupBy(variable).agg(
        F.sum("_n1").alias("n1"),
        F.sum(F.col("ties") - F.col("_n1")).alias("n2"),
        F.sum(F.col("midrank") * F.col("_n1")).alias("_w"),
        F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("_tied"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_w") - n1 * (n1 + 1) / 2.0
    off = F.col("u") - n1 * n2 / 2.0
    variance = n1 * n2 / 12.0 * (n + 1 - F.try_divide(F.col("_tied"), n * (n - 1)))
    shift = F.signum(off) * 0.5 if continuity else F.lit(0.0)
    return sums.withColumn("u", u).select(
        variable, "n1", "n2", "u", F.try_divide(off - shift, F.sqrt(variance)).alias("z"), *([(F.col("_tied") > 0).alias("tied")] if keep_ties else [])
    )


def rank_sum_test(*args, **kwargs) -> DataFrame:
    """``rank_sum_statistics`` with the two-sided normal p-value."""
    return rank_sum_statistics(*args, **kwargs).withColumn("p", normal_p("z"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def exact_rank_sum_p(n1: Column, n2: Column, u: Column) -> Column:
    """Two-sided p-value of a rank sum without ties, from the number of arrangements with each sum.

    The arrangements with statistic k are the coefficients of a product of fractions
    (1 - q^(n2 + i)) / (1 - q^i), i = 1 .. n1: a fold that multiplies by one and sums up along every i-th place for the
    other.  Only places up to the smaller tail are kept.
    """
    few, many = F.least(n1, n2), F.greatest(n1, n2)
    tail = F.least(u, n1 * n2 - u).cast("int")
    first = F.transform(F.sequence(F.lit(0), tail), lambda k: F.when(k == 0, 1.0).otherwise(0.0))

    def factor(a: Column, i: Column) -> Column:
        less = F.transform(a, lambda v, k: v - F.coalesce(F.get(a, (k - many - i).cast("int")), F.lit(0.0)))

        def along(values: Column) -> Column:
            def total(_: Column, k: Column) -> Column:
                places = F.sequence((k % i).cast("int"), k, i)
                return F.aggregate(places, F.lit(0.0), lambda acc, j: acc + F.get(values, j))

            return F.transform(values, total)

        return _bound(less, along)

    steps = F.sequence(F.lit(1), few.cast("int"))
    ways = F.aggregate(F.aggregate(steps, first, factor), F.lit(0.0), lambda acc, v: acc + v)
    every = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (many + i) / i)
    return F.least(F.lit(1.0), 2.0 * ways / every)


def rank_sum_exact(
    long: DataFrame, variable: str, value: str, group: str, first: str, second: str, variables: int, exact_below: int = 50, **options
) -> DataFrame:
    """``rank_sum_statistics`` with a p-value and how it was found (``method``).

    ``exact``: both groups have fewer than ``exact_below`` values and no value occurs twice.  ``normal``: otherwise.
    ``p`` is null where a group has no values.
    """
    stats = rank_sum_statistics(long, variable, value, group, first, second, variables, keep_ties=True, **options)
    small = (F.greatest("n1", "n2") < exact_below) & ~F.col("tied") & (F.least("n1", "n2") > 0)
    p = F.when(small, exact_rank_sum_p(F.col("n1"), F.col("n2"), F.col("u"))).otherwise(F.col("_normal"))
    found = stats.withColumn("_normal", normal_p("z"))
    return found.withColumns({"method": F.when(small, "exact").otherwise("normal"), "p": p}).drop("tied", "_normal")


def contingency_exact(
    long: DataFrame, variable: str, level: str, group: str, small_expected: float = 5.0, most_cells: int = 60
) -> DataFrame:
    """``contingency_test`` where tables larger than 2x2 with a small expected count are exact too.

    ``test`` is ``exact`` where all tables with the same margins could be counted, ``permutation`` where they are too many
    and tables were drawn instead, by a fixed seed.  Tables of more than ``most_cells`` cells keep the
    chi-square value (``chi_square_small_expected``), as their cells are not brought together.
    """
    tested = contingency_test(long, variable, level, group, small_expected)
    cells = long.where(F.col(level).isNotNull() & F.col(group).isNotNull()).groupBy(variable, level, group).agg(F.count("*").alias("_o"))
    shape = cells.groupBy(variable).agg((F.count_distinct(level) * F.count_distinct(group)).alias("_cells"))
    wanted = tested.where(F.col("test") == "chi_square_small_expected").select(variable).join(shape, variable).where(F.col("_cells") <= most_cells)
    # At most ``most_cells`` entries per variable.
    entry = F.struct(F.dense_rank().over(Window.partitionBy(variable).orderBy(level)).alias("r"), F.dense_rank().over(Window.partitionBy(variable).orderBy(group)).alias("c"), F.col("_o").alias("o"))
    tables = cells.join(wanted.select(variable), variable).withColumn("_e", entry).groupBy(variable).agg(F.collect_list("_e").alias("_table"))
    exact = tables.select(variable, exact_table_p("_table").alias("_x"))
    both = tested.join(exact, variable, "left")
    found = F.col("_x").isNotNull()
    return both.withColumns(
        {"test": F.when(found, F.col("_x.test")).otherwise(F.col("test")), "p": F.when(found, F.col("_x.p")).otherwise(F.col("p"))}
    ).drop("_x")


def contingency_statistics(long: DataFrame, variable: str, level: str, group: str) -> DataFrame:
    """Pearson chi-square per variable of level x group, with smallest expected count.

    Only the non-empty cells take part after the first aggregation, as the statistic is
    n (sum of O^2 / (row total x column total) - 1).  ``a``..``d`` are the cells of a 2x2
    table in sorted order, null for any other shape.
    """
    cells = (
        long.where(F.col(level).isNotNull() & F.col(group).isNotNull())
        .groupBy(variable, level, group)
        .agg(F.count("*").cast("double").alias("_o"))
    )
    rows = cells.groupBy(variable, level).agg(F.sum("_o").alias("_r"))
    cols = cells.groupBy(variable, group).agg(F.sum("_o").alias("_k"))
    row_shape = rows.groupBy(variable).agg(
        F.sum("_r").alias("_n"), F.count("*").alias("_levels"), F.min("_r").alias("_r_min"), F.min(level).alias("_l1")
    )
    col_shape = cols.groupBy(variable).agg(
        F.count("*").alias("_groups"), F.min("_k").alias("_k_min"), F.min(group).alias("_g1")
    )
    parts = (
        lookup_join(cells.join(rows, [variable, level]), cols, [variable, group], None, "inner")
        .groupBy(variable)
        .agg(F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_k"))).alias("_phi"))
    )
    totals = row_shape.join(col_shape, variable)
    first_level, first_group = F.col(level) == F.col("_l1"), F.col(group) == F.col("_g1")
    corners = (
        lookup_join(cells, totals.where((F.col("_levels") == 2) & (F.col("_groups") == 2)), [variable], None, "inner")
        .groupBy(variable)
        .agg(
            F.sum(F.when(first_level & first_group, F.col("_o")).otherwise(0.0)).alias("a"),
            F.sum(F.when(first_level & ~first_group, F.col("_o")).otherwise(0.0)).alias("b"),
            F.sum(F.when(~first_level & first_group, F.col("_o")).otherwise(0.0)).alias("c"),
            F.sum(F.when(~first_level & ~first_group, F.col("_o")).otherwise(0.0)).alias("d"),
        )
    )
    return parts.join(totals, variable).join(corners, variable, "left").select(
        variable,
        F.col("_n").cast("long").alias("n"),
        ((F.col("_levels") - 1) * (F.col("_groups") - 1)).alias("df"),
        (F.col("_n") * (F.col("_phi") - 1)).alias("chi_square"),
        (F.col("_r_min") * F.col("_k_min") / F.col("_n")).alias("min_expected"),
        "a", "b", "c", "d",
    )


def contingency_test(
    long: DataFrame, variable: str, level: str, group: str, small_expected: float = 5.0
) -> DataFrame:
    """Chi-square p-value, or Fisher's exact p-value of a 2x2 table with a small expected count.

    A larger table with small expected counts keeps the chi-square value and says so.
    """
    stats = contingency_statistics(long, variable, level, group)
    small, two = F.col("min_expected") < small_expected, F.col("a").isNotNull()
    return stats.withColumns(
        {
            "test": F.when(small & two, "fisher").when(small, "chi_square_small_expected").otherwise("chi_square"),
            "p": F.when(small & two, fisher_p("a", "b", "c", "d")).otherwise(
                chi_square_p("chi_square", F.col("df").cast("double"))
            ),
        }
    )
