"""Mixing sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import ranked, word_array
from cohortloom.plans.lineage import cut

MOST_COPIES = 3
NEWTON_ROUNDS = 60
TOLERANCE = 1e-9
MEND_ROUNDS = 5


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Target tokens of every source; ``sizes`` has one row per source: ``_s``, ``source``, ``source_size``.

    Sources in code point order, null last, take the weights in turn.  A target is
    min(most * source_size, rate * weight) with one rate for all, which is where resharing the
    excess by weight ends.  The rate is read from sums over the sources, ordered by the rate
    at which each reaches its limit.  The windows run over one row per source.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_w", turn[F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))])
    weighed = weighed.withColumn("_full", F.col("source_size") * float(most)).withColumn("_at", F.col("_full") / F.col("_w"))
    rising = Window.orderBy("_at", "_s")
    everything = Window.partitionBy()
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_full").over(upto), F.lit(0.0))
    open_weight = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    # With the sources before this one at their limits, the others share the rest at this rate.
    weighed = weighed.withColumn("_rate", rest / open_weight)
    fits = F.min(F.when(F.col("_rate") <= F.col("_at"), F.struct("_at", "_s", "_rate"))).over(everything)["_rate"]
    rate = F.coalesce(fits, F.max("_at").over(everything))
    return weighed.select("_s", "source", "source_size", F.least("_full", rate * F.col("_w")).alias("target"))


def tilted(z: Column, most: float) -> Column:
    """Rate of a document: the share of ``most`` copies, tilted from 1 copy by exp(z)."""
    return most / (1.0 + (most - 1.0) * F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def balance(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``_s``, ``lam``: the multipliers that solve the dual of entropy balancing.

    Among all rates between 0 and ``most`` that meet every source's target of tokens, the
    chosen ones have the least relative entropy to one copy each.  Their dual is convex, and
    its gradient is each source's tokens at rates tilted by exp(lam * size), less its target.
    A round is one aggregation of gradient and curvature over ``classes`` (documents of a
    source and size, counted); a Newton step that leaves the bracket found so far is replaced
    by its middle.  Rounds go on until every gradient is below ``TOLERANCE`` of its target.
    Sources without tokens keep 0; those at their limit need no multiplier.
    """
    state = cut(
        targets.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))).select(
            "_s", "target", F.lit(0.0).alias("lam"), F.lit(-1e300).alias("_lo"), F.lit(1e300).alias("_hi")
        )
    )
    for _ in range(NEWTON_ROUNDS):
        rate = tilted(F.col("lam") * F.col("_x"), most)
        sums = (
            classes.join(state, "_s")
            .groupBy("_s", "target", "lam", "_lo", "_hi")
            .agg(
                F.sum(F.col("_n") * F.col("size") * rate).alias("_got"),
                F.sum(F.col("_n") * F.col("size") * F.col("_x") * rate * (1 - rate / most)).alias("_h"),
            )
        )
        g = F.col("_got") - F.col("target")
        lo = F.when(g < 0, F.col("lam")).otherwise(F.col("_lo"))
        hi = F.when(g > 0, F.col("lam")).otherwise(F.col("_hi"))
        reach = 1.0 + 2.0 * F.abs("lam")
        step = F.coalesce(-g / F.when(F.col("_h") > 0, F.col("_h")), F.when(g < 0, reach).otherwise(-reach))
        newton = F.col("lam") + F.greatest(F.least(step, reach), -reach)
        inside = (newton > F.col("_lo2")) & (newton < F.col("_hi2"))
        close = F.abs(g) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        state = cut(
            sums.withColumns({"_lo2": lo, "_hi2": hi, "_close": close})
            .withColumn("_new", F.when(inside, newton).otherwise((F.col("_lo2") + F.col("_hi2")) / 2))
            .select(
                "_s", "target", F.when(F.col("_close"), F.col("lam")).otherwise(F.col("_new")).alias("lam"),
                F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_close",
            )
        )
        if not state.where(~F.col("_close")).limit(1).count():
            break
        state = state.drop("_close")
    return state.select("_s", "lam")


def class_copies(rates: DataFrame) -> DataFrame:
    """Whole copies ``_k`` of every class such that a source's tokens come near its target.

    Along a source's classes by size, copies follow the running sum of the wanted ones, so
    counts are off by less than one and tokens by less than the largest document.  What a
    source then lacks or has too much is mended with the largest class that is no larger, a
    few times; each round leaves less than the size it used.  The window runs over a source's different
    sizes, not its documents.
    """
    along = Window.partitionBy("_s").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rates.withColumn("_up", F.floor(F.sum(F.col("_n") * F.col("_rate")).over(along) + 0.5 + 1e-9))
    before = F.coalesce(F.lag("_up").over(Window.partitionBy("_s").orderBy("size")), F.lit(0))
    copies = cut(wanted.withColumn("_k", F.least(F.col("_up") - before, F.col("_n") * F.col("_most"))).drop("_up"))
    for _ in range(MEND_ROUNDS):
        gap = copies.groupBy("_s").agg((F.first("target") - F.sum(F.col("_k") * F.col("size"))).alias("_gap"))
        room = F.when(F.col("_gap") > 0, F.col("_n") * F.col("_most") - F.col("_k")).otherwise(F.col("_k"))
        fit = F.least(room, F.floor(F.abs("_gap") / F.col("size")))
        usable = (F.col("size") > 0) & (room > 0) & (fit > 0)
        best = (
            copies.join(gap, "_s").where(usable)
            .withColumn("_add", F.when(F.col("_gap") > 0, fit).otherwise(-fit))
            .groupBy("_s").agg(F.max_by(F.struct("size", "_add"), "size").alias("_best"))
            .select("_s", F.col("_best.size").alias("size"), F.col("_best._add").alias("_add"))
        )
        copies = cut(
            copies.join(best, ["_s", "size"], "left")
            .withColumn("_k", F.col("_k") + F.coalesce(F.col("_add"), F.lit(0))).drop("_add")
        )
    return copies


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    most: int = MOST_COPIES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``carry``, ``source``, ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` of every row.

    Weights go to the sources in turn, in code point order, null last (null is a source).
    Targets share the tokens of all sources and stop at ``most`` times a source's tokens.
    Rates solve the entropy balance, copies are the rates made whole: no document gets more
    than ``most``.  Documents of one source and size have the same rate; which of them get the
    odd copy is decided by a hash of the key, so reruns agree.  A document without words keeps
    one copy and a source without words has target 0.  An empty table gives no row.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = cut(
        docs.select(
            F.col(key), *carry, F.col(source).alias("source"), size.cast("long").alias("size"),
            F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_s"),
        )
    )
    classes = cut(rows.groupBy("_s", "size").agg(F.count(F.lit(1)).alias("_n"), F.first("source").alias("source")))
    sizes = classes.groupBy("_s").agg(
        F.first("source").alias("source"), F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("_docs")
    )
    targets = cut(source_targets(sizes, weights, most))
    means = sizes.select("_s", F.greatest(F.col("source_size") / F.col("_docs"), F.lit(1.0)).alias("_mean"))
    scaled = cut(classes.drop("source").join(means, "_s").withColumn("_x", F.col("size") / F.col("_mean")))
    solved = balance(scaled, targets, float(most))
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("lam").isNull(), float(most))
        .otherwise(tilted(F.col("lam") * F.col("_x"), float(most)))
    )
    rates = (
        scaled.join(targets, "_s").join(solved, "_s", "left")
        .select("_s", "source", "size", "_n", "source_size", "target", rate.alias("_rate"), F.lit(most).cast("long").alias("_most"))
    )
    copies = class_copies(rates).select(
        "_s", "size", "source_size", "target", "_rate", F.floor(F.col("_k") / F.col("_n")).alias("_each"), F.col("_k") % F.col("_n")
    ).toDF("_s", "size", "source_size", "target", "rate", "_each", "_odd")
    placed = ranked(rows, ["_s", "size"], [key], "_rank", per_group=copies)
    return placed.select(
        key, *carry, "source", "size", "source_size", "target", "rate",
        (F.col("_each") + (F.col("_rank") < F.col("_odd")).cast("long")).alias("copies"),
    )
