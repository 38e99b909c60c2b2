"""Document fingerprints by winnowing."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 8
#: Words are cut after so many code points, so text without blanks has grams too.
PIECE = 12
#: Low bits of a mark hold the position, counted down; the others are the hash.
POSITION_BITS = 28
POSITIONS = (1 << POSITION_BITS) - 1
ROWS_PER_BLOCK = 1000
FIRST = -(1 << 63)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, not once per element."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """0 .. n - 1 for n of at least 1."""
    return F.sequence(F.lit(0), n - 1)


def gram_marks(text: Column, gram: int) -> Column:
    """One mark per gram of ``gram`` words: its hash above its position counted down.

    The smallest mark of a window is thus the smallest hash and, of equal ones, the rightmost.
    Fewer words make one gram; no words make none.
    """

    def mark(h, i):
        return h.bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(F.lit(POSITIONS) - (i.cast("long").bitwiseAND(F.lit(POSITIONS))))

    def marks(h):
        rolled = F.transform(
            _upto(F.size(h) - (gram - 1)), lambda i: mark(F.xxhash64(*[F.get(h, i + j) for j in range(gram)]), i)
        )
        return F.when(F.size(h) >= gram, rolled).when(F.size(h) > 0, F.array(mark(F.xxhash64(h), F.lit(0)))).otherwise(
            F.array().cast("array<bigint>")
        )

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    return _bound(F.transform(words, lambda w: F.xxhash64(w)), marks)


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The marks that are smallest in some window of ``window`` grams, by position.

    A shared run of ``gram + window - 1`` words always shares a hash.  Fewer grams than a window
    are one window.  The minimum of a window is taken from minima of half its size.
    """

    def by_step(step: int) -> Callable[[Column], Column]:
        return lambda m: F.transform(_upto(F.size(m) - step), lambda i: F.least(F.get(m, i), F.get(m, i + step)))

    def minima(marks):
        reached, width = marks, 1
        while width < window:
            step = min(width, window - width)
            reached = _bound(reached, by_step(step))
            width += step
        whole = F.when(F.size(marks) > 0, F.array(F.array_min(marks))).otherwise(marks)
        return F.when(F.size(marks) > window, F.array_distinct(reached)).otherwise(whole)

    return _bound(gram_marks(text, gram), minima)


def hashes(marks: Column) -> Column:
    return F.transform(marks, lambda m: F.shiftright(m, POSITION_BITS))


def positions(marks: Column) -> Column:
    """Index of each mark's gram in words."""
    return F.transform(marks, lambda m: F.lit(POSITIONS) - m.bitwiseAND(F.lit(POSITIONS)))


def as_text(marks: Column) -> Column:
    """Hashes in hexadecimal digits, joined by spaces."""
    width = (64 - POSITION_BITS) // 4
    return F.array_join(F.transform(hashes(marks), lambda h: F.substring(F.lower(F.hex(h)), -width, width)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes among all hashes of two fingerprints; two empty ones are alike."""

    def shares(x, y):
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shares(hashes(a), hashes(b)))


def _blocks(docs: DataFrame, key: Column) -> tuple[Column, int, int, list[int]]:
    """Block of a row by ranges of the key, the number of blocks, the least key, the first keys of blocks 1, 2, ...

    First keys are keys of the table, so no block is empty.  Their number follows the rows; the
    driver sees one number per ``ROWS_PER_BLOCK`` rows.  A row finds its block in two steps.
    """
    n = docs.count()
    wanted = max(1, math.ceil(n / ROWS_PER_BLOCK))
    cuts = [i / wanted for i in range(1, wanted)] or [0.5]
    least, found = docs.agg(F.min(key), F.percentile_approx(key, cuts, max(10_000, 20 * wanted))).first()
    starts = sorted({b for b in found or [] if b > least}) if wanted > 1 else []
    if not starts:
        return F.lit(0), 1, least, []
    size = max(1, math.isqrt(len(starts)))
    groups = [starts[i : i + size] for i in range(0, len(starts), size)]
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    group = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(parts, group - 1), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * size + inside), len(starts) + 1, least, starts


def with_next(docs: DataFrame, key: str, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``next_`` copies of ``columns`` from the next row by ``key``; the last row is followed by the first.

    ``made`` are columns to work out, copied too; they are worked out where the rows have arrived,
    so only ``docs`` is shuffled.  Rows go once into blocks of neighbouring keys.  The first key of a block is sent to the
    block before it too (and the least key to the last block), so each block knows what follows
    it.  Rows that repeat a key follow each other by the hash of ``columns``; null comes first.
    """
    place = F.coalesce(F.col(key), F.lit(FIRST))
    block, n_blocks, least, starts = _blocks(docs, place)
    begins = F.lit(False)
    if starts:
        begins = F.array_contains(F.from_json(F.lit(json.dumps([least, *starts])), "array<bigint>"), F.col("_id"))
    homes = F.array(
        F.struct(F.col("_at").alias("block"), F.lit(0).alias("late")),
        F.when(begins & (F.col("_at") > 0), F.struct((F.col("_at") - 1).alias("block"), F.lit(1).alias("late"))),
        F.when(F.col("_id") == F.lit(least), F.struct(F.lit(n_blocks - 1).alias("block"), F.lit(2).alias("late"))),
    )
    rows = docs.withColumns({"_id": place, "_at": block}).withColumns(
        {"_tie": F.xxhash64(*columns), "_home": F.explode(F.filter(homes, lambda h: h.isNotNull()))}
    )
    rows = rows.withColumns({"_block": F.col("_home.block"), "_late": F.col("_home.late")}).drop("_home", "_at").repartition("_block")
    along = Window.partitionBy("_block").orderBy("_late", "_id", "_tie")
    return (
        rows.withColumns(made or {})
        .withColumns({f"next_{c}": F.lead(c).over(along) for c in [*columns, *(made or {})]})
        .where(F.col("_late") == 0)
        .drop("_id", "_tie", "_block", "_late")
    )


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``marks``: the winnowed grams, from which ``hashes`` and ``positions`` read.

    Words are runs of non-blanks, cut after ``PIECE`` code points.  Equal texts have equal
    marks; a null or blank text has none.
    """
    return docs.withColumn("marks", winnowed(F.col(text), gram, window))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form ends with the start of the next document: the last quarter of the code
    points (rounded down) is replaced by as many first ones of the next text.
    """
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(whole, key, ["text"], {"marks": winnowed(F.col("text"))})
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    return (
        paired.withColumn("edited", edited)
        .select(key, n.cast("long").alias("n_chars"), "edited", "marks", "next_marks", winnowed(F.col("edited")).alias("edited_marks"))
    )
