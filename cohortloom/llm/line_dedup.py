"""Lines that several documents share, as keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import BLANKS
from cohortloom.plans.lineage import cut

LEAST_CHARS = 10
#: A key with at least this share of all lines (and this many) is settled by aggregation.
HOT_SHARE, HOT_LINES = 1 / 1000, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 63) - 1


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z alone; text of single bytes takes the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, not once per element."""
    return F.transform(F.array(value), body)[0]


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``key``, ``_row`` and ``drop_bits`` of every document that loses lines.

    A line's key is the line without blanks at its ends, A to Z lower-cased; keys below
    ``least_chars`` code points stay out.  Lines become 128-bit hashes of their keys with
    document and position, are range-partitioned by hash and sorted by document and position
    inside it, and a stream over each run keeps the lines of its first document.  A run that
    holds a large share of all lines would be one task: such keys (at most 1 / ``HOT_SHARE`` of
    them, so they fit a broadcast) get their first document from a partial aggregation instead.

    ``drop_bits`` maps a word index to 64 bits, bit b of word w set where line 64 w + b goes;
    words without such a line are left out, as are documents that keep everything.  A document
    is the rows of one key; ``_row`` (hash of the text) tells apart rows that repeat a key with
    another text.  Rows with a null key are one document, after all others.
    """
    trimmed = F.btrim(F.col("_line"), F.lit(BLANKS))
    lines = cut(
        docs.select(
            F.coalesce(F.col(key), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_row"), F.posexplode(text_lines(text)).alias("_pos", "_line")
        )
        .select("_d", "_row", "_pos", trimmed.alias("_k"))
        .where(F.char_length("_k") >= least_chars)
        .withColumn("_k", lower_ascii(F.col("_k")))
        .select("_d", "_row", "_pos", F.xxhash64("_k").alias("_h"), F.xxhash64(F.lit(1), "_k").alias("_g"))
    )
    many = F.greatest(F.floor(F.sum("_n").over(Window.partitionBy()) * HOT_SHARE), F.lit(HOT_LINES))
    bins = lines.groupBy(F.shiftright("_h", 48).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    hot_bins = bins.withColumn("_many", many).where(F.col("_n") >= F.col("_many")).drop("_n")
    hot = cut(
        lines.join(F.broadcast(hot_bins), F.shiftright("_h", 48) == F.col("_bin"))
        .groupBy("_h", "_g", "_many")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_first"))
        .where(F.col("_n") >= F.col("_many"))
        .select("_h", "_g", "_first")
    )
    from_hot = lines.join(F.broadcast(hot), ["_h", "_g"]).where(F.col("_d") != F.col("_first"))
    cold = lines.join(F.broadcast(hot), ["_h", "_g"], "left_anti")
    run = Window.partitionBy("_h", "_g").orderBy("_d", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    streamed = cold.repartitionByRange("_h", "_g").withColumn("_first", F.first("_d").over(run)).where(F.col("_d") != F.col("_first"))
    dropped = streamed.select("_d", "_row", "_pos").union(from_hot.select("_d", "_row", "_pos")).repartition("_d", "_row")
    words = dropped.groupBy("_d", "_row", F.floor(F.col("_pos") / 64).cast("int").alias("_w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos") % 64)).alias("_bits")
    )
    return words.groupBy("_d", "_row").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("drop_bits"))


def kept_text(text: str, drop_bits: Column) -> Column:
    """The text without the lines of a bitmap; the text itself where there is none."""
    words = F.transform(
        F.sequence(F.lit(0), F.array_max(F.map_keys(drop_bits))), lambda w: F.coalesce(drop_bits[w], F.lit(0).cast("long"))
    )

    def filtered(dense):
        def stays(_, i):
            word = F.coalesce(F.get(dense, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
            return F.getbit(word, i % 64) == 0

        return F.array_join(F.filter(text_lines(text), stays), "\n")

    return F.when(drop_bits.isNull(), F.col(text)).otherwise(_bound(words, filtered))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``drop_bits``, ``n_lines`` and ``n_dropped``.

    Shared keys (in two or more documents) keep their lines in the smallest ``key`` alone.  A
    null or empty text is one empty line.  Apply a bitmap with ``kept_text``.  Columns of the
    added names are replaced.
    """
    docs = docs.drop("drop_bits", "n_lines", "n_dropped", "_d", "_row")
    bits = keep_bitmaps(docs, key, text, least_chars)
    rows = docs.withColumns({"_d": F.coalesce(F.col(key), F.lit(LAST)), "_row": F.xxhash64(text)})
    gone = F.aggregate(F.map_values("drop_bits"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    return (
        rows.join(bits, ["_d", "_row"], "left")
        .withColumns({"n_lines": F.size(text_lines(text)).cast("long"), "n_dropped": F.coalesce(gone, F.lit(0).cast("long"))})
        .drop("_d", "_row")
    )
