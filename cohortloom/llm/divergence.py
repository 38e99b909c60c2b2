"""How far the sources of a language are from each other, term by term and in whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.plans.joins import counted_bound, fits_broadcast, lookup_join
from cohortloom.plans.lineage import cut

#: A term is kept if at least so many documents of its language hold it.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Sources whose counts of a term travel in one row.
TILE = 64
#: Tables of pair sums a task holds before it passes them on.
PAIR_TABLES = 256
#: Bytes of text whose vectors are made at once.
TEXT_AT_ONCE = 2 << 20
_UPPER = range(ord("A"), ord("Z") + 1)
#: ASCII letters become small, other ASCII becomes a blank, bytes beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if b in _UPPER else b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def document_vectors(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source`` and the exact sparse count vector (``terms``, ``counts``) of every row.

    Terms are maximal runs of ASCII letters and characters beyond ASCII, A to Z lower-cased.  A
    null text, language or source is empty; a text without a term has an empty vector.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, int)
            piece = np.cumsum(sizes, dtype=np.int64) // TEXT_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:]):
                terms, counts, ends = [], [], [0]
                for t in texts[a:b]:
                    vector = Counter(t.as_py().translate(TERM_BYTES).split())
                    terms += vector.keys()
                    counts += vector.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang")[a:b], batch.column("source")[a:b],
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                    ],
                    names=["lang", "source", "terms", "counts"],
                )

    return rows.mapInArrow(count, "lang string, source string, terms array<string>, counts array<long>")


def group_sums(vectors: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Summed vectors of every (lang, source) over the kept vocabulary of the language.

    One row per occurring (lang, source, term): ``n`` occurrences in the group, ``lang_n`` in the
    language.  Sums are combined before they are exchanged; the vocabulary is a column of this table
    and is never collected.
    """
    entries = vectors.select("lang", "source", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
    sums = entries.groupBy("lang", "source", F.col("e.terms").alias("term")).agg(F.sum("e.counts").alias("n"), F.count(F.lit(1)).alias("_docs"))
    term = Window.partitionBy("lang", "term")
    whole = sums.withColumns({"_df": F.sum("_docs").over(term), "lang_n": F.sum("n").over(term)})
    return whole.where(F.col("_df") >= least_documents).drop("_docs", "_df")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 (n + 1) / whole) in 64 bits, for wholes up to 2 * 10^14: the factor is applied in two parts."""
    scaled = (n + F.lit(1).cast("long")) * F.lit(31250).cast("long")
    high = _div(scaled, whole) * F.lit(32000).cast("long")
    return high + _div((scaled % whole) * F.lit(32000).cast("long"), whole) + F.lit(1).cast("long")


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return _div((p - q) * (p - q), q)


def _np_share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    scaled = (n + 1) * 31250
    return scaled // whole * 32000 + scaled % whole * 32000 // whole + 1


def groups_of(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring (lang, source), terms or not, with its place in the language and what its shares need.

    ``n`` is its sum over kept terms, ``held`` their number, ``v`` the language's number of kept
    terms, ``lang_sum`` its sum, ``p0`` the share of a term the group lacks (null without kept terms).
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    # Row numbers need one window over the sources of a language: groups, not rows.
    groups = named.distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    words = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_sum"))
    out = groups.join(sums, ["lang", "source"], "left").join(words, "lang", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("n", "held", "v", "lang_sum")})
    return out.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("n") + F.col("v"))))


def shared_terms(kept: DataFrame, groups: DataFrame, bound: int | None, tile: int = TILE) -> DataFrame:
    """What terms that both sources hold change in the pair's value: ``lang``, ``place``, ``other``, ``value``.

    A term's counts stand in rows of up to ``tile`` sources; rows of a term meet tile by tile
    (with ``tile`` sources or fewer a language has one), and a task sums up the pairs of
    all its terms, so no pair of a single term leaves it.
    """
    placed = lookup_join(kept, groups.select("lang", "source", "place", (F.col("n") + F.col("v")).alias("whole"), "p0"), ["lang", "source"], bound, "inner")
    entry = F.struct("place", "n", "whole", "p0")
    tiles = placed.groupBy("lang", "term", F.floor(F.col("place") / tile).cast("int").alias("tile")).agg(F.collect_list(entry).alias("left"))
    many = groups.agg((F.max("place") >= tile).alias("m")).first()["m"]
    if many:
        tiles = cut(tiles)
        pairs = tiles.join(tiles.withColumnsRenamed({"tile": "other_tile", "left": "right"}), ["lang", "term"])
    else:
        pairs = tiles.select("lang", "term", "tile", "left", F.col("tile").alias("other_tile"), F.col("left").alias("right"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple, np.ndarray] = {}

        def flushed() -> pd.DataFrame:
            parts = []
            for (name, i, j), found in tables.items():
                s, t = np.nonzero(found)
                parts.append(pd.DataFrame({"lang": name, "place": s + i * tile, "other": t + j * tile, "value": found[s, t]}))
            tables.clear()
            return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "place": [], "other": [], "value": []})

        def add(name: str, i: int, j: int, left: list, right: list) -> None:
            here = [np.array([(e["place"], e["n"], e["whole"], e["p0"]) for row in side for e in row], np.int64).T for side in (left, right)]
            n_left, n_right = (np.array([len(row) for row in side]) for side in (left, right))
            # Each entry of the left meets the entries of its term on the right.
            repeats = np.repeat(n_right, n_left)
            a = np.repeat(np.arange(len(repeats)), repeats)
            starts = np.repeat(np.cumsum(n_right) - n_right, n_left)
            b = np.arange(len(a)) - np.repeat(np.cumsum(repeats) - repeats, repeats) + np.repeat(starts, repeats)
            place, n, whole, p0 = here[0][:, a]
            other, m, other_whole, q0 = here[1][:, b]
            p, q = _np_share(n, whole), _np_share(m, other_whole)
            value = (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0
            apart = place != other
            np.add.at(tables.setdefault((name, i, j), np.zeros((tile, tile), np.int64)), (place[apart] - i * tile, other[apart] - j * tile), value[apart])

        for batch in batches:
            for (name, i, j), part in batch.groupby(["lang", "tile", "other_tile"], sort=False):
                for at in range(0, len(part), 1024):
                    add(name, i, j, part["left"].iloc[at : at + 1024].tolist(), part["right"].iloc[at : at + 1024].tolist())
                if len(tables) >= PAIR_TABLES:
                    yield flushed()
        yield flushed()

    found = pairs.select("lang", "tile", "other_tile", "left", "right").mapInPandas(sums, "lang string, place long, other long, value long")
    return found.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))


def _pair_values(kept: DataFrame, groups: DataFrame, shared: DataFrame, bound: int | None) -> DataFrame:
    """Value of every ordered pair of sources of a language.

    Only sums over what each source holds are needed: terms that one of the two lacks enter by how
    many of them occur how often, terms that both lack by their number.
    """
    side = groups.select("lang", "place", "source", "v", "held", "p0", (F.col("n") + F.col("v")).alias("whole"))
    other = side.select("lang", F.col("place").alias("other"), F.col("source").alias("item"), F.col("held").alias("other_held"), F.col("p0").alias("q0"))
    other = F.broadcast(other) if fits_broadcast(bound) else other
    apart = F.col("place") != F.col("other")
    neither = F.coalesce((F.col("v") - F.col("held") - F.col("other_held")) * excess(F.col("p0"), F.col("q0")), F.lit(0).cast("long"))
    every = side.join(other, "lang").where(apart).select("lang", "place", "other", "source", "item", neither.alias("value"))
    often = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    rows = lookup_join(often, side.select("lang", "source", "place", "whole"), ["lang", "source"], bound, "inner")
    rows = rows.select("lang", "place", "m", share(F.col("n"), F.col("whole")).alias("p")).join(other, "lang").where(apart)
    sums = rows.groupBy("lang", "place", "other").agg(
        F.sum(F.col("m") * excess(F.col("p"), F.col("q0"))).alias("own"), F.sum(F.col("m") * excess(F.col("q0"), F.col("p"))).alias("lacking")
    )
    none = F.lit(None).cast("string")
    parts = sums.select("lang", F.inline(F.array(
        F.struct("place", F.col("other").alias("other"), none.alias("source"), none.alias("item"), F.col("own").alias("value")),
        F.struct(F.col("other").alias("place"), F.col("place").alias("other"), none.alias("source"), none.alias("item"), F.col("lacking").alias("value")),
    )))
    both = shared.select("lang", "place", "other", none.alias("source"), none.alias("item"), "value")
    summed = every.unionByName(parts).unionByName(both).groupBy("lang", "place", "other").agg(
        F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value")
    )
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = 200, tile: int = TILE
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how the sources of a language differ.

    Part ``pair``: every other source of the language, valued by the summed excess of the source's
    shares over its shares.  Part ``term``: the source's ``top`` terms whose share is above the
    language's.  Both by descending value, then item.  Null language, source and text are
    empty strings; rows that repeat are documents of their own; other columns are not read.  A
    language with one source has no pairs, one without kept terms values its pairs 0.
    """
    kept = cut(group_sums(document_vectors(docs, lang, source, text), least_documents))
    groups = cut(groups_of(docs, kept, lang, source))
    bound = counted_bound(groups.select("place"))
    pairs = _pair_values(kept, groups, shared_terms(kept, groups, bound, tile), bound)
    sides = groups.select("lang", "source", (F.col("n") + F.col("v")).alias("whole"), (F.col("lang_sum") + F.col("v")).alias("lang_whole"))
    valued = lookup_join(kept, sides, ["lang", "source"], bound, "inner").withColumns(
        {"p": share(F.col("n"), F.col("whole")), "q": share(F.col("lang_n"), F.col("lang_whole"))}
    )
    terms = valued.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return best.unionByName(pairs.withColumn("rank", F.row_number().over(ranked)))
