"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import ranked
from cohortloom.plans.lineage import cut


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) with the highest score of ``key``.

    A shard's score is weight / -ln(u) with u uniform in (0, 1) from a hash of key and shard,
    so a shard is chosen in proportion to its weight.  No score depends on another shard: one
    more shard takes records only into itself, a removed one gives away only its own.  A null
    key is a key like any other.  Shards of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a positive weight")
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11) + 0.5) * F.lit(2.0**-53)
            scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None,
) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus one.  ``slot`` numbers the rows of a shard from 0
    without gaps.  ``grown`` are the weights after a change of shards; ``grown_shard`` is null
    without them.  Key and weights alone decide the shard, so copies of a text under different
    keys spread and rows that repeat a key stay together.  A null text counts no bytes and has
    the checksum of an empty one.  Only numbers are shuffled, never texts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = cut(
        docs.select(
            F.col(key),
            (F.octet_length(whole).cast("long") + 1).alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            rendezvous(F.col(key), weights).alias("shard"),
            (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        )
    )
    return ranked(placed, ["shard"], [key, "text_crc32", "size"], "slot")
