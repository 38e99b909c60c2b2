"""Near duplicates by SimHash, found in a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back, let_go
from cohortloom.plans.lineage import cut

SHINGLE = 3
FAR = 3
SEED = 42
#: Cells of more members than this are linked by a tree each, and beyond the second number through hubs.
PAIRED, TREED = 64, 20_000
LOW_HALF, ODD_BITS = 0xFFFFFFFF, 0x5555555555555555
HASHES_AT_ONCE, TEXTS_AT_ONCE = 1 << 16, 128


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    total = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = zip(starts[at : min(n, at + HASHES_AT_ONCE)].tolist(), last[at : at + HASHES_AT_ONCE].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in some])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, carry: Sequence[str] = ()) -> DataFrame:
    """``key`` (if ``carry`` names no other columns, all long) and ``fp``, the fingerprint as a signed long, of every row.

    A to Z are lower-cased, words are runs of non-blanks.  Fewer words than a shingle are one
    shingle; without words, as with a null text, the fingerprint is 0.
    """
    carry = list(carry) or [key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(len(carry))
            parts = range(0, len(texts), TEXTS_AT_ONCE)
            found = np.array([fingerprint(t or "", shingle) for at in parts for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.int64())], names=[*carry, "fp"])
        give_back()

    types = ", ".join(f"`{c}` long" for c in carry)
    return docs.select(*[F.col(c).cast("long").alias(c) for c in carry], F.col(text).alias("_text")).mapInArrow(work, f"{types}, fp long")


def _halves(fp: Column) -> Column:
    """(half, cell) of both halves: bit counts of 16 segments of two bits, each in its segment's place."""
    odd = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD_BITS))
    even = fp.bitwiseAND(F.lit(ODD_BITS))
    low = even.bitwiseAND(F.lit(LOW_HALF)) + odd.bitwiseAND(F.lit(LOW_HALF))
    high = F.shiftrightunsigned(even, 32) + F.shiftrightunsigned(odd, 32)
    return F.array(F.struct(F.lit(0).alias("half"), low.alias("cell")), F.struct(F.lit(1).alias("half"), high.alias("cell")))


def grid(distinct: DataFrame) -> DataFrame:
    """``half``, ``cell``, ``fp``, ``home``: every fingerprint at home and as a visitor of cells above its own.

    Fingerprints that differ in 3 bits differ by 3 at most in the sum over segments of the
    difference of their bit counts (Manhattan distance), so by 1 at most in one of the two
    halves.  There they share a cell, or one's cell has one count more by one.  So a
    fingerprint visits its own cell and those with one count raised.
    """
    at_home = distinct.select("fp", F.explode(_halves(F.col("fp"))).alias("_h")).select("fp", "_h.half", "_h.cell")
    raised = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda s: F.when(
                F.call_function("shiftright", F.col("cell"), (2 * s).cast("int")).bitwiseAND(F.lit(3)) < 2,
                F.col("cell") + F.call_function("shiftleft", F.lit(1).cast("long"), (2 * s).cast("int")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    visitors = at_home.select("fp", "half", F.explode(raised).alias("cell"), F.lit(False).alias("home"))
    return at_home.select("fp", "half", "cell", F.lit(True).alias("home")).union(visitors)


def tree_links(fps: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the links of all pairs connect, one per member at most."""
    left, a, b = np.unique(fps.astype(np.int64).view(np.uint64)), [], []
    while left.size > 1:
        front, left = left[:1], left[1:]
        while front.size and left.size:
            some, front = front[:256], front[256:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= far
            hit = near.any(axis=0)
            a.append(left[hit])
            b.append(some[near.argmax(axis=0)[hit]])
            front, left = np.concatenate((front, left[hit])), left[~hit]
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return join(a), join(b)


def _hub_links(members: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded cells at 3 bits or fewer, a fixed number of rows for each.

    Two such fingerprints have a point one bit or none from one and two bits or fewer from the other.
    At every point that has some fingerprint within one bit, all within two bits are linked to
    the smallest of these: they are 3 bits from it at most.
    """
    masks = [0, *(1 << i for i in range(64))]
    pairs = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = lambda xs: F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in xs])
    one = members.select("fp", F.explode(signed(masks)).alias("_m"), F.lit(True).alias("near"))
    two = members.select("fp", F.explode(signed(pairs)).alias("_m"), F.lit(False).alias("near"))
    points = one.union(two).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("point"), "near")
    centres = points.where("near").groupBy("point").agg(F.min("fp").alias("a"))
    return points.join(centres, "point").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, far: int = FAR, paired: int = PAIRED, treed: int = TREED) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints that connect all at ``far`` (3) bits or fewer.

    Candidates share a cell of the grid and are verified exactly.  Pairs of a small cell come
    from a join.  The number of pairs of a crowd would be its square, so a larger cell
    gives a tree over its links instead, and one too large for a task links through hubs.
    """
    if far != FAR:
        raise ValueError("the grid and the hubs are made for 3 bits")
    cells = grid(distinct)
    sizes = cut(cells.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where((F.col("n") > paired) & F.col("any_home")))
    few = cells.join(sizes.select("half", "cell"), ["half", "cell"], "left_anti")
    homes = few.where("home").select("half", "cell", F.col("fp").alias("a"))
    others = few.select("half", "cell", F.col("fp").alias("b"), "home")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= far
    once = (F.col("a") < F.col("b")) | ~F.col("home")
    found = homes.join(others, ["half", "cell"]).where(near & once & (F.col("a") != F.col("b"))).select("a", "b")

    def tree(members: pd.DataFrame) -> pd.DataFrame:
        a, b = tree_links(members["fp"].to_numpy(), far)
        return pd.DataFrame({"a": a, "b": b})

    crowds = cells.join(sizes.where(F.col("n") <= treed).select("half", "cell"), ["half", "cell"])
    masses = cells.join(sizes.where(F.col("n") > treed).select("half", "cell"), ["half", "cell"], "left_semi").select("fp").distinct()
    return found.union(crowds.groupBy("half", "cell").applyInPandas(tree, "a long, b long")).union(_hub_links(masses))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, of every node of ``edges`` (``a``, ``b``).

    Stars are made larger and smaller in turn until nothing changes: first every neighbour
    above a node goes to the node's smallest neighbour, then the node and its smaller neighbours
    do.  Edges never grow in number; each round is stored.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v")
        edges = cut(
            small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        )
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u"), F.col("u")).distinct())
        before = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key of the row's group, of every row.

    Fingerprints link at 3 or fewer differing bits; a group is all that links reach.  Rows of
    one fingerprint are one node, however many they are; a group of null keys has a null id.
    """
    marked = cut(fingerprints(docs, key, text))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = cut(components(links(distinct)))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, order: Sequence[str], text: str = "text") -> DataFrame:
    """``order`` of one row of each group of near duplicates: the smallest.

    ``order`` names long columns without nulls that tell all rows apart.  Groups are those of
    ``near_duplicates``: rows of equal fingerprints are one node, however many they are.
    """
    marked = cut(fingerprints(docs, text=text, carry=order))
    distinct = cut(marked.groupBy("fp").agg(F.min(F.struct(*order)).alias("first")))
    roots = cut(components(links(distinct.select("fp"))))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return grouped.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*")
