"""Ranked lexical search: shards of compressed posting lists, and a search that skips blocks by their maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import LAST_KEY as LAST
from cohortloom.plans.lineage import cut

#: Bytes of item texts whose terms are searched at once (a longer item is searched alone); more items take more rounds.
ITEM_BYTES = 8 << 20
#: A shard ends at so many documents or postings, whichever comes first.
SHARD_DOCUMENTS, SHARD_POSTINGS = 1 << 15, 1 << 20
BLOCK = 128
#: Documents of a shard that are scored between two looks at the threshold.
WINDOW = 4096
TEXT_AT_ONCE = 2 << 20
_UPPER = range(ord("A"), ord("Z") + 1)
#: ASCII letters become small, digits and bytes beyond ASCII stay, other ASCII becomes a blank.
TERM_BYTES = bytes(b + 32 if b in _UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
WIDTHS = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}
FORWARD = "doc long, n long, ids array<int>, tfs array<int>"
INDEX = (
    "docs array<long>, m array<long>, terms array<int>, first_block array<int>, block_last array<int>, block_max array<long>, "
    "gap_width array<int>, tf_width array<int>, block_at array<long>, payload binary"
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A to Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def query_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``term``, ``times`` of every item; rows that share an item are one query."""
    kind = items.schema[item].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, terms, times = [], [], []
            for i, x in enumerate(batch.column("text").cast(pa.binary())):
                found = Counter(terms_of(x.as_py()))
                of += [i] * len(found)
                terms += found.keys()
                times += found.values()
            columns = [batch.column("item").take(pa.array(of, pa.int32())), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "term", "times"])

    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.mapInArrow(count, f"item {kind}, term string, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``n`` (its terms with repeats) and the counts of its terms in the vocabulary, for every document with a term.

    Whole texts are read, a few megabytes of them at once.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)

        def packed(docs: list, lengths: list, known: list) -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.int64), *known])
            row = np.repeat(np.arange(len(docs)), [len(k) for k in known])
            cells, tfs = np.unique(row * size + ids, return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(docs) + 1) * size).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array((cells % max(size, 1)).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32))),
                ],
                names=["doc", "n", "ids", "tfs"],
            )

        for batch in batches:
            docs, lengths, known, taken = [], [], [], 0
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary())):
                raw = text.as_py()
                terms = terms_of(raw)
                if terms:
                    docs.append(doc)
                    lengths.append(len(terms))
                    known.append(np.array([i for i in map(vocabulary.get, terms) if i is not None], np.int64))
                taken += len(raw)
                if taken >= TEXT_AT_ONCE:
                    yield packed(docs, lengths, known)
                    docs, lengths, known, taken = [], [], [], 0
            yield packed(docs, lengths, known)

    return rows.mapInArrow(count, FORWARD)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def packed_shard(docs: np.ndarray, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """One row of the index: gaps and counts of every list in blocks, with last place and largest impact of each block."""
    m = 25 + 75 * n * n_docs // n_terms
    order = np.argsort(ids, kind="stable")
    place, tf = np.repeat(np.arange(len(docs)), sizes)[order], tfs[order].astype(np.int64)
    terms, first = np.unique(ids[order], return_index=True)
    length = np.diff(np.append(first, len(order)))
    blocks = -(-length // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    start = np.repeat(first, blocks) + (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)) * BLOCK
    end = np.minimum(start + BLOCK, np.repeat(first + length, blocks))
    gap = np.diff(place, prepend=-1)
    gap[first] = place[first] + 1
    empty = np.zeros(0, np.int64)
    gap_width, tf_width = (_widths(np.maximum.reduceat(x, start)) if len(start) else empty for x in (gap, tf))
    pieces = [
        gap[a:b].astype(WIDTHS[g]).tobytes() + tf[a:b].astype(WIDTHS[w]).tobytes()
        for a, b, g, w in zip(start.tolist(), end.tolist(), gap_width.tolist(), tf_width.tolist())
    ]
    return {
        "docs": docs, "m": m, "terms": terms, "first_block": first_block, "block_last": place[end - 1] if len(end) else empty,
        "block_max": np.maximum.reduceat(impact(tf, m[place]), start) if len(start) else empty, "gap_width": gap_width, "tf_width": tf_width,
        "block_at": np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64), "payload": b"".join(pieces),
    }


def build_index(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Posting lists of a stored forward table, one row per shard; a shard is a bounded run of a task's rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, postings = [], 0

        def shard() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*held)]
            return pd.DataFrame([packed_shard(*columns, n_docs, n_terms)])

        for whole in batches:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in whole["ids"]])))
            at = 0
            while at < len(whole):
                room = max(SHARD_POSTINGS - postings, 0)
                stop = int(np.searchsorted(ends, ends[at] + room, "right")) - 1
                stop = min(max(stop, at + (not held)), at + SHARD_DOCUMENTS - sum(len(h[0]) for h in held), len(whole))
                if stop > at:
                    part = whole.iloc[at:stop]
                    sizes = np.diff(ends[at : stop + 1])
                    none = [np.zeros(0, np.int32)]
                    held.append((part["doc"].to_numpy(), part["n"].to_numpy(), sizes, np.concatenate(none + list(part["ids"])), np.concatenate(none + list(part["tfs"]))))
                    postings += int(sizes.sum())
                    at = stop
                if at < len(whole):
                    yield shard()
                    held, postings = [], 0
        if held:
            yield shard()

    return forward.mapInPandas(build, INDEX)


class Shard:
    """A row of the index.  A block is decoded when it is first needed."""

    def __init__(self, row):
        for name in ("docs", "m", "terms", "first_block", "block_last", "block_max", "gap_width", "tf_width", "block_at"):
            setattr(self, name, np.asarray(row[name], np.int64))
        self.payload = row["payload"]
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.list_max = np.maximum.reduceat(self.block_max, self.first_block[:-1]) if len(self.terms) else self.block_max

    def block(self, b: int, is_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of one block."""
        if b not in self.decoded:
            g, w = int(self.gap_width[b]), int(self.tf_width[b])
            count = int(self.block_at[b + 1] - self.block_at[b]) // (g + w)
            at = int(self.block_at[b])
            gaps = np.frombuffer(self.payload, WIDTHS[g], count, at).astype(np.int64)
            tf = np.frombuffer(self.payload, WIDTHS[w], count, at + count * g).astype(np.int64)
            place = np.cumsum(gaps) + (-1 if is_first else self.block_last[b - 1])
            self.decoded[b] = place, impact(tf, self.m[place])
        return self.decoded[b]

    def blocks(self, i: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of some blocks (ascending) of the list at ``i``."""
        parts = [self.block(b, b == self.first_block[i]) for b in wanted]
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


Best = tuple[np.ndarray, np.ndarray]
NOTHING: Best = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search_shard(shard: Shard, ids: np.ndarray, weights: np.ndarray, k: int, best: Best = NOTHING) -> Best:
    """The ``k`` best scores and documents of a query among ``best`` and this shard.

    Lists are ordered by their largest possible part of a score.  Those that cannot reach the k-th
    score together are not essential: only documents of the others are looked at.  Of these, block maxima
    of the lists left reject what cannot reach it either, and only blocks of the rest are decoded.
    """
    at = np.searchsorted(shard.terms, ids)
    there = (at < len(shard.terms)) & (weights > 0)
    there[there] = shard.terms[at[there]] == ids[there]
    lists, weights = at[there], weights[there]
    reach = weights * shard.list_max[lists] if len(lists) else weights
    order = np.argsort(reach, kind="stable")
    lists, weights, up_to = lists[order].tolist(), weights[order].tolist(), np.cumsum(reach[order])

    def beats(bound: np.ndarray, docs: np.ndarray) -> np.ndarray:
        if len(best[0]) < k:
            return bound > 0
        return (bound > best[0][-1]) | ((bound == best[0][-1]) & (docs < best[1][-1]))

    for low in range(0, len(shard.docs), WINDOW):
        high = min(low + WINDOW, len(shard.docs))
        least = best[0][-1] if len(best[0]) == k else 0
        split = int(np.searchsorted(up_to, least, "left"))
        scores = np.zeros(high - low, np.int64)
        for i, weight in zip(lists[split:], weights[split:]):
            a, b = shard.first_block[i], shard.first_block[i + 1]
            last = shard.block_last[a:b]
            wanted = range(a + int(np.searchsorted(last, low)), a + min(int(np.searchsorted(last, high - 1)) + 1, len(last)))
            if wanted:
                place, add = shard.blocks(i, wanted)
                inside = (place >= low) & (place < high)
                scores[place[inside] - low] += weight * add[inside]
        chosen = np.flatnonzero(scores)
        scores, chosen = scores[chosen], chosen + low
        for j in range(split - 1, -1, -1):
            keep = beats(scores + up_to[j], shard.docs[chosen])
            scores, chosen = scores[keep], chosen[keep]
            if not len(chosen):
                break
            i, weight = lists[j], weights[j]
            a, b = shard.first_block[i], shard.first_block[i + 1]
            in_block = np.searchsorted(shard.block_last[a:b], chosen)
            bound = np.where(in_block < b - a, weight * shard.block_max[a + np.minimum(in_block, b - a - 1)], 0)
            keep = beats(scores + bound + (up_to[j - 1] if j else 0), shard.docs[chosen])
            scores, chosen, in_block = scores[keep], chosen[keep], in_block[keep]
            wanted = np.unique(in_block[in_block < b - a])
            if len(wanted):
                place, add = shard.blocks(i, (a + wanted).tolist())
                found = np.minimum(np.searchsorted(place, chosen), len(place) - 1)
                scores = scores + np.where(place[found] == chosen, weight * add[found], 0)
        keep = beats(scores, shard.docs[chosen])
        if keep.any():
            scores = np.concatenate((best[0], scores[keep]))
            docs = np.concatenate((best[1], shard.docs[chosen[keep]]))
            order = np.lexsort((docs, -scores))[:k]
            best = scores[order], docs[order]
    return best


def search(index: DataFrame, queries: list[tuple], kind: str, k: int) -> DataFrame:
    """``item``, ``doc``, ``score``: the best ``k`` of every task for each query (item, ids, weights).

    A task keeps one heap per query over all its shards, so its threshold rises from shard to shard.
    """
    held = [(item, np.array(ids, np.int64), np.array(weights, np.int64)) for item, ids, weights in queries]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps = [NOTHING] * len(held)
        for batch in batches:
            for _, row in batch.iterrows():
                shard = Shard(row)
                heaps = [search_shard(shard, ids, weights, k, heap) for (_, ids, weights), heap in zip(held, heaps)]
        parts = [pd.DataFrame({"item": [item] * len(h[0]), "doc": h[1], "score": h[0]}) for (item, _, _), h in zip(held, heaps) if len(h[0])]
        if parts:
            yield pd.concat(parts)

    return index.mapInPandas(best, f"item {kind}, doc long, score long")


def _ranked_part(docs: DataFrame, terms: DataFrame, key: str, text: str, k: int, kind: str) -> DataFrame:
    """The best ``k`` for the items of ``terms``, which together are no more than ``ITEM_BYTES`` of text (or one item)."""
    rows = terms.collect()
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    forward = cut(forward_rows(docs, vocabulary, key, text))
    total = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # At most one row per term of the vocabulary.
    df = {r["i"]: r["df"] for r in forward.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).collect()}
    queries: dict = {}
    for r in rows:
        i = vocabulary[r["term"].encode()]
        ids, weights = queries.setdefault(r["item"], ([], []))
        if i in df:
            ids.append(i)
            weights.append(r["times"] * term_weight(total["n"], df[i]))
    return search(build_index(forward, total["n"], max(total["terms"], 1)), [(item, *q) for item, q in queries.items()], kind, k)


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", key: str = "doc_id", item_text: str = "text", text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item``, ``rank``, ``key``, ``score``: the ``k`` best documents of each item with a score above 0.

    Equal scores go by ascending key.  Every row is a document, whether its text or key repeats or
    not; null keys come last among equal scores.  Rows with one item id are one query, null is an id
    like others.  Null texts have no terms; an item without a known term has no rows.  Other columns are not read.

    Items are searched in rounds of at most ``item_bytes`` of their text, so what a task holds of the queries is
    bounded; a round reads all documents once.
    """
    kind = items.schema[item].dataType.simpleString()
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("n")).first()["n"]
    rounds = 2 * size // item_bytes + 1
    terms = cut(query_terms(items, item, item_text).withColumn("_round", F.pmod(F.xxhash64("item"), F.lit(rounds))))
    found = None
    for i in range(rounds):
        part = _ranked_part(docs, terms.where(F.col("_round") == i), key, text, k, kind)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item), "rank", F.when(F.col("doc") != LAST, F.col("doc")).alias(key), "score")
