"""Packing documents into token sequences: dominance reduction, then best fit."""

from __future__ import annotations

import json
import re
import string
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back, on_worker, ranked
from cohortloom.plans.lineage import cut

ROOM = 2048
END_ID = 0
#: Words whose ids a worker remembers; beyond it starts afresh.
WORDS_KEPT = 500_000
DOCS_AT_ONCE = 256
#: Separators that Python splits at and the tokenizer does not, and letters whose lower case depends on their place.
ODD = "[\x1c-\x1f\x85Σ]"


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordIds:
    """Token ids of whole texts by way of their words.

    The tokenizer composes (NFC), lower-cases and splits at white space before anything else, so a
    composed text's ids are those of its lower-cased words, joined.  Words repeat, so their ids
    are kept, as bytes.  Other texts go through the tokenizer whole.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(config)
        bare = json.loads(config)
        bare["normalizer"] = None
        self.bare = Tokenizer.from_str(json.dumps(bare))
        # A run of letters is one unit of the splitting rule, so only its last step is left.
        bare["pre_tokenizer"] = bare["pre_tokenizer"]["pretokenizers"][-1]
        self.letters = Tokenizer.from_str(json.dumps(bare))
        for t in (self.whole, self.bare, self.letters):
            t.encode_special_tokens = True
            t.no_truncation()
            t.no_padding()
        self.odd = re.compile(ODD)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, split, new = self.known, [], set()
        for text in texts:
            if self.odd.search(text) or not unicodedata.is_normalized("NFC", text):
                split.append(text)
            else:
                split.append(text.lower().split())
                new.update(split[-1])
        self.learn(new.difference(known))
        for words in split:
            if isinstance(words, str):
                yield array("I", self.whole.encode(words, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(known.__getitem__, words))


    def learn(self, new: set[str]) -> None:
        """Ids of new words; letters and the marks behind them are split from each other by rule."""
        known, letters, others, marked = self.known, set(), set(), []
        for word in new:
            core = word if word.isalpha() else word.rstrip(string.punctuation)
            if not core.isalpha():
                others.add(word)
                continue
            letters.add(core)
            if len(core) < len(word):
                others.add(word[len(core) :])
                marked.append((word, core))
        for some, tokenizer in ((letters, self.letters), (others, self.bare)):
            some = list(some.difference(known))
            for word, found in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[word] = array("I", found.ids).tobytes()
        for word, core in marked:
            known[word] = known[core] + known[word[len(core) :]]


def token_pieces(docs: DataFrame, tokenizer: str, key: str, text: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every row's tokens.

    ``tokenizer`` is the tokenizer's file as text.  A document is its ids and ``end_id``; only
    one of more than ``room`` ids is cut, into pieces of ``room``.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = on_worker(f"ids_{zlib.crc32(tokenizer.encode())}", lambda: WordIds(tokenizer))
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                keys, piece, start, length, crc = [], [], [], [], []
                for k, ids in zip(some.column(0).to_pylist(), ids_of([t or "" for t in some.column(1).to_pylist()])):
                    ids += end_id.to_bytes(4, "little")
                    for i, first in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[first : first + 4 * room]
                        keys.append(k)
                        piece.append(i)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                arrays = [pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")).mapInArrow(
        cut_up, f"`{key}` long, piece int, start long, length long, ids_crc32 long"
    )


def reduce_dominated(counts: dict[int, int], room: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Sequences that some optimal packing contains, each with its number, and the lengths that are left.

    A set dominates the alternatives for a length if whatever else could share its sequence can be
    swapped for the set's other member:

    * a length that fills the room with one other length: the other replaces any set that fits;
    * a length beside which only one other fits: the largest that fits replaces any;
    * a length beside which two at most fit, none of whose pairs sums to more than the largest
      single one that fits: that one replaces any pair.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[tuple[list[int], int]] = []

    def fix(lengths: list[int], times: int) -> None:
        if times > 0:
            fixed.append((lengths, times))
            for n in lengths:
                left[n] -= times
                if not left[n]:
                    del left[n]

    fix([room], left.get(room, 0))
    for n in [n for n in left if 2 * n > room]:
        fix([n, room - n], min(left.get(n, 0), left.get(room - n, 0)))
    if room % 2 == 0:
        fix([room // 2, room // 2], left.get(room // 2, 0) // 2)
    for n in sorted(left, reverse=True):
        while left.get(n, 0):
            others = sorted(m for m in left if m != n or left[m] > 1)
            space = room - n
            fits = bisect_left(others, space + 1)
            if not fits:
                fix([n], left[n])
                continue
            best = others[fits - 1]
            small = [m for m in others[:3] for _ in range(min(3, left[m] - (m == n)))][:3]
            if len(small) > 2 and sum(small[:3]) <= space:
                return fixed, left
            if len(small) > 1 and sum(small[:2]) <= space:
                own = {m: left[m] - (m == n) for m in others}
                if any(best < a + b <= space and (a != b or own[a] > 1) for a in others[:fits] for b in others[bisect_left(others, best - a + 1) : bisect_left(others, space - a + 1)]):
                    break
            fix([n, best], left[n] // 2 if best == n else min(left[n], left[best]))
    return fixed, left


def best_fit(counts: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    """Best fit by decreasing length, on numbers of equal lengths and of equal sequences.

    A document goes to the fullest sequence with room for it.  Equal documents thus fill one
    sequence as far as they go, then the next one like it, so whole groups are filled at once.
    """
    open_rooms: list[int] = []
    groups: dict[int, list[tuple[list[int], int]]] = {}

    def put(space: int, lengths: list[int], times: int) -> None:
        if times > 0:
            if space not in groups:
                insort(open_rooms, space)
                groups[space] = []
            groups[space].append((lengths, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(open_rooms, n)
            if at < len(open_rooms):
                space = open_rooms[at]
                lengths, times = groups[space].pop()
                if not groups[space]:
                    del groups[space], open_rooms[at]
            else:
                space, lengths = room, []
                times = -(-todo // (room // n))
            each = space // n
            full = min(times, todo // each)
            put(space - each * n, lengths + [n] * each, full)
            todo -= full * each
            if full < times:
                put(space - todo * n, lengths + [n] * todo, 1)
                put(space, lengths, times - full - 1)
                todo = 0
    return [group for space in open_rooms for group in groups[space]]


def plan(counts: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    fixed, left = reduce_dominated(counts, room)
    return fixed + best_fit(left, room)


def places(sequences: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: where pieces of a length go by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", room: int = ROOM, end_id: int = END_ID
) -> DataFrame:
    """Every piece of every row with its ``sequence_id`` and ``offset``.

    The driver sees how many pieces have each length (``room`` numbers at most) and plans with
    these alone: dominated choices are fixed first, the rest is packed by best fit.  Pieces are
    numbered within their length, and number and length decide the place.  A null text is an empty
    one, which is a piece of ``end_id`` alone; rows that repeat are packed as often.
    """
    pieces = cut(token_pieces(docs, tokenizer, key, text, room, end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(plan(counts, room))
    shift = 1 << 40
    starts = table[:, 0] * shift + table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.searchsorted(starts, batch["length"].to_numpy() * shift + batch["_rank"].to_numpy(), "right") - 1
            rest = batch["_rank"].to_numpy() - table[at, 1]
            yield batch.drop(columns="_rank").assign(sequence_id=table[at, 2] + rest, offset=table[at, 3]).astype({key: "Int64"})

    numbered = ranked(pieces, ["length"], [key, "piece", "ids_crc32"], "_rank")
    columns = [key, "piece", "start", "length", "ids_crc32"]
    return numbered.select(*columns, "_rank").mapInPandas(
        place, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
