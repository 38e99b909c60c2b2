"""Numbers of greedy word pieces by a linear longest-match automaton."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import on_worker

#: Words whose counts a worker remembers; beyond it starts afresh.
WORDS_KEPT = 600_000
DOCS_AT_ONCE = 512
#: Longer words are followed alone rather than in step with others.
IN_STEP = 64


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a vocabulary file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Counts the pieces that greedy longest match takes from a word, one step a byte.

    Pieces form a trie.  Where a node has no edge for the next byte, the pieces that greedy
    matching has certainly taken by then are popped and the walk goes on at the node that spells
    what they leave.  Both the number popped and that node are worked out ahead from the parent's,
    so matching never looks back.  Every single byte is a piece, listed or not.
    """

    def __init__(self, pieces: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for b in piece:
                child = edges[node].get(b)
                if child is None:
                    child = edges[node][b] = len(edges)
                    edges.append({})
                    whole.append(False)
                node = child
            whole[node] = True
        fail, popped, ahead = [0] * len(edges), [0] * len(edges), [0]
        for node in ahead:
            for b, child in edges[node].items():
                ahead.append(child)
                if whole[child]:
                    popped[child] = 1
                    continue
                at, taken = fail[node], popped[node]
                while b not in edges[at]:
                    taken += popped[at]
                    at = fail[at]
                fail[child], popped[child] = edges[at][b], taken
        last = [0] * len(edges)
        for node in ahead[1:]:
            last[node] = popped[node] + last[fail[node]]
        found = sorted((node << 8 | b, child) for node, out in enumerate(edges) for b, child in out.items())
        self.keys = np.array([k for k, _ in found], np.int64)
        self.child = np.array([c for _, c in found], np.int32)
        self.edges: dict[int, int] | None = None
        self.fail, self.popped, self.last = (np.array(x, np.int32) for x in (fail, popped, last))

    def follow(self, node: np.ndarray, taken: np.ndarray, byte: np.ndarray) -> None:
        """One byte for many words, in place."""
        todo = np.arange(len(node))
        while todo.size:
            key = node[todo].astype(np.int64) << 8 | byte[todo]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            node[todo[hit]] = self.child[at[hit]]
            todo = todo[~hit]
            taken[todo] += self.popped[node[todo]]
            node[todo] = self.fail[node[todo]]

    def counts(self, words: Sequence[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        result = np.zeros(len(words), np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        node, taken = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for step in range(int(size[0]) if len(words) else 0):
            n = np.searchsorted(-size, -step, "left")
            if n <= 2 and step >= IN_STEP:
                for i in range(n):
                    node[i], taken[i] = self.alone(int(node[i]), int(taken[i]), joined[start[i] + step : start[i] + size[i]])
                break
            self.follow(node[:n], taken[:n], joined[start[:n] + step])
        result[order] = taken + self.last[node]
        return result

    def alone(self, node: int, taken: int, rest: np.ndarray) -> tuple[int, int]:
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.child.tolist(), strict=True))
        edges, fail, popped = self.edges, self.fail, self.popped
        for b in rest.tolist():
            child = edges.get(node << 8 | b)
            while child is None:
                taken += int(popped[node])
                node = int(fail[node])
                child = edges.get(node << 8 | b)
            node = child
        return node, taken


def count_tokens(docs: DataFrame, pieces: Sequence[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words`` and ``n_tokens`` of every row.

    Words are runs of non-blanks; each is matched with a space before it, as UTF-8 bytes.  Words
    repeat, so a worker remembers their counts.  A null or blank text has no words.
    """
    automaton = Automaton(pieces)
    mark = zlib.crc32(automaton.keys.tobytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = on_worker(f"counts_{mark}", dict)
        for batch in batches:
            words_of, tokens_of = [], []
            texts = batch[text].tolist()
            for at in range(0, len(texts), DOCS_AT_ONCE):
                if len(known) > WORDS_KEPT:
                    known.clear()
                split = [(t or "").encode().split() for t in texts[at : at + DOCS_AT_ONCE]]
                new = list(set().union(*split).difference(known))
                known.update(zip(new, automaton.counts([b" " + w for w in new]).tolist(), strict=True))
                words_of += map(len, split)
                tokens_of += [sum(map(known.__getitem__, words)) for words in split]
            yield pd.DataFrame({key: batch[key].astype("Int64"), "n_words": words_of, "n_tokens": tokens_of})

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(count, f"`{key}` long, n_words long, n_tokens long")
