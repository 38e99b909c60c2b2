"""Ranked search: every score by its definition, index round trip, skipped blocks, odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortloom.llm import lexical

DOCS = "doc_id long, text string, item string, score string, term string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """All documents against all items, as the contract words it."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries = defaultdict(Counter)
    for item, text in items:
        queries[item] += Counter(terms_of(text))
    out = []
    for item, query in queries.items():
        scored = []
        for d, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * big_n) // big_l
            score = sum(
                times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, times in query.items() if t in bag
            )
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        for r, (score, d) in enumerate(sorted(scored)[:k]):
            out.append((item, r + 1, None if d == math.inf else d, -score))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS)
    questions = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.rank(frame, questions, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    words = [f"w{int(random.paretovariate(0.6)) % 400}" for _ in range(30000)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # equal scores
    items = [(i, " ".join(random.choices(words, k=25))) for i in range(20)] + [(99, docs[7][1])]
    return docs, items


def test_equals_brute_force(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_small_shards_blocks_and_windows(spark, corpus, monkeypatch):
    for name, value in {"SHARD_DOCUMENTS": 100, "SHARD_POSTINGS": 700, "BLOCK": 4, "WINDOW": 16, "TEXT_AT_ONCE": 500}.items():
        monkeypatch.setattr(lexical, name, value)
    assert run(spark, *corpus) == brute(*corpus)


def test_rounds_of_items_change_nothing(spark, corpus):
    docs, items = corpus
    assert run(spark, docs[:200], items, item_bytes=900) == brute(docs[:200], items)


def test_odd_rows(spark):
    docs = [(3, "Alpha beta GAMMA"), (1, "alpha BETA gamma"), (None, "alpha beta gamma"), (None, None), (5, ""), (6, "  .,- "), (1, "alpha"), (2, "ÉTÉ été 42"), (7, "zeta " * 5000)]
    items = [(1, "ALPHA beta"), (None, "été 42 42"), (2, None), (3, "unknown"), (1, "gamma"), (4, "zeta")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def shard_of(docs):
    """An index row over numbered terms, each document a list of them."""
    cells = [Counter(d) for d in docs]
    flat = [(t, n) for c in cells for t, n in sorted(c.items())]
    ids, tfs = (np.array([x[i] for x in flat], np.int32) for i in (0, 1))
    n = np.array([len(d) for d in docs])
    return lexical.packed_shard(np.arange(len(docs)), n, np.array([len(c) for c in cells]), ids, tfs, len(docs), int(n.sum()))


def test_index_round_trip_and_bounds():
    random.seed(4)
    docs = [random.choices(range(50), k=random.randint(1, 30)) + [7] * random.choice([0, 1, 300]) for _ in range(1500)]
    shard = lexical.Shard(shard_of(docs))
    for i, term in enumerate(shard.terms.tolist()):
        blocks = range(shard.first_block[i], shard.first_block[i + 1])
        place, impact = shard.blocks(i, blocks)
        assert place.tolist() == [d for d, words in enumerate(docs) if term in words]
        tf = np.array([docs[d].count(term) for d in place])
        assert (impact == lexical.impact(tf, shard.m[place])).all()
        assert all(shard.block(b, b == blocks[0])[1].max() == shard.block_max[b] for b in blocks)


def test_blocks_are_skipped():
    """A frequent term is decoded until ten strong documents are found, in two windows; after that, in the blocks of the other strong ones alone."""
    docs = [[0] + [9] * (d % 5) for d in range(30000)]
    for d in range(40):
        docs[d * 700] = [0, 1, 1, 2]
    shard = lexical.Shard(shard_of(docs))
    weights = np.array([1, 9000, 9000])
    scores, found = lexical.search_shard(shard, np.array([0, 1, 2]), weights, 10)
    every = [sum(w * lexical.impact(np.array([d.count(t)]), shard.m[i : i + 1])[0] for t, w in enumerate(weights.tolist()) if t in d) for i, d in enumerate(docs)]
    expected = sorted(range(len(docs)), key=lambda i: (-every[i], i))[:10]
    assert found.tolist() == expected and scores.tolist() == [every[i] for i in expected]
    frequent = range(shard.first_block[0], shard.first_block[1])
    decoded = sum(b in shard.decoded for b in frequent)
    assert decoded <= 2 * lexical.WINDOW // lexical.BLOCK + 40 < len(frequent) / 2
