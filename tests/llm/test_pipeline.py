"""Stages of the pipeline: near duplicates by the rule of the numbered operator, mixing by content, odd rows."""

import random
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from cohortloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(20_000)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)


def kept(spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()), key=str)


def by_brute_force(rows):
    """The row of the smallest id (null last) of each group that links of 3 bits or fewer reach."""
    marks = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return groups.values()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(60):
        base = rng.choices(VOCABULARY, k=rng.choice([40, 250, 900]))
        out.append((10 * k, " ".join(base)))
        for j in (1, 2, 3):
            words = list(base)
            for i in rng.sample(range(len(words)), j - 1):
                words[i] = rng.choice(VOCABULARY)
            out.append((10 * k + j, " ".join(words)))
    return out + [(1000, None), (1001, ""), (1002, " \n")]


def test_near_copies_follow_the_operators_groups(spark, rows):
    groups = by_brute_force(rows)
    assert len(groups) < len(rows)
    assert kept(spark, rows) == sorted((min(g, key=lambda r: r[0]) for g in groups), key=str)
    ids = {r["component_id"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert {i for i, _ in kept(spark, rows)} == ids


def test_near_copies_among_rows_without_or_with_repeated_ids(spark):
    alone = [(None, f"quite another text number {i} of its own kind and with no copy {i * i}") for i in range(6)]
    alone += [(7, "one text under this id has words of its own here"), (7, "the same id again but nothing else is the same at all")]
    copied = [(9, "a text that is there three times in all"), (9, "a text that is there three times in all"), (None, "A text that is there three times in all")]
    assert kept(spark, alone + copied) == sorted([*alone, copied[0]], key=str)
    assert kept(spark, copied + [(None, copied[0][1])] * 3) == [copied[0]]


def test_mixing_keeps_different_rows_and_counts_equal_ones(spark):
    rows = [(None, f"text {i} of its own") for i in range(6)] + [(7, "one text"), (7, "another text")] + [(9, "a text that is there four times")] * 4
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, documents(spark, rows), "").collect())
    # One source takes exactly what it has: every row once.
    assert got == Counter(rows)
    again = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, documents(spark, rows), "").collect())
    assert again == got


def test_stages_of_empty_tables(spark):
    none = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, none, "")
        assert out.count() == 0 and out.columns == corpus_pipeline.DOCUMENT
    assert corpus_pipeline.packed(spark, none, "").count() == 0


def test_extra_columns_with_clashing_names(spark):
    docs = documents(spark, [(1, "the text of a document"), (2, "another one of these")])
    for name in ("_row", "_file", "_content", "_key", "copies", "lang_pred", "score", "fp", "rate"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").columns == corpus_pipeline.DOCUMENT
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 2
