"""Divergence of sources: every cell by its definition, tiles of sources, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, place int, n long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, top=200):
    """(text, lang, source) rows; every group against every kept term."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = terms_of(text)
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})

        def share(n, total):
            return 1 + 10**9 * (n + 1) // (total + len(kept))

        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    words = [random.choice("aäÉbZ日") + f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    out = []
    for _ in range(600):
        lang, source = random.choice(["en", "de"]), f"s{int(random.paretovariate(0.9)) % 23}"
        pool = words[int(source[1:]) % 7 :: 2] if random.random() < 0.5 else words
        out.append((" ".join(random.choices(pool, k=random.randint(0, 30))), lang, source))
    return out


@pytest.mark.parametrize("tile", [64, 5, 1])
def test_equals_brute_force(spark, rows, tile):
    assert run(spark, rows, tile=tile, top=9) == brute(rows, 9)


def test_odd_rows(spark):
    odd = [(None, None, None), ("a b a", None, "x"), ("A b", "", "x"), ("a, B!", "", None), ("a1b", "", "y"), ("", "en", "only"), ("rare", "fr", "p"), ("rare", "fr", "q"), ("long " * 20000, "", "y"), ("é É", "", "x"), ("a b", "", "x"), ("a b", "", "x")]
    assert run(spark, odd) == brute(odd)
    assert run(spark, []) == []


def test_shares_and_counts_beyond_32_bits(spark):
    big = [(0, 1), (10**12, 10**13), (10**13, 10**13), (123456789012, 99999999999999), (5, 10**14)]
    got = spark.createDataFrame(big, "n long, w long").select("n", "w", divergence.share(F.col("n"), F.col("w")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["w"] for r in got)


def test_vectors_are_exact(spark, rows):
    docs = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA).coalesce(1)
    got = [dict(zip(r["terms"], r["counts"])) for r in divergence.document_vectors(docs).collect()]
    assert got == [dict(Counter(terms_of(t))) for t, _, _ in rows]
