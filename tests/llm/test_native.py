"""Mixing, sharding, line deduplication and winnowing against brute force on small frames."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import common, line_dedup, mixing, sharding, winnow
from cohortloom.llm import queries as llm_queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, size string, marks string, _s int"
BLANKS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def documents(spark, texts, sources=None):
    return frame(spark, [(i, t, "en", sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def odd_texts():
    words = [f"w{i % 97}x{i % 13}" for i in range(6000)]
    return [
        None, "", "   \t ", "one", "Same Line of text\nsame line of TEXT  \nother line here", "same line of text", "É-line with accents\nshort",
        "é-line with accents", "\tÉ-line with accents ", " ".join(words), " ".join(words[:3000] + ["changed"] + words[3001:]), "a" * 5000,
        "copy of a text that repeats\nmore", "copy of a text that repeats\nmore", "\n\n\n", "x\r\nsame line of text\r\n", "日本語のとても長い行です。\n日本語のとても長い行です。",
    ]


def split_blank(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def test_words(spark, odd_texts):
    got = documents(spark, odd_texts).select("doc_id", common.word_array(F.col("text")).alias("w"), mixing.n_words(F.col("text")).alias("n")).collect()
    for r in got:
        assert r["w"] == split_blank(odd_texts[r["doc_id"]]) and r["n"] == len(r["w"])


def test_ranked_is_gapless_with_few_blocks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("k"))
    rows = common.ranked(df, ["g"], ["k"], "r", blocks=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["g"]].append(r["r"])
    assert {g: sorted(v) for g, v in by.items()} == {g: list(range(len(v))) for g, v in by.items()}
    assert len(rows) == 500


def lines_brute(rows, least=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    last = (1 << 63) - 1
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != (last if d is None else d) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run_lines(docs):
    marked = line_dedup.dedup_lines(docs)
    kept = F.coalesce(line_dedup.kept_text("text", F.col("drop_bits")), F.lit(""))
    return sorted((tuple(r) for r in marked.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256)).collect()), key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_lines(spark, odd_texts, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(line_dedup, "HOT_LINES", 3)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", 0.001)
    long = "\n".join(f"line number {i % 700} of many" for i in range(2000))
    texts = [*odd_texts, long, long.upper(), "\n".join(["line number 5 of many"] * 300)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(4, texts[4], "en", "a", 0), (None, texts[4], None, None, None), (4, "third text\n" + texts[4], "en", "a", 0)]
    assert run_lines(frame(spark, rows)) == lines_brute([(r[0], r[1]) for r in rows])


def test_lines_stream_needs_no_second_exchange(spark, odd_texts):
    plan = line_dedup.keep_bitmaps(documents(spark, odd_texts))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_h" in plan
    assert "hashpartitioning(_h" not in plan.split("rangepartitioning(_h")[0].rsplit("Window", 1)[-1]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert run_lines(none) == []
    assert mixing.mix(none).collect() == []
    assert sharding.shard(none).collect() == []
    assert winnow.edited_likeness(none).collect() == []


def test_shard(spark, odd_texts):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(odd_texts * 40)] + [(None, "x", None, None, None)] * 3 + [(7, odd_texts[7], "en", "a", 0)]
    got = sharding.shard(frame(spark, rows), weights=(1.0,) * 8, grown=(1.0,) * 9).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(8))
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected


def test_weights_decide_shares(spark):
    keys = spark.range(40_000)
    n = {r["s"]: r["count"] for r in keys.select(sharding.rendezvous(F.col("id"), (1.0, 3.0, 0.0, 4.0)).alias("s")).groupBy("s").count().collect()}
    assert 2 not in n and abs(n[0] / 40_000 - 1 / 8) < 0.01 and abs(n[3] / 40_000 - 1 / 2) < 0.01
    moved = keys.where(sharding.rendezvous(F.col("id"), (1.0,) * 8) != sharding.rendezvous(F.col("id"), (1.0,) * 9)).count()
    assert abs(moved / 40_000 - 1 / 9) < 0.01


def targets_brute(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, target, rest = {}, {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / total for s in open_} if open_ else {}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return {**full, **target}
        for s in over:
            full[s] = most * sizes[s]
            rest -= full[s]


def test_mix(spark):
    names = [None, "a", "b", "é", "z", "Z", "tiny", "empty"]
    rows = []
    for i in range(3000):
        s = names[0] if i % 3 == 0 else names[1 + i % 5]
        rows.append((i, " ".join(["w"] * (1 + (i * 7919) % 400 if i % 3 else 25)), "en", s, 0))
    rows += [(5000 + i, "two words", "en", "tiny", 0) for i in range(4)] + [(6000, None, "en", "empty", 0), (6001, "", "en", "empty", 0), (5000, "two words", "en", "tiny", 0)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    expected = targets_brute({s: sizes[s] for s in {r[3] for r in rows}})
    for r in got:
        assert math.isclose(r["target"], expected[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 25), s
    assert taken["tiny"] == 3 * sizes["tiny"]
    again = mixing.mix(docs.repartition(7)).collect()
    count = lambda x: Counter((r["doc_id"], r["copies"]) for r in x)
    assert count(got) == count(again)


def test_rates_are_tilted_exponentially(spark):
    """r / (3 - r) is proportional to exp(lam * size) with one lam per source, and rates meet the target."""
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "en", "ab"[i % 2], 0) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        logs = {r["size"]: math.log(2 * r["rate"] / (3 - r["rate"])) / r["size"] for r in own}
        assert max(logs.values()) - min(logs.values()) < 1e-9
        assert math.isclose(sum(r["rate"] * r["size"] for r in own), own[0]["target"], rel_tol=1e-6)


def marks_brute(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """(hash, position) by the definition, from hashes that the JVM works out for the grams."""
    words = [w[i : i + winnow.PIECE] for w in split_blank(text) for i in range(0, len(w), winnow.PIECE)]
    if not words:
        return [], []
    return words, [words[i : i + gram] for i in range(max(1, len(words) - gram + 1))]


def test_winnow(spark, odd_texts):
    docs = documents(spark, odd_texts)
    got = winnow.fingerprints(docs).select("doc_id", winnow.hashes(F.col("marks")).alias("h"), winnow.positions(F.col("marks")).alias("p")).collect()
    for r in got:
        words, grams = marks_brute(odd_texts[r["doc_id"]])
        if not grams:
            assert r["h"] == [] == r["p"]
            continue
        uniques = sorted({tuple(g) for g in grams})
        table = spark.createDataFrame([(list(g),) for g in uniques], "g array<string>").select("g", F.transform("g", lambda w: F.xxhash64(w)).alias("x"))
        n = len(grams[0])
        h = F.xxhash64(*[F.col("x")[i] for i in range(n)]) if len(words) >= winnow.GRAM else F.xxhash64("x")
        code = {tuple(t["g"]): t["h"] for t in table.select("g", F.shiftright(h, winnow.POSITION_BITS).alias("h")).collect()}
        hashes = [code[tuple(g)] for g in grams]
        chosen = []
        for i in range(max(1, len(hashes) - winnow.WINDOW + 1)):
            some = hashes[i : i + winnow.WINDOW]
            at = i + max(j for j, x in enumerate(some) if x == min(some))
            if not chosen or chosen[-1] != at:
                chosen.append(at)
        assert r["p"] == chosen and r["h"] == [hashes[i] for i in chosen]


@pytest.mark.parametrize("per_block", [3, 1000])
def test_edited(spark, odd_texts, monkeypatch, per_block):
    monkeypatch.setattr(winnow, "ROWS_PER_BLOCK", per_block)
    ids = [3 * i - 7 + (1000 if i > 9 else 0) for i in range(len(odd_texts))]
    got = {r["doc_id"]: r for r in winnow.edited_likeness(frame(spark, [(d, t, "en", "a", 0) for d, t in zip(ids, odd_texts)])).collect()}
    assert len(got) == len(ids)
    for i, d in enumerate(ids):
        own, following = odd_texts[i] or "", odd_texts[(i + 1) % len(ids)] or ""
        q = len(own) // 4
        assert got[d]["n_chars"] == len(own) and got[d]["edited"] == own[: len(own) - q] + following[:q]
        assert got[d]["next_marks"] == got[ids[(i + 1) % len(ids)]]["marks"]
    assert got[ids[12]]["marks"] == got[ids[13]]["marks"]


def test_edited_with_null_and_repeated_keys(spark):
    rows = [(None, "first of all words here"), (1, "a b c"), (1, "a b c"), (2, None)]
    got = winnow.edited_likeness(frame(spark, [(d, t, "en", "a", 0) for d, t in rows])).collect()
    assert len(got) == 4
    alone = winnow.edited_likeness(frame(spark, [(5, "one two three four", "en", "a", 0)])).collect()
    assert alone[0]["edited"] == "one two three " + "one "


def test_winnow_likeness_bounds(spark):
    df = spark.createDataFrame([([], []), ([1 << 28], []), ([1 << 28], [(1 << 28) + 5])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(winnow.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_every_dealt_operator_has_one_query():
    numbers = Counter(name.split("_")[0] for name in llm_queries.QUERIES if name.startswith("op"))
    assert numbers == {f"op{n}": 1 for n in range(1, 11)} and "pipeline" in llm_queries.QUERIES
