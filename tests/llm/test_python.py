"""Token counts, packing, SimHash, top-k, language and page text against brute force on small frames."""

import base64
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import language, packing, page_text, simhash, token_counts, top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, fp string, piece string"
BLANKS = " \t\n\x0b\x0c\r"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "a", 0, "x", "y", "z") for r in rows], SCHEMA)


TEXTS = [
    None, "", " \t ", "A", "Hello, World! It's the 3rd 'test' — don't stop", "İstanbul ΟΔΟΣ Σ ﬁ é naïve \x1c odd\x85sep <|endoftext|>", "word " * 5000,
    "x" * 3000, "日本語 テキスト 😀 emoji", "ÀÉÎ õü ß Straße", "a\x00b", " ".join(f"tok{i}" for i in range(900)), "hello, world! it's",
]


# ---- token counts


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        size = next((s for s in range(min(len(word) - i, 40), 1, -1) if word[i : i + s] in pieces), 1)
        n, i = n + 1, i + size
    return n


@pytest.mark.parametrize("vocabulary", ["real", "tricky"])
def test_token_counts(spark, vocabulary):
    if vocabulary == "real":
        pieces = token_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        texts = TEXTS
    else:
        pieces = [b" a", b"ab", b"abcd", b"bcx", b"aaaa", b"aab", b" abab", b"cdcdc"]
        rng = random.Random(3)
        texts = ["".join(rng.choice("abcdx ") for _ in range(rng.randrange(300))) for _ in range(60)] + ["ab" * 4000, None]
    known = set(pieces)
    got = token_counts.count_tokens(frame(spark, list(enumerate(texts))), pieces).collect()
    assert len(got) == len(texts)
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(greedy(b" " + w, known) for w in words)


def test_ranks_file(tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate([b"a", b" b\n"])) + b"\n")
    assert token_counts.read_ranks(str(tmp_path / "v")) == [b"a", b" b\n"]


# ---- packing


def test_pieces_are_the_tokenizers(spark):
    rows = [*enumerate(TEXTS), (6, TEXTS[6]), (None, "no id")]
    config = packing.read_tokenizer(TOKENIZER)
    got = packing.pack(frame(spark, rows), config).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            expected[d, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    check_layout(got)


def check_layout(rows, room=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def fewest(lengths, room):
    """Smallest number of sequences by trying every placement, fullest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= room and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_reduction_is_safe_and_plan_whole():
    rng = random.Random(5)
    for trial in range(150):
        room = rng.choice([10, 11, 20])
        lengths = [rng.randint(1 if trial % 2 else 3, room) for _ in range(rng.randint(1, 10))]
        counts = Counter(lengths)
        fixed, left = packing.reduce_dominated(dict(counts), room)
        used = Counter(n for group, times in fixed for n in group * times)
        assert used + Counter(left) == counts
        assert all(sum(group) <= room for group, _ in fixed)
        rest = list(Counter(left).elements())
        assert sum(t for _, t in fixed) + (fewest(rest, room) if rest else 0) == fewest(lengths, room)
        plan = packing.plan(dict(counts), room)
        assert Counter(n for group, times in plan for n in group * times) == counts
        assert all(sum(group) <= room for group, _ in plan)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    counts = Counter(np.minimum(2048, 1 + rng.lognormal(6, 1, 40_000).astype(int)).tolist())
    plan = packing.plan(counts, 2048)
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in plan) <= 1.002 * total / 2048 + 1
    assert len(packing.places(plan)) < 30_000


def test_pack_nothing(spark):
    assert packing.pack(frame(spark, []), packing.read_tokenizer(TOKENIZER)).collect() == []


# ---- SimHash


def brute_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words += [word] * bool(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, far=3):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= far:
            parent[root(a)] = root(b)
    groups = defaultdict(set)
    for f in fps:
        groups[root(f)].add(f)
    return {frozenset(g) for g in groups.values()}


def test_fingerprints(spark):
    got = simhash.fingerprints(frame(spark, list(enumerate(TEXTS)))).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("paired, treed", [(64, 20_000), (3, 20_000), (3, 8)])
def test_links(spark, paired, treed):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 2**64 - 1, 7, 2**63}
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    distinct = spark.createDataFrame(signed, "fp long")
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(distinct, paired=paired, treed=treed).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([(a - 2**64 if a >> 63 else a, b - 2**64 if b >> 63 else b) for a, b in pairs], "a long, b long")).collect()}
    groups = defaultdict(set)
    for (s,) in signed:
        groups[roots.get(s, s)].add(s & (2**64 - 1))
    assert {frozenset(g) for g in groups.values()} == brute_groups(fps)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (300, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS, base, base.upper(), base.replace("w200", "changed"), "quite another text of its own kind"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(100, TEXTS[0]), (None, "lonely null key")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {d: brute_fingerprint(t) for d, t in rows if d is not None}
    expected = {}
    for group in brute_groups(set(prints.values())):
        members = [d for d, f in prints.items() if f in group]
        expected.update(dict.fromkeys(members, min(members)))
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


# ---- top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(top_k, "RING", 16)
    monkeypatch.setattr(top_k, "CHUNK", 4)
    monkeypatch.setattr(top_k, "SAMPLE", 60)
    monkeypatch.setattr(top_k, "PIVOTS", 8)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)] + [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] + [0.0] * 5)]
    rows += [(1080, [1.0, 2.0]), (1081, []), (7, rows[7][1]), (20, rows[20][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = top_k.top_k(df).collect()
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            ok.append((i, whole + [0] * (6 - len(whole))))
    expected = []
    for q, v in {i: v for i, v in ok if i % 20 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:20]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_top_k_of_few_and_none(spark):
    shape = "vec_id long, embedding array<float>"
    assert top_k.top_k(spark.createDataFrame([], shape)).collect() == []
    few = top_k.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], shape)).collect()
    assert sorted(tuple(r) for r in few) == [(0, 1, 1, 64 * 128), (0, 2, 2, -64 * 64)]


# ---- language


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    n, sizes = 3, [5, 3, 3, 1]
    moves, first = rng.random((n, n)) + 0.1, rng.random(n) + 0.1
    emits = [rng.random((s, n)) + 0.05 for s in sizes]
    starts = np.concatenate(([0], np.cumsum([sum(s > t for s in sizes) for t in range(max(sizes))])))
    rows = np.concatenate([[e[t] for e in emits if len(e) > t] for t in range(max(sizes))])
    got = language.forward_backward(rows, moves, first, starts)
    for d, e in enumerate(emits):
        total = np.zeros((len(e), n))
        for path in np.ndindex(*[n] * len(e)):
            p = first[path[0]] * e[0, path[0]]
            for t in range(1, len(e)):
                p *= moves[path[t - 1], path[t]] * e[t, path[t]]
            for t in range(len(e)):
                total[t, path[t]] += p
        total /= total.sum(axis=1, keepdims=True)
        assert np.allclose([got[starts[t] + d] for t in range(len(e))], total)


def test_held_out_accuracy_and_edge_cases(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    allowed = language.allowed_to_learn("doc_id")
    model = language.learn(documents, allowed, per_language=60)
    got = language.detect(documents, model, keep=["doc_id", "lang"]).where(~allowed).collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = frame(spark, [(1, None), (2, ""), (3, "123 $%&"), (4, "x" * 500), (5, "the " * 30_000), (None, "the and of"), (5, "the " * 30_000)])
    found = language.detect(odd, model, keep=["doc_id"]).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["lang_pred"] for r in found}
    assert by[1] == by[2] == by[3] == "und" and by[4] != "und" and by[5] == "en"
    switched = language.detect(frame(spark, [(1, "the of and ing tion with that from " * 20 + "der die und ein sch ung keit heit " * 21)]), model, keep=["doc_id"]).first()
    assert 0.4 < switched["score"] < 0.65


def test_nothing_to_learn(spark):
    none = frame(spark, [])
    model = language.learn(none, language.allowed_to_learn("doc_id"))
    assert language.detect(none, model, keep=["doc_id"]).collect() == []
    assert [r["lang_pred"] for r in language.detect(frame(spark, [(1, "some text")]), model, keep=["doc_id"]).collect()] == ["und"]
    one = language.learn(frame(spark, [(i, "some text here") for i in range(9)]), language.allowed_to_learn("doc_id"))
    assert language.detect(frame(spark, [(1, "text")]), one, keep=["doc_id"]).first()["lang_pred"] == "en"


# ---- page text


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{extra}{body}</body></html>'


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string, slot string")
    got = page_text.extract(df).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r["text"] for r in got}


def test_markup_decides(spark):
    pages = [
        ("http://a.x/1", page('<nav><ul><li><a href="/x">menu</a></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head &amp; Co</h1><p><b>First  para<br>goes<p>Second&nbsp;<i>par</i>a.</p><script>x()</script><div class="comments">me too</div></article><aside>side</aside><footer>&copy; foot</footer>')),
        ("http://a.x/2", None),
        (None, ""),
        ("odd url", "plain text only &lt;b&gt;"),
        ("http://b.y/", page('<header>top</header><div id="cookie-notice">eat</div><div>Body one</div><form>no<input></form><p>Body two<table><tr><td>c1<td>c2</table>')),
        ("http://b.y/long", page("<p>" + "word " * 50_000 + "</p>")),
        ("http://b.y/broken", '<p title="unclosed>text < 3 and <!-- never ends'),
    ]
    got = texts_of(spark, pages)
    assert got[0] == "Head & Co First para goes Second para."
    assert got[1] == got[2] == ""
    assert got[3] == "plain text only <b>"
    assert got[4] == "Body one Body two c1 c2"
    assert got[5] == ("word " * 50_000).strip()


def test_wrapper_drops_constant_blocks(spark):
    pages = [(f"http://Host.example:80/{i}", page(f"<div>All rights with us</div><div><p>Story number {i}</p><p>goes on {i * i}</p></div><div>Call 555</div>")) for i in range(8)]
    pages += [("http://few.example/a", page("<div>All rights with us</div><p>alone</p>"))]
    got = texts_of(spark, pages)
    assert all(got[i] == f"Story number {i} goes on {i * i}" for i in range(8))
    assert got[8] == "All rights with us alone"


def test_copies_of_an_article_stay_whole(spark):
    pages = [(f"http://c.example/{i}", page("<article><h1>Same</h1><p>same text on every page</p></article>")) for i in range(10)]
    pages += [("http://c.example/other", page("<article><h1>Else</h1><p>other text</p></article>"))]
    got = texts_of(spark, pages)
    assert all(got[i] == "Same same text on every page" for i in range(10)) and got[10] == "Else other text"


def test_tree_matching_keeps_order():
    leaf = lambda t: page_text.Node("p/#text", t)
    a = page_text.Node("div.", children=[leaf("x"), leaf("y"), leaf("z")])
    b = page_text.Node("div.", children=[leaf("y"), leaf("q")])
    pairs = []
    assert page_text.match(a, b, pairs) == 1 + 3 + 2
    assert [(m.text, n.text) for m, n in pairs if m.text] == [("z", "q"), ("y", "y")]


def test_no_pages(spark):
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"the w{i} of and" for i in range(120))
    rows = [(i, f"{' '.join(f'the and of {i * j % 101} ing tion{j}' for j in range(60))}\nshared line of many words\nown line {i}", "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, base, "en", "s1", 0) for i in range(5)] + [(200, None, None, None, None), (201, "12 34", "en", "s1", 0), (100, base, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = set(docs.columns)
    stages = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert set(stages.columns) == names
        stages.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        stages = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept[name] = Counter(r["doc_id"] for r in stages.select("doc_id").collect())
    assert 200 not in kept["language"] and 201 not in kept["language"] and kept["language"][100] == 2
    assert kept["line dedup"] == kept["language"]
    # Line dedup has emptied the copies; of the empty texts one stays.
    assert kept["near duplicates"][100] == 1 and [kept["near duplicates"][i] for i in range(101, 105)] == [1, 0, 0, 0]
    assert set(kept["mixing"]) <= set(kept["near duplicates"]) and max(kept["mixing"].values()) <= 3
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_layout(result)
    assert Counter(r["doc_id"] for r in result if r["piece"] == 0) == kept["mixing"]
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
