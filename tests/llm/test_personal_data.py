"""Personal data: plain patterns against their definition, disguises by example, offsets and masking."""

import hashlib
import random
import re
import time

import pytest

from cohortloom.llm import personal_data as pd_op
from cohortloom.llm import queries as llm_queries

TABLE = pd_op.folding_table()
#: The four patterns as the contract words them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, piece):
    digits = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_definition(text):
    found = [
        (kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(kind, m.group())
    ]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def test_base_equals_the_definition_on_random_texts():
    random.seed(5)
    pieces = ["a", "b.c", "@", "x@y.zz", ".", "-", " ", "1", "255", "256", "007", "+", "+1", "(555)", "4845168114407329", "4417 7442 8035 1547", "é", "%", "_", "\n", "12-34", "..", "@@", "9.9.9"]
    for _ in range(4000):
        text = "".join(random.choices(pieces, k=random.randint(1, 14)))
        assert sorted(pd_op.identifiers(text), key=lambda s: (s[1], pd_op.KINDS.index(s[0]))) == by_definition(text), text


DISGUISED = {
    "email": [
        "john [at] example [dot] com", "john(at)mail(punkt)example.de", "jane {AT} example {DOT} org", "john dot doe at mail dot example dot com",
        "marie arobase exemple point fr", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "jоhn@exаmple.com", "a&#64;b&#46;org", "jo​hn@exam­ple.com", "john%40example.com",
        "𝐣𝐨𝐡𝐧@example.com", "jan [ @ ] example [.] com",
    ],
    "ip": ["192[.]168[.]1[.]20", "one nine two dot one six eight dot one dot one", "１９２.１６８.１.２０", "192。168。1。20"],
    "card": ["4845 1681 l440 7329", "four eight four five one six eight one one four four zero seven three two nine", "4845 1681 1440 7329", "٤٨٤٥١٦٨١١٤٤٠٧٣٢٩"],
    "phone": ["plus one five five five double zero one two three four five", "+1 (5O5) 555-0123", "＋1 555 010 9999", "+1‑555‑010‑9999"],
}


@pytest.mark.parametrize("kind", DISGUISED)
def test_disguised_spans_map_back_to_the_source(kind):
    for piece in DISGUISED[kind]:
        for before, after in (("", ""), ("say ", " now"), ("é😀: ", ", é")):
            spans = pd_op.all_spans(before + piece + after, TABLE)
            assert (kind, len(before), len(before) + len(piece), False) in spans, (piece, spans)


def test_ordinary_text_gains_nothing():
    for text in ("Look at the dot on the map.", "one two and three", "at one point in time", "un deux mots", "m² is 10² and 5 O 6", "see (at) page 3", "a1l2@x.com", "plus 100 000 000 more", "Приве́т мир", "日本語 123"):
        assert all(base for *_, base in pd_op.all_spans(text, TABLE)), text
    kept = pd_op.all_spans("call +1 (017) 555-7713 one of us, x@y.com² too", TABLE)
    assert joined(kept) == "phone:5:22,email:34:41"


def test_a_wider_disguise_is_added_and_the_plain_span_stays():
    assert pd_op.all_spans("user@mail.example[dot]com", TABLE) == [("email", 0, 17, True), ("email", 0, 25, False)]


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 10**5, "a@" * 10**5, "+1" + " " * 10**6, "one " * 20000, "[" * 10**6, "1O" * 10**5, "a at a dot " * 20000, "9.9.9.9 [.] " * 20000])
def test_time_follows_length(text):
    start = time.perf_counter()
    pd_op.all_spans(text, TABLE)
    assert time.perf_counter() - start < 20


def test_rows_nulls_and_clashing_names(spark):
    texts = [None, "", "x@y.com", "x@y.com", "j [at] e [dot] org and 1.2.3.4", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " x@y.com"]
    docs = spark.createDataFrame([(i % 4, t, "s", [1], t) for i, t in enumerate(texts)], "doc_id long, text string, spans string, other array<int>, kind string")
    found = pd_op.find(docs, keep=docs.columns)
    assert found.columns == ["doc_id", "text", "other", "kind", "spans"]
    rows = found.withColumn("m", pd_op.masked("text")).collect()
    assert len(rows) == 6 and all(r["other"] == [1] for r in rows)
    by_text = {r["text"]: r for r in rows}
    assert by_text[None]["spans"] == [] and by_text[""]["spans"] == []
    assert by_text["j [at] e [dot] org and 1.2.3.4"]["m"] == "[email] and [ip]"
    assert by_text[texts[5]]["m"] == texts[5][0] + " [email]"
    assert found.limit(0).count() == 0 and pd_op.find(docs.where("false")).count() == 0


def test_query_equals_the_definition(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in llm_queries.op12_personal_data(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and any(r["n_email"] for r in got.values())
    for r in rows:
        expected, have = by_definition(r["text"]), got[r["doc_id"]]
        assert [have[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in expected) for k in PATTERNS]
        assert have["base_sha256"] == hashlib.sha256(joined(expected).encode()).hexdigest()
        assert set(joined(expected).split(",")) <= set(have["spans"].split(","))
    assert [f.dataType.simpleString() for f in llm_queries.op12_personal_data(spark, sf_dir).schema][1:5] == ["bigint"] * 4
