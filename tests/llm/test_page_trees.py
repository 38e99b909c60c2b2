"""Trees of pages: brute-force matching, deep and wide pages, templates found by repetition."""

import random
import re
import time
from collections import defaultdict

import pytest

from cohortloom.llm import page_text


def brute(a, b):
    """Largest common tree by the plain recursion: two for each pair of nodes, one more for equal texts, the roots for one."""
    if a.label != b.label:
        return 0
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            if x.label != y.label or (x.text is None) != (y.text is None):
                w = 0
            elif x.text is not None:
                w = 3 if x.text == y.text else 2
            else:
                w = 1 + brute(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    return 1 + best[m][n]


def some_tree(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        return page_text.Node("p/#text", rng.choice("abc"))
    return page_text.Node(rng.choice(["div.", "ul."]), children=[some_tree(rng, depth - 1) for _ in range(rng.randint(0, 6))])


def test_matching_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (page_text.Node("r", children=[some_tree(rng, 3) for _ in range(rng.randint(0, 6))]) for _ in range(2))
        pairs = []
        assert page_text.match(a, b, pairs) == brute(a, b)
        # The pairs are such a matching: parents matched, order kept, weights adding up.
        weight = sum(3 if x.text is not None and x.text == y.text else 2 for x, y in pairs[1:]) + 1
        assert weight == brute(a, b) and all(x.label == y.label for x, y in pairs)


def test_deep_wide_and_broken_pages():
    start = time.perf_counter()
    deep = page_text.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert page_text.main_text(deep, set()) == "x" and len(page_text.slots(deep, page_text.parse("<div>" * 5000 + "y"))) == 1
    rng = random.Random(2)
    wide = [page_text.parse("<table>" + "".join(f"<tr><td>{rng.random()}" for _ in range(20_000)) + "</table>") for _ in range(2)]
    assert len(page_text.slots(*wide)) == 20_000
    assert page_text.main_text(page_text.parse('<p>ok</p><a "' + '<a "' * 20_000), set()).startswith("ok")
    assert page_text.main_text(page_text.parse("<p>ok</p>text <!-- never closed"), set()) == "ok text"
    assert time.perf_counter() - start < 90


MARKUP = re.compile(r"<(/?)(?:nav|footer|article|header|aside|section|ul|li)\b[^>]*>|<(/?)div[^>]*>")


def plain(html):
    """The page without elements and names that tell what they hold."""
    return MARKUP.sub(lambda m: f"<{m[1] or m[2] or ''}div>", html)


def test_menus_adverts_and_footers_go_without_their_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    by_host = defaultdict(list)
    for r in pages.collect():
        by_host[re.match(r"\w+://([^/:?#]*)", r["url"])[1].lower()].append(tuple(r))
    # Some sixty texts take turns in the slots around an article, so only a host of several hundred pages tells.
    rows = by_host[min(by_host, key=lambda h: (-len(by_host[h]), h))]
    assert len(rows) > 200
    bare = spark.createDataFrame([(i, u, plain(h)) for i, u, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(bare).collect()}
    clean = kept = paragraphs = left = 0
    for i, _, html in rows:
        outside = page_text.parse(plain(re.sub(r"<article>.*</article>", "", html, flags=re.DOTALL)))
        noise = [b.text for b in page_text.blocks(outside) if len(b.text) > 20]
        inside = [b.text for b in page_text.blocks(page_text.parse(html)) if b.inside]
        clean += sum(t not in got[i] for t in noise)
        left += len(noise)
        kept += sum(t in got[i] for t in inside)
        paragraphs += len(inside)
    assert clean / left > 0.9 and kept / paragraphs > 0.97, (clean / left, kept / paragraphs)


@pytest.mark.parametrize("first", ["", "<p>404 not found</p>"])
def test_an_empty_or_error_page_is_no_pivot(spark, first):
    story = lambda i: f"<html><body><div>All rights with us</div><div><p>Story number {i} of many</p><p>goes on {i * i}</p></div><div>Call 555</div></body></html>"
    pages = [(0, "http://h.example/0", first), (None, "http://h.example/x", first)] + [(i, f"http://h.example/{i}", story(i)) for i in range(1, 10)]
    got = page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 11 and texts[3] == "Story number 3 of many goes on 9" and texts[0] == re.sub("<[^>]*>", "", first)
