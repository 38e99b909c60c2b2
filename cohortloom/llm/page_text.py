"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.plans.joins import counted_bound
from cohortloom.plans.lineage import cut

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|/?))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = RAW | frozenset("nav footer aside form menu button select option dialog svg canvas object audio video map datalist head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What the start of a tag ends: open elements down to the nearest of these, up to a boundary.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("article section main div ul ol dl table body html aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner\w*|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|login|masthead|"
    r"menu\w*|modal|nav|navbar|navigation|newsletter|notice\w*|overlay|pager|pagination|popup|promo\w*|recommended|related|replies|reply|respond|share|sharing|"
    r"sidebar\w*|signup|skip|social\w*|sponsor\w*|subscribe|toolbar|topbar|widget\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Classes that say of a wrapper what it holds or lacks, and names that stay noise however much text they hold.
STATE = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)-\S+", re.IGNORECASE)
ANSWERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|recommended|related|replies|reply|respond)(?:$|[\s_-])", re.IGNORECASE)
CONTENT = frozenset(("article", "main"))
#: A slot is template if so many pages of a host have it and this share of them the same text in it; on pages without an article
#: also if so many different pages have it and its texts are found on so many of them each, on average.
LEAST_PAGES, CONSTANT = 4, 0.6
LEAST_DIFFERENT, REPEATED = 8, 3.0


@dataclass
class Node:
    """An element that holds blocks, or a block (``text`` is set)."""

    label: str
    text: str | None = None
    inside: bool = False
    children: list[Node] = field(default_factory=list)
    within: tuple[int, ...] = ()


def name_of(attributes: str) -> tuple[dict[str, str], str]:
    """Attributes, and class and id without classes of state."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    return found, STATE.sub("", f"{found.get('class', '')} {found.get('id', '')}")


def noise_of(tag: str, attributes: str, inside: bool) -> str:
    """"always" where the element is noise by what it is, "form", "answers" or "named" where it may be a wrapper, else empty."""
    if (tag in NEVER and tag != "form") or (tag == "header" and not inside):
        return "always"
    if not attributes or tag in CONTENT or tag in ("body", "html"):
        return "form" if tag == "form" else ""
    found, named = name_of(attributes)
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or role in ROLES - {"form"}:
        return "always"
    if ANSWERS.search(named):
        return "answers"
    return "form" if tag == "form" or role == "form" else "named" if NOISE.search(named) else ""


def drop_noise(root: Node, kinds: list[str], holds: list[tuple[str, Node, tuple[int, ...]]]) -> None:
    """Drop elements that a name, or being a form, makes noise, unless they are the page's wrapper.

    A wrapper holds text of the page's ``main``; or, where no article is outside such elements, articles of
    as much text as is outside them, or most of the page's text.  The constancy of its blocks
    then decides.  Comments and links to other pages are no wrapper for their length.
    """

    def length(node: Node) -> int:
        return sum(len(b.text) for b in blocks(node))

    chars, held = [0] * len(kinds), [0] * len(kinds)
    total = clean = 0
    for b in blocks(root):
        total += len(b.text)
        clean += 0 if b.within else len(b.text)
        for i in b.within:
            chars[i] += len(b.text)
    full = [(tag, n, within) for tag, node, within in holds if (n := length(node))]
    outside = any(tag == "article" and not within for tag, _, within in full)
    wrapper = {i for tag, _, within in full if tag == "main" for i in within}
    for tag, n, within in full:
        for i in within if tag == "article" and not outside else ():
            held[i] += n
    wrapper |= {i for i, n in enumerate(held) if n and n >= clean}
    wrapper |= {i for i, kind in enumerate(kinds) if not outside and kind != "answers" and 2 * chars[i] > total}
    gone = set(range(len(kinds))) - wrapper

    todo = [root] if gone else []
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if gone.isdisjoint(c.within)]
        todo += node.children


def parse(page: str) -> Node:
    """Containers and blocks of a page, without what its own markup names as not part of the text.

    Unclosed elements end where their parents do, stray ends are passed over.  A block's text
    has its character references decoded and white space made single.
    """
    root = Node("#root")
    # Tag, its node or its parent's, numbers of the elements around it that may be noise (None if it is), inside the content.
    open_tags: list[tuple[str, Node, tuple[int, ...] | None, bool]] = []
    words: list[str] = []
    kinds: list[str] = []
    holds: list[tuple[str, Node, tuple[int, ...]]] = []

    def here() -> tuple[Node, tuple[int, ...] | None, bool]:
        return open_tags[-1][1:] if open_tags else (root, (), False)

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            node, noise, inside = here()
            if text and noise is not None:
                node.children.append(Node(f"{open_block()}/#text", text, inside, within=noise))

    def open_block() -> str:
        return next((tag for tag, *_ in reversed(open_tags) if tag in BLOCK), "")

    def close(tags: set[str], stop: frozenset[str]) -> bool:
        """End the innermost open element of these tags; false if there is none before a tag of ``stop``."""
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i][0] in tags:
                before = open_tags[i - 1][2] if i else ()
                if any(tag in BLOCK or noise != before for tag, _, noise, _ in open_tags[i:]):
                    flush()
                del open_tags[i:]
                return True
            if open_tags[i][0] in stop:
                return False
        return False

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if at > last:
            # No tag ends any more: what is left is text, up to a comment.
            words.append(page[at:].split("<!--")[0].replace("<![CDATA[", ""))
            break
        m = TOKEN.search(page, at)
        if not m:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                words.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if tag in BLOCK or any(t == tag for t, *_ in open_tags):
                close({tag}, BOUNDARY - {tag} if tag not in BOUNDARY else frozenset())
            continue
        attributes = m[3] or ""
        if tag in BLOCK:
            flush()
            close({"p"}, BOUNDARY | {"li", "td", "th", "dd"})
        while tag in ENDS and close(ENDS[tag], BOUNDARY):
            pass
        if tag in ("br", "wbr"):
            words.append(" " if tag == "br" else "")
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        node, noise, inside = here()
        inside = inside or tag in CONTENT
        if noise is not None and (kind := noise_of(tag, attributes, inside)):
            flush()
            kinds.append(kind)
            noise = None if kind == "always" else (*noise, len(kinds) - 1)
        if tag in BOUNDARY and noise is not None:
            name = next((v or w or x for k, v, w, x in ATTRIBUTE.findall(attributes) if k.lower() == "class"), "")
            child = Node(f"{tag}.{re.sub(r'[0-9]+', '', name)}", inside=inside, within=noise)
            node.children.append(child)
            node = child
            if tag in CONTENT and not any(kinds[i] == "answers" for i in noise) and not ANSWERS.search(name_of(attributes)[1]):
                holds.append((tag, child, noise))
        open_tags.append((tag, node, noise, inside))
    flush()
    if kinds:
        drop_noise(root, kinds, holds)
    return root


def aligned(a: list[Node], b: list[Node], weigh, trace: bool) -> tuple[int, list[tuple[int, int]]]:
    """Largest total weight of pairs of two lists in order, and with ``trace`` the pairs of one such choice.

    Every pair of nodes weighs 2, and 3 where it is of blocks with one text, so equal blocks at both ends are pairs of some best
    choice and are taken at once.  ``weigh`` gives the weight of two containers of one label.  The table is worked out a row at a
    time; only some rows are kept, from which those between are worked out again on the way back.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first].text is not None and (a[first].label, a[first].text) == (b[first].label, b[first].text):
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last].text is not None and (a[-1 - last].label, a[-1 - last].text) == (b[-1 - last].label, b[-1 - last].text):
        last += 1
    ends = [(i, i) for i in range(first)], [(len(a) - i, len(b) - i) for i in range(last, 0, -1)]
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    if not x or not y:
        return 3 * (first + last), [*ends[0], *ends[1]]
    number: dict[tuple, int] = {}

    def numbers(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        labels = [number.setdefault((n.label,), len(number)) for n in nodes]
        texts = [-1 if n.text is None else number.setdefault((n.label, n.text), len(number)) for n in nodes]
        return np.array(labels, np.int32), np.array(texts, np.int32)

    (x_label, x_text), (y_label, y_text) = numbers(x), numbers(y)
    y_leaf, there = y_text >= 0, set(y_text.tolist())
    by_label: dict[int, np.ndarray] = {}

    def row_weights(i: int) -> np.ndarray:
        label, text = int(x_label[i]), int(x_text[i])
        if text >= 0:
            if label not in by_label:
                by_label[label] = np.where((y_label == label) & y_leaf, np.int32(2), np.int32(0))
            return by_label[label] + (y_text == text) if text in there else by_label[label]
        weights = np.zeros(len(y), np.int32)
        for j in np.flatnonzero((y_label == label) & ~y_leaf).tolist():
            weights[j] = weigh(x[i], y[j])
        return weights

    def next_row(above: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + row_weights(i)), out=row[1:])
        return row

    every = max(1, int(len(x) ** 0.5))
    kept = {0: np.zeros(len(y) + 1, np.int32)}
    row = kept[0]
    for i in range(len(x)):
        row = next_row(row, i)
        if trace and (i + 1) % every == 0:
            kept[i + 1] = row
    total = int(row[-1]) + 3 * (first + last)
    pairs: list[tuple[int, int]] = []
    i, j = len(x), len(y)
    while trace and i and j:
        low = (i - 1) // every * every
        rows = [kept[low]]
        for k in range(low, i):
            rows.append(next_row(rows[-1], k))
        while i > low and j:
            here, above = rows[i - low], rows[i - low - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((first + i, first + j))
    return total, [*ends[0], *reversed(pairs), *ends[1]]


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: the largest number of nodes that two trees have in common, parents and order kept.

    ``pairs`` takes the matched nodes of one largest matching.  Works with stacks, however deep the trees are.
    """
    if a.label != b.label:
        return 0
    found: dict[tuple[int, int], int] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (id(x), id(y)) in found:
            continue
        if ready:
            found[id(x), id(y)] = 1 + aligned(x.children, y.children, lambda p, q: 1 + found[id(p), id(q)], False)[0]
            continue
        todo.append((x, y, True))
        inner = defaultdict(list)
        for q in y.children:
            if q.text is None:
                inner[q.label].append(q)
        todo += [(p, q, False) for p in x.children if p.text is None for q in inner[p.label]]
    matched = [(a, b)] if pairs is not None else []
    while matched:
        x, y = matched.pop()
        pairs.append((x, y))
        for i, j in aligned(x.children, y.children, lambda p, q: 1 + found[id(p), id(q)], True)[1]:
            matched.append((x.children[i], y.children[j]))
    return found[id(a), id(b)]


def blocks(node: Node) -> Iterator[Node]:
    """Blocks in page order."""
    todo = [node]
    while todo:
        node = todo.pop()
        if node.text is not None:
            yield node
        todo += reversed(node.children)


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the page's article, or of the whole page where it has none, that no template holds.

    ``template`` has the ids of block objects.  Where template would take more than half of an
    article, or all of a page, pages of the host are copies of each other and it stays whole.
    """
    found = list(blocks(root))
    inside = [b for b in found if b.inside]
    found = inside or found
    kept = [b for b in found if id(b) not in template]
    if not kept or (inside and 2 * sum(len(b.text) for b in kept) < sum(len(b.text) for b in found)):
        kept = found
    return " ".join(b.text for b in kept)


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for a null or odd url."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def hashed(text: str) -> int:
    """64 bits of a text, as a signed number."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def slots(pivot: Node, page: Node) -> list[tuple[int, Node, Node]]:
    """Aligned blocks: the pivot block's number, the pivot's and the page's block."""
    number = {id(b): i for i, b in enumerate(blocks(pivot))}
    pairs: list[tuple[Node, Node]] = []
    match(pivot, page, pairs)
    return [(number[id(a)], a, b) for a, b in pairs if a.text is not None]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every row.

    Every page of a host is aligned with the host's pivot (of the pages at least half as long as its pages are on
    average, the one with the smallest key) by simple tree matching.  A first pass counts, over all pages of the host, how
    often each block of the pivot is matched, how often by the same text, and on how many different pages each text is
    found there: constant slots are template, and so are, where a page has no article, slots whose few texts
    repeat from page to page (menus, adverts, footers); varying ones are content.  Copies of a page count once in that.  A second pass
    aligns again and takes the content.  Blocks that markup names as menu, header, footer, notice, advert, form or comment
    never count, nor do scripts and styles.

    A host may hold most pages: they meet the host's one pivot row in a join that can be split,
    and counts are summed in each task before they are shuffled.  A null page is empty; a null
    url belongs to the host without a name; rows that repeat are returned as often.
    """
    rows = pages.select(F.col(key).cast("long").alias(key), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("_host"))
    filled = rows.where(F.col("html").isNotNull())
    # Stored, so that its size is known before the join with whole pages is planned.
    size = F.octet_length("html")
    usual = cut(filled.groupBy("_host").agg(F.avg(size).alias("_usual")))
    whole = filled.join(F.broadcast(usual) if counted_bound(usual) else usual, "_host").where(2 * size >= F.col("_usual"))
    first = cut(whole.groupBy("_host").agg(F.min(F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"))).alias("_first")).select("_host", "_first._key"))
    chosen = whole.withColumn("_key", F.col(key)).join(first.withColumnRenamed("_key", "_first"), "_host").where(F.equal_null("_key", "_first"))
    pivots = cut(chosen.groupBy("_host").agg(F.min("html").alias("_pivot")))

    def parsed(known: dict[str, Node], pivot: str) -> Node:
        if pivot not in known:
            if len(known) > 1000:
                known.clear()
            known[pivot] = parse(pivot)
        return known[pivot]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for batch in batches:
            sums: dict[tuple[str, int, int, int], list[int]] = defaultdict(lambda: [0, 0])
            for host, pivot, text in batch.itertuples(index=False):
                tree = parse(text)
                page_hash = hashed("\n".join(b.text for b in blocks(tree)))
                for slot, a, b in slots(parsed(known, pivot), tree):
                    got = sums[host, slot, hashed(b.text), page_hash]
                    got[0] += 1
                    got[1] += a.text == b.text
            if sums:
                hosts, numbers, texts, different = zip(*sums)
                n, same = zip(*sums.values())
                yield pd.DataFrame({"_host": hosts, "slot": numbers, "t": texts, "p": different, "n": n, "same": same})

    counted = (
        filled.join(pivots, "_host").select("_host", "_pivot", "html")
        .mapInPandas(count, "_host string, slot int, t long, p long, n long, same long")
        .groupBy("_host", "slot", "t", "p").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        .groupBy("_host", "slot", "t").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.count(F.lit(1)).alias("pages"))
        .groupBy("_host", "slot").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"))
    )
    constant = (F.col("n") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("n"))
    repeated = (F.col("pages") >= LEAST_DIFFERENT) & (F.col("pages") >= REPEATED * F.col("texts"))
    template = counted.groupBy("_host").agg(
        F.sort_array(F.collect_set(F.when(constant, F.col("slot")))).alias("_slots"), F.sort_array(F.collect_set(F.when(repeated, F.col("slot")))).alias("_often")
    )
    wrappers = cut(pivots.join(template, "_host", "left"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page_html, pivot, constant_slots, repeated_slots in batch[["html", "_pivot", "_slots", "_often"]].itertuples(index=False):
                tree, gone = parse(page_html or ""), set()
                there = set() if constant_slots is None else set(constant_slots.tolist())
                often = set() if repeated_slots is None or any(b.inside for b in blocks(tree)) else set(repeated_slots.tolist())
                if there or often:
                    gone = {id(b) for slot, a, b in slots(parsed(known, pivot), tree) if slot in often or (slot in there and a.text == b.text)}
                texts.append(main_text(tree, gone))
            yield pd.DataFrame({key: batch[key].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))})

    return rows.join(wrappers, "_host", "left").select(key, "url", "html", "_pivot", "_slots", "_often").mapInPandas(
        take, f"`{key}` long, url string, text string, n_chars long"
    )
