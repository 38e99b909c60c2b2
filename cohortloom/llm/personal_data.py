"""Personal data in whole texts, plain or disguised, as spans of the source text."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

KINDS = ("email", "ip", "card", "phone")
SPANS = "spans"
SPAN = StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Possessive, so that no run is walked twice; all start with a set of characters, which is quick to look for.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9]++")
TWELVE_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the run before it, up to the last span or ``@``, and the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Chains of numbers joined by dots, four at a time from the left."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = [m.span() for m in NUMBER.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            values = [text[a:b].lstrip("0") for a, b in parts[i : i + 4]]
            if all(len(v) < 4 and int(v or 0) <= 255 for v in values):
                yield parts[i][0], parts[i + 3][1]


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in TWELVE_DIGITS.finditer(text):
        if m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m.group())
            if len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of every plain identifier: leftmost ones per kind, without overlap inside a kind.

    A match that fails its check (number range, number of digits, Luhn) is dropped and its
    characters are not tried again.
    """
    found = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    found += [("ip", *s) for s in _ips(text)]
    found += [("card", *s) for s in _cards(text)]
    if "+" in text:
        found += [("phone", *s) for s in _phones(text)]
    return found


# Letters of other scripts that look like a Latin one, and signs that stand for another.
LOOK_ALIKE = {
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "o": "оο", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "-": "‐‑‒–—―−﹣", ".": "。·∙․﹒", "@": "﹫", "+": "➕﹢",
}
# Digits by name in English, German, French and Spanish.
DIGIT_NAMES = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
# Last labels that are no everyday words, for addresses spelled with bare words.
LAST_LABELS = "com org net edu gov mil int info biz dev app io ai co uk eu de fr es ch nl pl cz ru jp cn br au ca mx se dk fi ie gr pt tv xyz"
AT_WORDS, DOT_WORDS = "at|ät|arobase|arroba|klammeraffe", "dot|point|punkt|punto"

_VALUE = {name: digit for digit, names in DIGIT_NAMES.items() for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + r")(?!\w)"
_UNIT = rf"(?:(?:double|triple)[ ]{{1,2}})?{_NAME}"
_BETWEEN = rf"[ ,-]{{1,2}}(?:(?:{DOT_WORDS}|dash|hyphen)[ ]{{1,2}})?"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ]{{1,2}})?{_UNIT}(?:{_BETWEEN}{_UNIT}){{2,}}", re.I)
SPELLED_PART = re.compile(rf"plus[ ]+|(?:(double|triple)[ ]+)?({_NAME})|{_BETWEEN}", re.I)
MARKED = re.compile(rf"[\[({{<]{{1,2}}[ \t]{{0,3}}(?:(@|{AT_WORDS})|(\.|{DOT_WORDS}))[ \t]{{0,3}}[\])}}>]{{1,2}}[ \t]{{0,3}}", re.I)
ENTITY = re.compile(r"&#?[A-Za-z0-9]{2,8};|%(?:40|2[eEbBdD])")
AFTER_DIGIT = re.compile(r"[0-9][ -]?[OoIl]")
DIGIT_LIKE = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[OoIl]{1,5}(?=[0-9])")
LIKE_DIGIT = str.maketrans("OoIl", "0011")
_LABEL, _DOT = r"[A-Za-z0-9-]{1,63}", rf"[ ]{{1,3}}(?:{DOT_WORDS})[ ]{{1,3}}"
BARE = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9._%+-]{{1,64}}){{0,4}}[ ]{{1,3}}(?:{AT_WORDS})[ ]{{1,3}}"
    rf"{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}(?:{LAST_LABELS.replace(' ', '|')})(?!\w)",
    re.I,
)
# Where characters of the folding table can be: accented letters of Latin script are not among them.
BEYOND_LATIN = re.compile("[\u0080-\u00bf\u0131\u0250-\U0010ffff]")
# Letters and what is beyond ASCII stay, all else is a blank.
LETTERS_ALONE = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_IN_RUN = {w.encode() for w in (*_VALUE, *DOT_WORDS.split("|"), "dash", "hyphen", "double", "triple", "plus")}
BARE_PART = re.compile(rf"[ ]{{1,3}}(?:({AT_WORDS})|{DOT_WORDS})[ ]{{1,3}}", re.I)


def folding_table() -> dict[str, str]:
    """What single characters stand for: nothing (invisible ones), or the ASCII sign they imitate.

    Besides the look-alikes: wide, narrow, circled and mathematical forms by their compatibility
    mapping, decimal digits of every script, and every kind of blank.
    """
    table = {c: sign for sign, alike in LOOK_ALIKE.items() for c in alike}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x1FC00)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F:
            table[c] = ""
        elif kind == "Zs":
            table[c] = " "
        elif kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>", "<circle>", "<small>")):
            plain = unicodedata.normalize("NFKC", c)
            plain = table.get(plain, plain)
            if plain.isascii():
                table[c] = plain
    return table


class Traced:
    """A rewritten text that knows the source span of each of its characters."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + np.int32(1)

    def rewrite(self, edits: Sequence[tuple[int, int, str]]) -> None:
        """Replace ascending, separate ranges; what replaces a range has all of it as its source."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for i, j, new in edits:
            text += (self.text[at:i], new)
            starts += (self.start[at:i], np.full(len(new), self.start[i], np.int32))
            ends += (self.end[at:i], np.full(len(new), self.end[j - 1], np.int32))
            at = j
        self.text = "".join((*text, self.text[at:]))
        self.start = np.concatenate((*starts, self.start[at:]))
        self.end = np.concatenate((*ends, self.end[at:]))


def _blanks_before(text: str, i: int) -> int:
    return i - len(text[max(i - 3, 0) : i]) + len(text[max(i - 3, 0) : i].rstrip(" \t"))


def _folds(text: str, table: dict[str, str]):
    """Characters of the table; only those that occur are looked for."""
    present = set(text).intersection(table) if BEYOND_LATIN.search(text) else None
    if present:
        for m in re.finditer("[" + re.escape("".join(sorted(present))) + "]", text):
            yield m.start(), m.end(), table[m.group()]


def _entities(text: str):
    for m in ENTITY.finditer(text):
        piece = m.group()
        sign = chr(int(piece[1:], 16)) if piece[0] == "%" else html.unescape(piece)
        if len(sign) == 1 and sign.isascii() and sign.isprintable():
            yield m.start(), m.end(), sign


def _marked(text: str):
    free = 0
    for m in MARKED.finditer(text):
        start = max(_blanks_before(text, m.start()), free)
        yield start, m.end(), "@" if m.group(1) else "."
        free = m.end()


def _spelled(low: str, text: str):
    """Digits by name.  The pattern runs only where three words in a row may belong to such a run."""
    words = low.encode("utf-8", "surrogatepass").translate(LETTERS_ALONE).split()
    if b"\1\1\1" not in bytes(map(_IN_RUN.__contains__, words)):
        return
    for run in SPELLED.finditer(text):
        for m in SPELLED_PART.finditer(text, *run.span()):
            word = m.group().strip(" ,-").lower()
            if m.group(2):
                yield m.start(), m.end(), _VALUE[m.group(2).lower()] * {"double": 2, "triple": 3}.get((m.group(1) or "").lower(), 1)
            else:
                yield m.start(), m.end(), {"": "", "plus": "+", "dash": "-", "hyphen": "-"}.get(word, ".")


def _digit_like(text: str):
    return ((m.start(), m.end(), m.group().translate(LIKE_DIGIT)) for m in DIGIT_LIKE.finditer(text))


def _bare(text: str):
    for whole in BARE.finditer(text):
        for m in BARE_PART.finditer(text, *whole.span()):
            yield m.start(), m.end(), "@" if m.group(1) else "."


def normalised(text: str, table: dict[str, str]) -> Traced | None:
    """The text after all transducers, or nothing if none has anything to do."""
    traced = None

    def stage(edits) -> None:
        nonlocal traced
        edits = list(edits)
        if edits:
            traced = traced or Traced(text)
            traced.rewrite(edits)

    def now() -> str:
        return traced.text if traced else text

    stage(_folds(text, table))
    if "&" in now() or "%" in now():
        stage(_entities(now()))
    if any(c in now() for c in "[({<"):
        stage(_marked(now()))
    stage(_spelled(now().lower(), now()))
    if AFTER_DIGIT.search(now()):
        stage(_digit_like(now()))
    low = now().lower()
    if any(f" {w} " in low for w in DOT_WORDS.split("|")):
        stage(_bare(now()))
    return traced


def all_spans(text: str | None, table: dict[str, str]) -> list[tuple[str, int, int, bool]]:
    """Kind, start, end (code points) and whether the plain text shows it, by start, kind and end.

    What the normalised text shows besides is added where its source differs from it and does
    not lie inside a plain span.
    """
    if not text:
        return []
    base = identifiers(text)
    out = {(*span, True) for span in base}
    traced = normalised(text, table)
    if traced:
        starts = sorted(s for _, s, _ in base)
        reach = list(accumulate((e for _, _, e in sorted(base, key=lambda s: s[1])), max))
        for kind, i, j in identifiers(traced.text):
            a, b = int(traced.start[i]), int(traced.end[j - 1])
            before = bisect_right(starts, a)
            inside = before and reach[before - 1] >= b
            if text[a:b] != traced.text[i:j] and not inside:
                out.add((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``: kind, start, end (code points, end exclusive), base, of every row.

    ``base`` spans are what the four patterns match in the text as it is.  The others are
    disguised: transducers turn look-alike and invisible characters, character references,
    bracketed or spelled ``at`` and ``dot``, three or more digits by name in a row and letters in
    place of digits into plain signs, the same patterns read the result, and its spans are mapped
    back to the source.  A null or empty text has none.  Repeated rows are rows of their own; a column
    called ``spans`` is replaced.  Every text is read whole, in time that follows its length.
    """
    keep = [c for c in keep if c != SPANS]
    schema = docs.select(*keep).schema.add(SPANS, ArrayType(SPAN))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = folding_table()
        for batch in batches:
            found = [all_spans(t, table) for t in batch.iloc[:, -1]]
            yield batch.iloc[:, :-1].assign(**{SPANS: [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in found]})

    return docs.select(*keep, F.col(text).alias("_text_to_search")).mapInPandas(search, schema)


def count_of(kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(SPANS, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def as_text(base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    chosen = F.filter(SPANS, lambda s: s["base"]) if base_only else F.col(SPANS)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the first one's."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], before, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(SPANS, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))))
