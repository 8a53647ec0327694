"""Personal data with source offsets, through disguises.

Base detectors read the text as it is. The deobfuscating path rewrites the text
with a chain of transducers (homoglyphs, spelled digits, at/dot disguises), each
of which keeps for every character it emits the source span that it stands for,
runs the same detectors on the result, and maps what they find back to spans of
the source.

The patterns' repetition limits are those of names on the net: 63 characters in
a label, 127 labels, 64 characters before the @ (and so at most 32 of its parts).

Defined results: a null or empty text has no spans; a text of any length is read
whole, in time linear in its length up to a sort of what it holds; rows are independent of each other, so
repeated rows give repeated results; further input columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from plantwatch.llm.common import map_rows, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with its run of digits, so a later one can only start at the start of a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run that ends at the @, from the last match at the earliest."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        # what has been walked over can't belong to a later local part: it has no @
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start and then kind."""
    spans = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a part with more than three digits after its zeros is over 255
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]]))


# Letters that look like ASCII letters, and digit words.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ⅼ": "l", "ɡ": "g", "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " ",
}
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_LOOKALIKE = re.compile(r"[^\x00-\x7fÀ-ÿ]")
_NAMES = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Four or more digits in a row of which some are words; a plus may be spelled too.
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\x20-]{{1,2}})?(?:{_NAMES}|[0-9]+)(?:[\x20,.()-]{{1,3}}(?:{_NAMES}|[0-9]+)(?![^\W\d_])){{3,}}", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus[\x20-]{{1,2}}|{_NAMES}", re.IGNORECASE)
_TOKEN = re.compile(r"[a-zà-ÿ]+|[0-9]+")
_BRACKET_AT = re.compile(r"[\x20]{0,3}[\[({<][\x20]{0,2}(?:at|@|arroba|chez)[\x20]{0,2}[\])}>][\x20]{0,3}", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"[\x20]{0,3}[\[({<][\x20]{0,2}(?:dot|punkt|punto|point|\.)[\x20]{0,2}[\])}>][\x20]{0,3}", re.IGNORECASE)
_BARE = re.compile(r"(?<=[A-Za-z0-9_%+-])[\x20_]{1,3}(?:at|arroba)[\x20_]{1,3}(?=[A-Za-z0-9-]{1,63}(?:[\x20_]{1,3}(?:dot|punkt|punto|point)[\x20_]{1,3}[A-Za-z0-9-]{1,63}))", re.IGNORECASE)
#: Without spelled dots the local part must look like one: see _looks_local.
_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])[\x20]{1,2}(?:at|AT)[\x20]{1,2}(?=(?:[a-z0-9-]{1,63}\.){1,126}[a-z]{2,63}(?![A-Za-z0-9]))")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:[\x20]{1,2}@[\x20]{0,2}|@[\x20]{1,2})(?=(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2})")
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])[\x20_]{1,3}(?:dot|punkt|punto|point)[\x20_]{1,3}(?=[A-Za-z0-9])", re.IGNORECASE)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_LOCAL_SIGN = re.compile(r"[0-9_%+]|[A-Za-z]\.[A-Za-z]")
#: What may stand before a local part that is a mere word.
_CONTEXT = re.compile(
    r"(?<![^\W_])(?:(?:e-?)?mail(?:s|to|en|ed|ing)?|contact(?:s|er|ez|o|ar)?|kontakt|courriel|correo|reach|write|schreib(?:e|en|t)?|[ée]cri(?:re|vez)|escrib(?:a|e|ir)|address|adresse|direcci[óo]n)"
    r"(?:\s+(?:to|at|is|an|à|a|address|adresse|ist|est|es))*\s*(?P<sign>[:=]?)\s*\Z", re.IGNORECASE,
)
#: Words that follow those without being an address, unless a colon parts them.
_NO_LOCAL = frozenset("me us him her them it you one to at is an for from in on and or the a by via with here there now page form server servers address addresses list lists account accounts service services details information mich uns ihn sie moi nous nos".split())
_DOT_WORDS = ("dot", "punkt", "punto", "point")


def _digit_words(lower: str) -> bool:
    """Whether two digits stand next to each other and one of them is a word."""
    words = _TOKEN.findall(lower)
    if _DIGIT_NAMES.isdisjoint(words):
        return False
    known = [w in _DIGIT_NAMES or w.isdigit() for w in words]
    return any(a and b and not (x.isdigit() and y.isdigit()) for a, b, x, y in zip(known, known[1:], words, words[1:], strict=False))


_DIGIT_NAMES = frozenset(DIGIT_WORDS)


class Aligned:
    """A text whose every character knows the source span it stands for."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Aligned:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> Aligned:
        """What replaces a match stands for the whole of the match."""
        text, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new == m[0] or m.start() == m.end():
                continue
            a, b = m.span()
            text += (self.text[done:a], new)
            starts += self.starts[done:a]
            ends += self.ends[done:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            done = b
        if not done:
            return self
        text.append(self.text[done:])
        starts += self.starts[done:]
        ends += self.ends[done:]
        return Aligned("".join(text), starts, ends)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _plain(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if unicodedata.category(c) in ("Cf", "Mn"):  # zero-width and combining
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) == 1 else c


def _looks_local(m: re.Match) -> bool:
    """Whether what ends where the match begins is a local part: by a sign that words don't hold, or by a word before it that asks for one."""
    text, end = m.string, m.start()
    local = _LOCAL_END.search(text, max(0, end - 64), end)
    if _LOCAL_SIGN.search(local[0]):
        return True
    before = _CONTEXT.search(text[max(0, local.start() - 48) : local.start()])
    return bool(before) and (bool(before["sign"]) or local[0].lower() not in _NO_LOCAL)


def _digits(m: re.Match) -> str:
    """The digits said; a single word said over and over is no number."""
    if not re.search(r"[^\W\d_]", m[0]):
        return m[0]
    said = _SPELLED_PART.sub(lambda w: DIGIT_WORDS.get(w[0].lower(), "+"), m[0])
    kept = "".join(c for c in said if c in "+0123456789")
    return kept if len(set(kept) - {"+"}) >= 2 else m[0]


def normalise(text: str) -> Aligned:
    out = Aligned.of(text)
    if not text.isascii() and _LOOKALIKE.search(text):
        out = out.rewrite(_LOOKALIKE, lambda m: _plain(m[0]))
    lower = out.text.lower()
    if _digit_words(lower):
        out = out.rewrite(_SPELLED, _digits)
    if "@" in lower or any(x in lower for x in _DOT_WORDS) or any(x in lower for x in "[({<"):
        out = out.rewrite(_BRACKET_AT, lambda m: "@").rewrite(_BARE, lambda m: "@").rewrite(_SPACED_AT, lambda m: "@").rewrite(_BRACKET_DOT, lambda m: ".")
        out = _dots(out)
    if " at " in lower:
        out = out.rewrite(_AT, lambda m: "@" if _looks_local(m) else m[0])
    return out


_TOUCHED = re.compile(r"@[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20_]{1,3}(?:dot|punkt|punto|point)[\x20_]{1,3})[A-Za-z0-9-]{1,63}){1,126}", re.IGNORECASE)
_BEFORE = re.compile(r"(?:[A-Za-z0-9%+-]{1,64}[\x20_]{1,3}(?:dot|punkt|punto|point)[\x20_]{1,3}){1,31}(?=[A-Za-z0-9._%+-]{1,64}@)", re.IGNORECASE)
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\x20_]{1,3}(?:dot|punkt|punto|point)[\x20_]{1,3}[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)


class _Within:
    """Whether a span lies in one of many: in the one that reaches farthest of those that begin before it."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.reach[k] >= b


def _dots(at: Aligned) -> Aligned:
    """Spelled dots count only inside an address: after an @, before one, or in a dotted quad."""
    places = [m.span() for p in (_TOUCHED, _BEFORE, _QUAD) for m in p.finditer(at.text)]
    if not places:
        return at
    inside = _Within(places)
    return at.rewrite(_BARE_DOT, lambda m: "." if inside(*m.span()) else m[0])


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that only the deobfuscated text shows."""
    if not text:
        return [], []
    base = detect(text)
    plain = normalise(text)
    if plain.text == text:
        return base, []
    more, seen = [], {k: _Within((a, b) for a, b, kind in base if kind == k) for k in KINDS}
    for a, b, kind in detect(plain.text):
        a, b = plain.span(a, b)
        if not seen[kind](a, b):
            more.append((a, b, kind))
    return base, more


def write_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row of counts and spans for each document; a map without shuffle."""

    def make():
        def one(doc_id, text):
            base, more = find(text)
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            return doc_id, *counts, hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(base + more), len(more)

        return one

    return map_rows(docs.select("doc_id", text_or_empty()), make, SCHEMA)


def redact_text(text: str | None) -> str | None:
    """The text with every span, base or disguised, replaced by <kind>; overlapping spans merge under the first kind."""
    if not text:
        return text
    base, more = find(text)
    out, done = [], 0
    for a, b, kind in sorted(base + more, key=lambda s: (s[0], -s[1], _ORDER[s[2]])):
        if a >= done:
            out += (text[done:a], f"<{kind}>")
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced; n_chars, where there is one, is the new length, and a null text stays null."""
    from pyspark.sql import functions as F

    names = docs.columns
    replaced = map_rows_with(docs)
    if "n_chars" not in names:
        return replaced
    return replaced.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*names)


def map_rows_with(docs: DataFrame) -> DataFrame:
    """All columns of the documents, with ``text`` redacted."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                new = pa.array([redact_text(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
