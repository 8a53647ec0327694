"""Main text of HTML pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens: tags, which score below zero, and runs of words, which score by their number and
the kind of element around them. Scores are log odds of lying inside the content, learned from labelled pages: those
that mark their content with one article element. One linear scan finds the contiguous region of the greatest sum.

Names are evidence, too: the meaning of an element (nav, footer, form) and each part of a class, id or role. Their log
odds are learned from the words that the named elements hold on labelled pages, beside a few words' worth of prior
belief for the usual names; what evidence holds to be no content is left out of the region. An article or main element
inside a named wrapper outweighs the wrapper's name, and a page that would come out empty is read without names.

Defined results: a null or empty page, or one without words, gives the empty text; only scripts, styles and other raw
content is dropped unread; unclosed and stray tags are accepted, an apostrophe in an unquoted value is part of it, a
quote that is never closed ends with its tag, and a less-than sign before anything but a name is text; pages of any
length and depth are read whole, in linear time; without any labelled page the default scores hold; rows are
independent of each other; further columns are not touched.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import bounded_sample, cut, map_rows, table

#: Pages that the scores are learned from, at most, as far as they are labelled.
SAMPLE = 2000
#: A run of words counts so many words at most, so that one long run can't outweigh everything.
RUN = 200
#: Evidence below this, as log odds, leaves an element out; and what the usual names are worth before any page was seen, in words.
OUT, PRIOR_IN, PRIOR_OUT = -1.5, 1.0, 40.0

# Element names of HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes", "svg", "object", "canvas", "audio", "video")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
})
#: Elements whose meaning is evidence; all others are mere structure, in the content as outside.
MEANING = frozenset({"head", "nav", "header", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "label", "option", "datalist", "article", "main"})
#: Names that are boilerplate as a rule, as parts of a class, id or role.
USUAL = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "sidebar", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar",
    "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "replies", "login", "signup", "search", "pagination", "pager", "skip", "hidden", "complementary", "contentinfo", "dialog", "alert", "form",
})
#: A name after one of these tells of something else: a wrapper that has a sidebar is none.
_ABOUT = frozenset({"has", "have", "no", "not", "with", "without", "is", "section", "article", "entry", "post", "content", "main"})
#: On headings, paragraphs and cells these speak of looks, as in section-header; on a page's root no name says what the page is.
_LOOKS = frozenset({"header", "footer", "nav", "menu", "banner", "notice", "notices", "form", "search", "masthead", "related", "social", "promotion"})
_PLAIN = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "td", "th", "pre", "blockquote", "article", "main"})
_ROOT = frozenset({"html", "body"})
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SIMPLE = re.compile(r"(?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*\s*/?>")
_PAIR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+)))?")
_GAP, _KEY, _IS, _BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s=/>]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_TELLING = re.compile("class|id|role|hidden|style", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
_BLANK = re.compile(r"\s+")


def markup(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) with kind text, start, empty or end; each character is read a bounded number of times."""
    at = begin = 0
    n = len(page)
    unclosed: set[str] = set()  # quotes that don't come again: what was looked for in vain once is not looked for again
    while (lt := page.find("<", at)) >= 0:
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            if lt > begin:
                yield "text", page[begin:lt], {}
            for open_, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if page.startswith(open_, lt):
                    end = page.find(close, lt + len(open_))
                    break
            at = begin = end + len(close) if end >= 0 else n
            continue
        ends = follows == "/"
        m = _TAG_NAME.match(page, lt + 1 + ends)
        if m is None:  # a mere sign
            at = lt + 1
            continue
        if lt > begin:
            yield "text", page[begin:lt], {}
        name, at = m[0].lower(), m.end()
        found: dict[str, str] = {}
        simple = _SIMPLE.match(page, at)
        if simple:
            raw, at = simple[0], simple.end()
            if not ends and _TELLING.search(raw):
                found = {p[1].lower(): p[2] or p[3] or p[4] or "" for p in _PAIR.finditer(raw)}
            slash = raw.endswith("/>")
        else:
            slash = False
            while True:
                gap = _GAP.match(page, at)
                at = gap.end()
                if at >= n or page[at] == ">":
                    slash, at = gap[0].endswith("/"), min(n, at + 1)
                    break
                key = _KEY.match(page, at)
                at, value = key.end(), ""
                if is_ := _IS.match(page, at):
                    at = is_.end()
                    quote = page[at : at + 1]
                    end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in unclosed else -1
                    if end >= 0:
                        value, at = page[at + 1 : end], end + 1
                    else:
                        if quote in ("'", '"'):
                            unclosed.add(quote)
                        value = _BARE.match(page, at)[0]
                        at += len(value)
                if len(found) < 64:
                    found.setdefault(key[0].lower(), value)
        begin = at
        if ends:
            yield "end", name, {}
        elif name in _RAW_END:
            yield "raw", name, {}
            close_ = _RAW_END[name].search(page, at)
            at = begin = close_.end() if close_ else n
        else:
            yield "empty" if name in VOID or slash and name not in BLOCK else "start", name, found
    if n > begin:
        yield "text", page[begin:], {}


#: How much of the evidence is heard, in the order in which a page is read anew if nothing is left of it.
ALL, MEANT, NO_FORM = 2, 1, 0


def evidence(name: str, attributes: dict[str, str], heard: int = ALL) -> list[str]:
    """What an element says of itself: its meaning, and the parts of its class, id and role."""
    out = [f"<{name}>"] if name in MEANING and (heard > NO_FORM or name != "form") else []
    if not attributes or heard < ALL:
        return out
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        out.append("hidden")
    if name in _ROOT:
        return out
    for key in ("class", "id", "role"):
        for word in attributes.get(key, "").split():
            parts = [p.lower() for p in _PARTS.split(word) if p]
            for before, part in zip(["", *parts], parts, strict=False):
                if before not in _ABOUT and not part.isdigit() and not (name in _PLAIN and part in _LOOKS):
                    out.append(part)
    return out


@dataclass
class Scores:
    """Log odds by symbol and by name; unseen tags, words and names get the defaults."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)
    tag: float = -1.0
    word: float = 0.5
    tag_inside: float = -0.1
    left_out: float = -0.05

    def of_name(self, name: str) -> float:
        if name in self.names:
            return self.names[name]
        if name in ("<article>", "<main>"):
            return 4.0
        return math.log(PRIOR_IN / PRIOR_OUT) if name in USUAL or name[0] == "<" else 0.0

    def of(self, symbol: str, text: str, out: bool) -> float:
        if out:
            return self.left_out
        if text:
            return count(text) * self.words.get(symbol, self.word)
        if symbol.strip("<>+") in _RAW_END:  # what is no markup of the text parts nothing
            return 0.0
        return self.tags.get(symbol, self.tag_inside if symbol[-1] == "+" else self.tag)


def count(text: str) -> int:
    return min(RUN, len(text.split()))


def tokens(page: str, scores: Scores, heard: int = ALL) -> Iterator[tuple[str, str, bool, tuple[str, ...]]]:
    """(symbol, text, left out, names around): tags as <name> or </name>, words as the innermost block's name.

    Inside an article or main element symbols end with a plus. Mere white space has the symbol " ".
    """
    # name, whether a block, lowest evidence so far, whether inside an article, names so far
    stack: list[tuple[str, bool, float, bool, tuple[str, ...]]] = []
    open_: Counter = Counter()
    block, low, inside, names = "text", 0.0, False, ()
    blocks: list[str] = []
    single = len(re.findall("<article", page, re.IGNORECASE)) == 1

    def pop():
        nonlocal block, low, inside, names
        gone = stack.pop()
        open_[gone[0]] -= 1
        if gone[1]:
            blocks.pop()
        block = blocks[-1] if blocks else "text"
        low, inside, names = stack[-1][2:] if stack else (0.0, False, ())

    for kind, name, attributes in markup(page):
        if kind == "text":
            yield (block + "+" * inside, name, low < OUT, names) if name.strip() else (" ", name, low < OUT, names)
            continue
        if kind == "raw":
            yield f"<{name}>" + "+" * inside, "", low < OUT, names
            continue
        is_block = name in BLOCK
        if kind == "end":
            if not open_[name]:
                continue
            was = low < OUT, inside, names
            if is_block:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif stack[-1][0] == name:  # an inline end tag closes no blocks
                pop()
            yield f"</{name}>" + "+" * was[1], "", was[0], was[2]
            continue
        said = evidence(name, attributes, heard) if attributes or name in MEANING else []
        if is_block:  # a block closes an open paragraph, an item the item before it
            while open_["p"] and stack and (stack[-1][0] == "p" or not stack[-1][1]):
                pop()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                pop()
        own = min((scores.of_name(s) for s in said), default=0.0)
        content = own > 0 and (name == "main" or name == "article" and single)
        # a content element outweighs the names of its wrappers
        new = own if content else min(low, own)
        yield f"<{name}>" + "+" * inside, "", new < OUT, names
        if kind == "start" and (is_block or said):
            names = names if len(names) > 50 else (*names, *(s for s in said if s not in names))
            low, inside = new, inside or (content and new >= OUT)
            stack.append((name, is_block, low, inside, names))
            open_[name] += 1
            if is_block:
                blocks.append(name)
                block = name


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part of the greatest sum, the first of equals; (0, 0) if none is above zero."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def label(page: str) -> list[tuple[str, int, bool]] | None:
    """(symbol or name, weight, inside) of a page that marks its content with one article element; else None."""
    seq = [x for x in tokens(page, Scores()) if x[0] != " "]
    opens = [i for i, x in enumerate(seq) if x[0].startswith("<article>")]
    closes = [i for i, x in enumerate(seq) if x[0].startswith("</article>")]
    if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
        return None
    out = []
    for i, (s, t, left_out, names) in enumerate(seq):
        inside = opens[0] < i < closes[0] and not left_out
        # names are judged by all their words; symbols by those that no name speaks against
        if t:
            out += [(f"@{name}", count(t), inside) for name in names]
        if not left_out:
            out.append((s, count(t) if t else 1, inside))
    return out


def learn(counts: dict[tuple[str, bool], float]) -> Scores:
    """Scores from weights by (symbol, inside): words' log odds are kept above zero, tags' below; names start from their prior."""
    out = Scores()
    for s in sorted({s for s, _ in counts}):
        yes, no = counts.get((s, True), 0), counts.get((s, False), 0)
        if s.startswith("@"):
            name, prior = s[1:], Scores().of_name(s[1:])
            # the prior is worth PRIOR_OUT words, and an element's meaning ten times as much
            weight = PRIOR_OUT * (10 if name[0] == "<" else 1)
            odds = math.log((yes + weight * math.exp(prior) / (1 + math.exp(prior))) / (no + weight / (1 + math.exp(prior))))
            out.names[name] = max(-6.0, min(6.0, odds))
            continue
        odds = max(-6.0, min(6.0, math.log((yes + 1) / (no + 1))))
        if s.startswith("<"):
            # tags never carry a region; those of the content cost least
            out.tags[s] = -0.1 if odds > 0 else odds - 0.1
        else:
            out.words[s] = max(0.05, odds) if odds > -1 else 0.05
    return out


def fit(pages: DataFrame, most: int = SAMPLE) -> Scores:
    """Scores learned from the labelled ones among ``most`` pages, the first by a hash of their id."""
    sample = cut(bounded_sample(pages.select("page_id", "html"), "page_id", most).where(F.col("html").rlike("(?i)<article")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for s, n, inside in label(page) or ():
                    total[s, inside] += n
        keys = sorted(total)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["symbol", "inside", "n"])

    rows = sample.select("html").mapInArrow(counted, "symbol string, inside boolean, n long").groupBy("symbol", "inside").agg(F.sum("n").alias("n")).collect()
    return learn({(r.symbol, r.inside): r.n for r in rows})


def read(page: str, scores: Scores, heard: int = ALL, scan: bool = True) -> str:
    """The text of the best region (or of all, without the scan) without what the evidence that is heard leaves out."""
    seq = list(tokens(page, scores, heard))
    a, b = best_region([0.0 if x[0] == " " else scores.of(*x[:3]) for x in seq]) if scan else (0, len(seq))
    blocks, now = [], []

    def close():
        text = _BLANK.sub(" ", html.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    was = False
    for symbol, text, out, _ in seq[a:b]:
        if text:
            if not out:
                now.append(text)
        elif symbol.rstrip("+") == "<br>":
            now.append(" ")
        elif out != was or symbol.strip("</>+") in BLOCK:
            close()
        was = out
    close()
    return "\n\n".join(blocks)


def extract(page: str | None, scores: Scores) -> str:
    """The main text of a page; one that names leave nothing of is read without them, one that is a form as if it were none."""
    if not page:
        return ""
    return read(page, scores) or read(page, scores, MEANT) or read(page, scores, NO_FORM)


def extract_pages(pages: DataFrame, scores: Scores) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; a map without shuffle."""

    def make():
        def one(page_id, url, page):
            text = extract(page, scores)
            return page_id, url, text, len(text)

        return one

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages))
