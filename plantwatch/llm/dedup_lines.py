"""Substring dedup by hashing normalised lines, paragraphs and passages.

The units of a text are its lines (or paragraphs, or sentences: ``UNITS``), whatever their length. They are normalised
(case, punctuation and white space) and hashed to 128 bits; digests are grouped over all documents, the earliest
occurrence by (doc_id, start) stays, and every other is reported with its offsets in the source.

A passage glued to words of its host shares no whole line with its other places. So the query also takes units that
only depend on the words they hold: words are cut wherever the hash of three of them is the least among its
neighbours, and from each cut the words up to the next one that makes it long enough are a unit.

Short lines repeat by chance (a greeting, a licence line), and clean documents hold them. What goes is decided for the
stretch that repeated units cover without a gap: it goes if it holds at least ``RUN`` words, so a short line goes as
part of a repeated passage, and a passage goes whatever units it was cut into. ``run=1`` reports every unit.

Digests are counted before the shuffle, so a unit that a third of all rows share is one row from each task. The first
occurrences are cut to the shared folder before they are joined, so both sides of the join are exchanges and the
partition of a hot digest is split at run time.

Defined results: a null or empty text has no units; a row without a doc_id is left out, as it can't be ranked (and
``remove`` returns it whole); equal units of one document also repeat each other; of rows that repeat a doc_id and a
text one is the first, the others repeat all of its units; texts of any length are read whole; an empty table gives no
rows; further columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.llm.common import cut, table, text_or_empty, written

#: A unit between content-defined cuts holds so many words at least, and so does a sentence.
WORDS = 8
#: A repeated stretch goes from so many words on.
RUN = 24

# scripts without spaces: Thai, Lao, Burmese, Khmer, Chinese, Japanese
_CHARS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3105-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SPACELESS = re.compile(f"[{_CHARS}]")
# full stops of scripts without spaces need no white space after them
_END = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*(?=\s)|[。！？｡]+[\"'»”’)\]」』）]*")
_WORDS = re.compile(r"\w+")
# there, each character is a word to be cut at
_TOKENS = re.compile(rf"[{_CHARS}]|[^\W{_CHARS}]+")
#: A line of sentences shorter than this on average (shouting, lists) is one unit.
TERSE = 4


class Words:
    """The words of a text: where they lie, what they are in lower case, and how much lies before each.

    In a script without spaces each character is a word that weighs half.
    """

    def __init__(self, text: str):
        self.text, self.spaced = text, text.isascii() or not _SPACELESS.search(text)
        pattern, lower = _WORDS if self.spaced else _TOKENS, text.lower()
        if text.isascii():
            word = np.zeros(len(text) + 2, bool)
            word[1:-1] = _WORD_BYTES[np.frombuffer(text.encode(), np.uint8)]
            edge = np.flatnonzero(word[1:] != word[:-1])
            self.starts, self.ends = edge[::2], edge[1::2]
            self.words = pattern.findall(lower)
        else:
            spans = np.fromiter((x for m in pattern.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
            self.starts, self.ends = spans[:, 0], spans[:, 1]
            # some letters have a longer lower case, and offsets are those of the source
            self.words = pattern.findall(lower) if len(lower) == len(text) else [text[a:b].lower() for a, b in spans.tolist()]
            if len(self.words) != len(self.starts):
                self.words = [text[a:b].lower() for a, b in spans.tolist()]
        if self.spaced:
            self.before = 2 * np.arange(len(self.words) + 1)
        else:
            self.before = np.concatenate([[0], np.cumsum([1 if _SPACELESS.match(w) else 2 for w in self.words])]).astype(np.int64)

    def unit(self, i: int, j: int, a: int, b: int) -> tuple[int, int, int, int, int, int]:
        """(start, end, from, to, high, low) of words i to j, which lie in the span from a to b."""
        h = blake2b(" ".join(self.words[i:j]).encode(), digest_size=16).digest()
        return a, b, int(self.before[i]), int(self.before[j]), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)

    def of_spans(self, spans: Iterable[tuple[int, int]], least: int = 1) -> Iterator[tuple[int, int, int, int, int, int]]:
        """A unit for each span that holds enough words, without the white space around it."""
        spans = list(spans)
        first = np.searchsorted(self.starts, [a for a, _ in spans]).tolist()
        last = np.searchsorted(self.starts, [b for _, b in spans]).tolist()
        for (a, b), i, j in zip(spans, first, last, strict=True):
            if i < j and self.before[j] - self.before[i] >= 2 * least - (least == 1):
                raw = self.text[a:b]
                yield self.unit(i, j, a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip()))


_WORD_BYTES = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)] + [False] * 128)


def _parted(text: str, by: str) -> Iterator[tuple[int, int]]:
    start = 0
    for part in text.split(by):
        yield start, start + len(part)
        start += len(part) + len(by)


def lines(words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Every line that holds a word."""
    return words.of_spans(_parted(words.text, "\n"))


def paragraphs(words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """What blank lines part; a paragraph of one line is a line."""
    return words.of_spans(_parted(words.text, "\n\n"))


def _sentence_spans(text: str) -> Iterator[tuple[int, int]]:
    for start, stop in _parted(text, "\n"):
        line = text[start:stop]
        ends = [start + m.end() for m in _END.finditer(line)]
        if len(ends) > 2 and line.count(" ") < TERSE * len(ends):
            ends = []
        done = start
        for e in [*ends, stop]:
            if e > done:
                yield done, e
                done = e


def sentences(words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The sentences of each line, of WORDS words or more."""
    return words.of_spans(_sentence_spans(words.text), WORDS)


#: A cut is the least hash among as many on either side, so cuts are REACH + 1 words apart at least, 2 * REACH + 1 on average.
REACH = 5
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def content_cuts(words: list[str]) -> np.ndarray:
    """Places in ``words`` that depend on the words nearby only: REACH before and REACH + 2 after."""
    known: dict[str, int] = {w: crc32(w.encode()) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < 2 * REACH + 3:
        return np.zeros(0, np.int64)
    g = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
    g = (g ^ (g >> np.uint64(29))) * _MIX[1]
    n = len(g) - 2 * REACH
    middle, least = g[REACH : REACH + n], np.ones(n, bool)
    for k in range(REACH):
        least &= (middle < g[k : k + n]) & (middle <= g[REACH + 1 + k : REACH + 1 + k + n])
    return np.flatnonzero(least) + REACH


def passages(words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The units between content-defined cuts, whatever lines and sentences they lie in."""
    cuts = content_cuts(words.words)
    if len(cuts) < 2:
        return
    # from each cut, the next one that makes it long enough
    weight = words.before[cuts]
    until = np.searchsorted(weight, weight + 2 * WORDS).tolist()
    starts, ends = words.starts[cuts].tolist(), words.ends[cuts - 1].tolist()
    cuts = cuts.tolist()
    for k, j in enumerate(until):
        if j < len(cuts):
            yield words.unit(cuts[k], cuts[j], starts[k], ends[j])


Unit = tuple[int, int, int, int, int, int]
UNITS: dict[str, Callable[[Words], Iterator[Unit]]] = {"line": lines, "paragraph": paragraphs, "sentence": sentences, "passage": passages}


def units(text: str, kinds: Iterable[str] = ("line", "passage")) -> Iterator[Unit]:
    """(start, end, from, to, high, low) of the units of some kinds, each span once; from and to count half words."""
    words, seen = Words(text), set()
    for kind in kinds:
        for u in UNITS[kind](words):
            if u[:2] not in seen:
                seen.add(u[:2])
                yield u


def unit_rows(docs: DataFrame, kinds: Iterable[str] = ("line", "passage")) -> DataFrame:
    """(row, doc_id, start, end, from, to, high, low) of every unit; ``row`` numbers the documents' rows."""
    schema = "row long, doc_id long, start long, end long, `from` long, `to` long, high long, low long"
    target = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "start", "end", "from", "to", "high", "low")])
    kinds = tuple(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                numbers, ids, texts = (c.to_pylist() for c in batch.slice(at, 128).columns)
                rows = [(n, i, *u) for n, i, t in zip(numbers, ids, texts, strict=True) for u in units(t, kinds)]
                for k in range(0, len(rows), 50_000):
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 50_000], strict=True)], schema=target)

    return docs.where("doc_id is not null").select("row", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, schema)


def _repeated(docs: DataFrame, run: int, kinds: Iterable[str]) -> DataFrame:
    """Units of numbered documents that an earlier place holds too, numbered by ``stretch``; stretches hold ``run`` words or more."""
    found = written(unit_rows(docs, kinds), "units")
    first = cut(found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "row")).alias("first")).where("n > 1"))
    later = found.join(first, ["high", "low"]).where(F.struct("doc_id", "start", "row") != F.col("first"))
    in_order = Window.partitionBy("row").orderBy("from", "to", "start", "end")
    reached = F.max("to").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("begins", (reached.isNull() | (F.col("from") > reached)).cast("int"))
    marked = marked.withColumn("stretch", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    if run <= 1:
        return marked
    whole = Window.partitionBy("row", "stretch")
    return marked.withColumn("held", F.max("to").over(whole) - F.min("from").over(whole)).where(F.col("held") >= 2 * run).drop("held")


def repeats(docs: DataFrame, run: int = RUN, kinds: Iterable[str] = ("line", "passage")) -> DataFrame:
    """The units to remove: a row for each occurrence but the earliest of its digest, with that one's place."""
    later = _repeated(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), run, kinds)
    digest = F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))).alias("digest")
    n_words = F.ceil((F.col("to") - F.col("from")) / 2).cast("long").alias("n_words")
    return later.select("doc_id", "start", "end", n_words, digest, F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), F.col("n").alias("occurrences"))


def remove(docs: DataFrame, run: int = RUN, kinds: Iterable[str] = ("line", "passage")) -> DataFrame:
    """All documents with repeated stretches cut out of ``text``, and ``kept``: (at, start, end) of each piece that stays.

    A piece stands at ``at`` in the new text and at ``start`` to ``end`` in the source; a column of that name is
    replaced. The documents are written to the
    shared folder once, as their rows are numbered.
    """
    names = docs.columns
    numbered = cut(docs.select(F.struct(*names).alias("source"), F.monotonically_increasing_id().alias("row")))
    gone = _repeated(numbered.select("row", "source.doc_id", "source.text"), run, kinds).groupBy("row", "stretch").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    # the piece before each stretch, and what is left behind the last
    before = Window.partitionBy("row").orderBy("a")
    done, lost = F.coalesce(F.lag("b").over(before), F.lit(0)), F.coalesce(F.sum(F.col("b") - F.col("a")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = gone.select("row", "a", "b", done.alias("start"), (done - lost).alias("at"))
    listed = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "start", F.col("a").alias("end")))).alias("pieces"), F.max("b").alias("b"), F.sum(F.col("b") - F.col("a")).alias("lost"))
    text, zero = F.col("source.text"), F.lit(0).cast("long")
    tail = F.struct((F.coalesce("b", zero) - F.coalesce("lost", zero)).alias("at"), F.coalesce("b", zero).alias("start"), F.length(text).cast("long").alias("end"))
    kept = F.filter(F.concat(F.coalesce("pieces", F.array().cast("array<struct<at:bigint,start:bigint,end:bigint>>")), F.array(tail)), lambda p: p["end"] > p["start"])
    out = numbered.join(listed, "row", "left").select("source", F.when(text.isNotNull(), kept).alias("kept"))
    joined = F.array_join(F.transform("kept", lambda p: text.substr(p["start"].cast("int") + 1, (p["end"] - p["start"]).cast("int"))), "")
    return out.select(*[joined.alias(n) if n == "text" else F.col("source")[n].alias(n) for n in names if n != "kept"], "kept")


def op7_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
