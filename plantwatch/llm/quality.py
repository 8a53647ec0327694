"""Quality rules with zstandard compression bands.

A document's compression ratio (compressed bytes over bytes) is held against a
band that depends on its length, as a whole and chunk by chunk. Below the band
the text repeats itself, above it the text is noise. Base rules on words and on
repeated three-word windows come first.

Defined results: a null or empty text has no words and fails the base rules; a
text of any length is read whole; rows are independent of each other.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plantwatch.llm.common import map_rows, table, text_or_empty

LEVEL = 3
CHUNK = 4096
#: (bytes from, least ratio, greatest ratio). Frames cost short texts more, so short bands are wider and narrower in length. Each
#: greatest ratio lies above what texts of 50 words or more reach at the band's start (sf0.1 and technical English: 0.82 at 256
#: bytes, 0.84 at 384, 0.79 at 512, 0.69 at 1024, 0.61 at 2048) and below random base64 words at its end (0.86 at 256, 0.85 at
#: 384, 0.82 at 512, 0.79 at 1024, 0.77 at 2048). Under 256 bytes few texts have 50 words, and technical English came to 0.83 there once.
BANDS = (
    (0, 0.0, 0.73), (128, 0.25, 0.73), (160, 0.25, 0.81), (192, 0.25, 0.82), (256, 0.25, 0.85), (320, 0.25, 0.845), (384, 0.25, 0.84), (416, 0.25, 0.83), (448, 0.25, 0.82),
    (512, 0.18, 0.80), (640, 0.18, 0.79), (768, 0.18, 0.755), (1024, 0.18, 0.74), (1536, 0.18, 0.74), (2048, 0.14, 0.74), (8192, 0.10, 0.72), (32768, 0.08, 0.70),
)
CHUNK_BAND = (0.10, 0.74)
#: A text is rejected when this share of its chunks lies outside the chunk band, or so many in a row.
CHUNK_SHARE, CHUNK_RUN = 0.1, 3

_SYMBOLS = re.compile(r"[#*$%&|<>]")
# str.split() and str.isspace() know more white space than the rule's six characters
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if n_bytes >= start)


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found at least twice, counted once each."""
    n = len(words)
    if n < 4:  # two windows at least
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    base = len(ids)
    if base < 2_000_000:  # three ids fit into 63 bits
        windows = (code[:-2] * base + code[1:-1]) * base + code[2:]
    else:
        _, pairs = np.unique(code[:-1] * base + code[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * base + code[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> dict:
    text = text or ""
    data = text.encode()
    if text.isascii():
        words = text.split() if not _ODD_SPACE.search(text) else _WORDS.findall(text)
        word_chars = sum(map(len, words))
    else:
        words = data.split()  # bytes know just the six characters of white space
        word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    n_words, repeats = len(words), repeated_words(words)
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    low, high = band(len(data))
    why = "" if low <= ratio <= high else "repetitive" if ratio < low else "incompressible"
    bad = chunks = run = longest = 0
    if len(data) > CHUNK:
        view = memoryview(data)
        # the last chunk ends where the text does
        for start in [*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK]:
            share = len(compressor.compress(view[start : start + CHUNK])) / CHUNK
            outside = not CHUNK_BAND[0] <= share <= CHUNK_BAND[1]
            chunks += 1
            bad += outside
            run = run + 1 if outside else 0
            longest = max(longest, run)
        if not why and (bad and bad >= CHUNK_SHARE * chunks or longest >= CHUNK_RUN):
            why = "chunks"
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": len(_SYMBOLS.findall(text)), "n_dup_lines": len(lines) - len(Counter(lines)), "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": not base_failed and not why, "ratio": ratio, "chunks": chunks, "chunks_outside": bad, "reason": "base" if base_failed else why,
    }


# str.split() also splits at these, the rule does not
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, chunks_outside long, reason string"


def score_documents(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for each document; a map without shuffle."""

    def make():
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return lambda doc_id, text: (doc_id, *measure(text, compressor).values())

    return map_rows(docs.select("doc_id", text_or_empty()), make, SCHEMA)


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
