"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are canonicalised to templates: numbers, names and units become typed
placeholders, case and punctuation go. Windows of five template words of the
documents meet those of the benchmark by hash. Wherever one meets, the whole
benchmark item is laid along the document at that place and compared word by
word, so a row is judged from what it holds itself. What covers enough of an
item's windows and fills its slots consistently (equal values of the item are
equal in the document) is a leak, be it a copy or a re-parameterised question.

Windows are taken at every place of both, whatever they hold: each common run of
five words is met. An item is laid along where such a run begins, once for each
run. An item with hardly a word that is no placeholder would be met by any
list of numbers or names, so its slots have to hold the very same values.

A text of fewer than five words is one window of all of them, so an item as short
leaks where a document holds it and nothing else. A word that is taken for a name
on one side only (as in capitals throughout) still is the word it is: words are
equal as templates or as they are written.

The benchmark's windows are broadcast after their number has been checked;
a larger benchmark is joined by a shuffle of hashes and places, where hot windows
are split at run time, and only documents that met fetch their words.

Defined results: null and empty texts match nothing, nor do texts without a word; repeated rows of a document are one document; repeated
benchmark items are reported each; texts of any length are read whole; empty
tables give no rows; further columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import cut, table

WIDTH = 5
#: Share of an item's windows that a document covers.
COVERAGE = 0.8
#: Words in an item that are no placeholders, at least; else it says too little without its values.
LITERALS = 3
#: Benchmark windows, and characters of its texts, that are small enough to be sent to every task: some 60 bytes for each
#: window, and about ten for each character, as its words are held in two arrays; 30 MB and 80 MB at most.
SMALL, SMALL_CHARS = 500_000, 8_000_000
#: Leaking documents whose ids are few enough to be sent to every task.
SMALL_IDS = 200_000

# Common units of measure and money.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "j", "kj", "v", "a", "k", "c", "f", "pa", "bar",
    "percent", "usd", "eur", "gbp", "dollar", "dollars", "cent", "cents", "euro", "euros", "degrees", "degree", "kb", "mb", "gb", "tb",
)
_NAME, _NUMBER, _UNIT = "@n", "@d", "@u"


def _sub(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def plain(text: Column) -> Column:
    """Lower-case words with single spaces; a capitalised word inside a sentence is marked by \\x01."""
    marked = _sub(F.coalesce(text.cast("string"), F.lit("")), (r"[\x01@]", " "), (r"(?<=[\p{Ll}\p{N},;:)]\s)(?=\p{Lu}[\p{Ll}\p{M}])", "\x01"), (r"(?<=[0-9])[.,:](?=[0-9])", ""), (r"(?<=[0-9])(?=\p{L})", " "))
    return F.trim(_sub(F.lower(marked), (r"[^\p{L}\p{M}\p{N}\s\x01]+", ""), (r"\x01*\s+\x01*(?=\s|$)", " "), (r"\s+", " ")))


def template(words: Column) -> Column:
    """The words of ``plain`` with placeholders, word for word."""
    return _sub(words, (r"\x01[^ ]+", _NAME), (r"(?<![^ ])\p{N}+(?![^ ])", _NUMBER), (rf"(?<={_NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", _UNIT))


def _windows(rows: DataFrame, words: str, at: str) -> DataFrame:
    """The rows with a row for each window, its place ``at`` and its ``hash``; fewer words than a window make one of all.

    No lambdas and no inferred filter: all of it runs in compiled code, and a text is neither copied for each of its
    windows nor worked out twice.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))
    dealt = rows.select("*", F.explode(starts).alias(at))
    return dealt.withColumn("hash", F.xxhash64(*[F.get(words, F.col(at) + i) for i in range(WIDTH)]))


def _words(rows: DataFrame, key: str, template_as: str, raw_as: str) -> DataFrame:
    """(key, template words, words as written), each made once, of texts with a word."""
    said = rows.where(F.col(key).isNotNull()).select(key, plain(F.col("text")).alias("said")).where("said <> ''")
    return said.select(key, F.split(template(F.col("said")), " ").alias(template_as), F.split(F.translate("said", "\x01", ""), " ").alias(raw_as))


def benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, item, raw) with word arrays, and (item_key, place, hash, before) of all their windows; ``before`` is the word before."""
    items = _words(benchmark.select("item_id", "text"), "item_id", "item", "raw")
    items = cut(items.distinct().withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "item"), F.concat_ws(" ", "raw"))))
    windows = _windows(items.select("item_key", "item"), "item", "place")
    return items, cut(windows.select("item_key", "place", "hash", F.get("item", F.col("place") - 1).alias("before")))


def _covered(here: Column, item: Column, said: Column, raw: Column) -> Column:
    """Places of the item's windows that the words laid along it hold too, as templates or as written."""
    same = F.zip_with(F.arrays_zip(here.alias("t"), said.alias("w")), F.arrays_zip(item.alias("t"), raw.alias("w")), lambda a, b: a["t"].eqNullSafe(b["t"]) | a["w"].eqNullSafe(b["w"]))
    width = F.least(F.size(item), F.lit(WIDTH))
    # a short item has to be the whole document, which is what a window of fewer words says
    return F.filter(F.sequence(F.lit(1), F.size(item) - width + 1), lambda i: F.forall(F.slice(same, i, width), lambda x: x))


def _consistent(item: Column, raw: Column, here: Column, said: Column) -> Column:
    """Whether equal slot values of the item are equal in the document, over the slots that are laid on slots; of an item that is hardly more than slots, whether they are the item's own."""
    laid = F.arrays_zip(item.alias("i"), raw.alias("r"), here.alias("h"), said.alias("s"))
    slots = F.filter(laid, lambda x: x["i"].startswith("@") & x["i"].eqNullSafe(x["h"]))
    asked = F.array_distinct(F.transform(slots, lambda x: F.concat(x["i"], x["r"])))
    filled = F.array_distinct(F.transform(slots, lambda x: F.concat(x["i"], x["r"], F.lit(" "), x["s"])))
    literal = F.size(F.filter(item, lambda w: ~w.startswith("@")))
    own = F.forall(slots, lambda x: x["r"] == x["s"])
    return (F.size(asked) == F.size(filled)) & ((literal >= LITERALS) | own)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, covered, coverage, first_word): a row for each document and the item it holds."""
    items, windows = benchmark_tables(benchmark)
    sizes = items.agg(F.sum(F.length(F.concat_ws(" ", "raw")))).first()[0] or 0
    small = windows.count() <= SMALL and sizes <= SMALL_CHARS
    words = _words(docs.select("doc_id", "text"), "doc_id", "words", "said")
    place = F.col("k") - F.col("place")
    # where the words before are equal too, the windows before have met at the same place
    begins = F.col("before").isNull() | F.col("said_before").isNull() | (F.col("before") != F.col("said_before"))
    if small:  # one pass: a row that meets nothing ends where it was dealt out, and the words of one that does are at hand
        met = _windows(words, "words", "k").join(F.broadcast(windows), "hash").withColumn("said_before", F.get("words", F.col("k") - 1)).where(begins).withColumn("at", place).drop("hash", "k", "place", "before", "said_before").join(F.broadcast(items), "item_key")
    else:  # hashes and places are shuffled; then the items, and last the words of the documents that met
        words = words.withColumn("text_key", F.xxhash64("said"))
        dealt = _windows(words, "words", "k").select("doc_id", "text_key", "k", "hash")
        places = cut(dealt.join(windows.hint("merge"), "hash").select("doc_id", "text_key", "item_key", place.alias("at")).distinct())
        ids = cut(places.select("doc_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
        met = places.join(items, "item_key").join(words.join(ids, "doc_id", "left_semi"), ["doc_id", "text_key"])
    # the item may begin before the document does, or end after it
    skip = F.greatest(F.lit(0), -F.col("at"))
    along = lambda a: F.concat(F.array_repeat(F.lit(""), skip), F.slice(a, F.greatest(F.lit(0), F.col("at")) + 1, F.size("item") - skip))
    laid = met.select("doc_id", "item_key", "item_id", "item", "raw", "at", along(F.col("words")).alias("here"), along(F.col("said")).alias("said"))
    judged = laid.select("doc_id", "item_key", "item_id", "at", F.size("item").alias("n"), _covered(F.col("here"), F.col("item"), F.col("said"), F.col("raw")).alias("places"), _consistent(F.col("item"), F.col("raw"), F.col("here"), F.col("said")).alias("fits"))
    # one item may be met in parts that edits have shifted: their places are put together
    whole = judged.where("fits").groupBy("doc_id", "item_key").agg(F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.min("at").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    out = whole.select("doc_id", "item_id", F.greatest(F.col("n") - WIDTH + 1, F.lit(1)).cast("long").alias("n_windows"), F.size("places").cast("long").alias("covered"), F.greatest(F.col("first_word"), F.lit(0)).cast("long").alias("first_word"))
    return out.withColumn("coverage", F.col("covered") / F.col("n_windows")).where(F.col("coverage") >= coverage).distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; a row without a doc_id is judged by its text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    found = cut(leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct())
    if found.count() <= SMALL_IDS:
        found = F.broadcast(found)
    return docs.join(found, key == found["_key"], "left_anti").select(*docs.columns)


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
