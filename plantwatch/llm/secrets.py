"""Secret scan by character Markov models, with DataFrame functions only.

Base patterns find assignments, access keys and long hex strings. Beyond them, every run of ``SHORTEST`` key characters
or more, of whatever kind, is judged by two first-order Markov models over characters, one of random strings and one of
ordinary identifiers: the log of their likelihood ratio, summed over the string's character pairs, decides. Both models
are counted from labelled samples: hashes written in the usual alphabets are random; words of a bounded sample of
documents, without the runs that the base patterns take, numbers, and the names of this platform's functions are
ordinary.

Offsets come from the text's split at the pattern: what lies between the matches and the matches themselves, added up in
blocks, in time linear in their number for all but enormous numbers; only texts that hold what is judged random need them.
Runs that a base span takes are left to it: what an assignment holds is matched with it, and the other base patterns lie
within one run.

Defined results: a null or empty text has no spans; a text of any length is read whole; rows are independent of each
other; with no documents the ordinary model rests on function names alone; further columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import bounded_sample, table

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# The whole of a run that is long enough: shorter runs are dropped without a second try, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: a whole run of key characters; shorter ones don't hold enough evidence.
SHORTEST = 10
_KEY = "[A-Za-z0-9+/_-]"
#: An assignment, or else a run that doesn't reach into one (group 2).
JUDGED = (
    rf"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+)"
    rf"|(?<![\p{{L}}\p{{N}}+/_-])(?={_KEY}{{{SHORTEST}}})(?!{_KEY}*?(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{6}})({_KEY}++(?![\p{{L}}\p{{N}}])={{0,2}})"
)
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
KINDS = ("assign", "access", "hex", "random")

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Documents whose words train the ordinary model, at most; random strings of each alphabet.
SAMPLE, RANDOM = 1000, 1000
#: Least log-likelihood ratio in all, and for each pair of characters.
LEAST, LEAST_MEAN = 10.0, 0.5


def samples(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(random, s): the labelled strings."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    raw = F.unhex(digest)
    alphabets = (digest, F.upper(digest), F.base64(raw), F.translate(F.base64(raw), "+/", "-_"), F.conv(F.substring(digest, 1, 15), 16, 36), F.regexp_replace(F.base64(raw), "[^A-Za-z0-9]", ""))
    random = spark.range(RANDOM).select(F.explode(F.array(*alphabets)).alias("s")).select(F.lit(1).alias("random"), "s")
    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", most).where(F.col("text").isNotNull())
    words = sample.select(F.explode(F.expr(r"regexp_extract_all(text, '(?<![\\p{L}\\p{N}+/_-])[A-Za-z0-9+/_-]{4,64}+(?![\\p{L}\\p{N}+/_-])', 0)")).alias("s"))
    # what mixes letters with digits may be a key; words with a digit at most and plain numbers are ordinary, whatever they are
    words = words.where(~F.col("s").rlike(HEX) & ~F.col("s").rlike(ACCESS) & (~F.col("s").rlike("[0-9][^0-9]*[0-9]") | F.col("s").rlike("^[0-9+/_-]+$")))
    names = sorted(n for n in dir(F) if not n.startswith("__"))
    named = spark.range(1).select(F.explode(F.split(F.lit(",".join(names)), ",")).alias("s"))
    # numbers are no keys, whatever their digits
    numbers = spark.range(RANDOM).select(F.conv(F.substring(digest, 1, 13), 16, 10).alias("s"))
    return random.unionByName(words.unionByName(named).unionByName(numbers).select(F.lit(0).alias("random"), "s"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(random, a, b, n): how often b follows a."""
    chars = rows.select("random", F.filter(F.split("s", ""), lambda c: c != "").alias("c")).where(F.size("c") > 1)
    pairs = F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))
    return chars.select("random", F.inline(pairs)).groupBy("random", "a", "b").agg(F.count("*").alias("n"))


def log_ratios(counts: list[tuple[int, str, str, int]], smooth: float = 0.5) -> list[float]:
    """For each pair of letters, in the order of LETTERS, log P(b | a, random) - log P(b | a, ordinary)."""
    k = len(LETTERS)
    n = [[[smooth] * k for _ in range(k)] for _ in (0, 1)]
    place = {c: i for i, c in enumerate(LETTERS)}
    for random, a, b, count in counts:
        if a in place and b in place:
            n[random][place[a]][place[b]] += count
    # rows shrink to the letters' overall shares, so that a letter that is rare in one sample doesn't count as proof
    out = []
    share = [[sum(m[i][j] for i in range(k)) for j in range(k)] for m in n]
    total = [sum(s) for s in share]
    for i in range(k):
        p = [[(n[y][i][j] + 5 * share[y][j] / total[y]) / (sum(n[y][i]) + 5) for j in range(k)] for y in (0, 1)]
        out += [max(-4.0, min(4.0, math.log(p[1][j] / p[0][j]))) for j in range(k)]
    return out


def fit(docs: DataFrame, most: int = SAMPLE) -> list[float]:
    """The table of log ratios; what is collected is at most two counts for each pair of letters."""
    known = pair_counts(samples(docs, most)).where((F.instr(F.lit(LETTERS), F.col("a")) > 0) & (F.instr(F.lit(LETTERS), F.col("b")) > 0))
    return log_ratios([(r.random, r.a, r.b, r.n) for r in known.collect()])


def ratio(s: Column, table_: list[float]) -> Column:
    """The log-likelihood ratio of a string."""
    values = F.split(F.lit(",".join(f"{v:.6f}" for v in table_)), ",").cast("array<double>")
    place = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c))
    first = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    second = lambda p: F.slice(p, F.lit(2), F.size(p) - 1)
    scores = F.zip_with(first(place), second(place), lambda a, b: F.try_element_at(values, (a - 1) * len(LETTERS) + b))
    return F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: Matches that are added up one by one; sums of such blocks are added up in turn.
_BLOCK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def spans(text: str, pattern: str, kind: int, group: int = 0, flags: Column | None = None) -> Column:
    """Matches with code-point offsets; ``value`` is the match's group, or null for a match that has none of it. With flags, one for each match, only those that are set."""
    quoted = _quoted(pattern)
    gaps = F.transform(F.expr(f"split({text}, '{quoted}', -1)"), F.length)
    hits = F.expr(f"regexp_extract_all({text}, '{quoted}', 0)")
    values = F.expr(f"regexp_extract_all({text}, '{quoted}', {group})") if group else hits
    columns = [gaps.alias("gap"), F.transform(hits, F.length).alias("size"), values.alias("value")] + ([] if flags is None else [flags.alias("flag")])
    zero, size = F.lit(0).cast("long"), F.lit(_BLOCK)
    width = lambda t, x: t + x["gap"] + x["size"]

    def placed(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, width))
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("bases"))
        bases = F.aggregate(sums, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")))["bases"]

        def block(b):
            one = lambda x, i: _let(b["base"] + F.aggregate(F.slice(b["rows"], F.lit(1), i), zero, width) + x["gap"], lambda a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + x["size"]).alias("end"), x["value"].alias("value"), *([] if flags is None else [x["flag"].alias("flag")])))
            return F.transform(b["rows"], one)

        return F.flatten(F.transform(F.arrays_zip(blocks.alias("rows"), bases.alias("base")), block))

    def blocked(rows):
        return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda k: F.slice(rows, k * size + 1, size)), placed)

    # the last gap follows the last match
    zipped = F.filter(F.arrays_zip(*columns), lambda x: x["size"].isNotNull())
    found = F.when(F.size(hits) > 0, _let(zipped, blocked))
    if flags is not None:
        found = F.transform(F.filter(found, lambda s: s["flag"]), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    return F.coalesce(found.cast(_SPAN), F.array().cast(_SPAN))


def found(docs: DataFrame, table_: list[float]) -> DataFrame:
    """doc_id with arrays ``base`` and ``more`` of spans."""
    none = F.array().cast(_SPAN)
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the full work is only done for texts that hold a match at all
    assign = F.when(text.rlike(ASSIGN), F.filter(spans("text", ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6)).otherwise(none)
    access = F.when(text.contains("AKIA") & text.rlike(ACCESS), spans("text", ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), spans("text", HEX, 2)).otherwise(none)

    def random(s):
        score = ratio(s, table_)
        enough = lambda x: (x >= LEAST) & (x >= LEAST_MEAN * (F.length(s) - 1))
        return F.when(F.length(F.coalesce(s, F.lit(""))) < SHORTEST, False).otherwise(_let(score, enough) & ~s.rlike(HEX) & ~s.rlike(ACCESS) & ~s.rlike(UUID))

    flags = F.transform(F.expr(f"regexp_extract_all(text, '{_quoted(JUDGED)}', 2)"), random)
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(assign, access, hexes)).alias("base"), flags.alias("flags"))
    more = F.when(F.exists("flags", lambda x: x), spans("text", JUDGED, 3, 2, F.col("flags"))).otherwise(none)
    return rows.select("doc_id", "base", more.alias("more"))


def written(spans_: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def scan_documents(docs: DataFrame, table_: list[float] | None = None) -> DataFrame:
    """A row of counts and spans for each document; one pass without shuffle."""
    rows = found(docs, fit(docs) if table_ is None else table_)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select(
        "doc_id", *counts, F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base"))).alias("spans"), F.size("more").cast("long").alias("n_random"),
    )


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
