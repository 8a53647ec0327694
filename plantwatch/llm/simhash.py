"""SimHash near duplicates by covering locality-sensitive hashing.

Documents get a 64-bit SimHash of their word shingles. Every bit position is
given a vector of radius + 1 bits by a fixed rule; each nonzero vector v makes a
mask of the positions whose vector has an odd inner product with v. Two
fingerprints that differ in at most ``radius`` bits leave some v orthogonal to
all differing positions, so they agree under that v's mask: every pair within
the radius meets in some table, and none is missed.

Only distinct fingerprints enter the tables, so exact copies cost one entry.
Within a bucket the links are never listed as pairs: a search over the members
not yet reached yields a spanning forest. A bucket over ``BUCKET`` members is
dealt out once more by a covering of the bits that its members may differ in.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of
all words; repeated rows share fingerprint and component; an empty table gives
no rows; further columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import cut, map_rows, table, text_or_empty

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of a bucket that one task compares; larger buckets are dealt out again.
BUCKET = 20_000
#: Dropped documents whose ids are few enough to be sent to every task; more are joined by a shuffle.
SMALL_IDS = 200_000
#: Keys of buckets (some 60 bytes each) that are few enough to be sent to every task.
SMALL_KEYS = 500_000
#: Distinct fingerprints that one task deals out to the tables.
DEALT = 100_000
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of the lower-cased text's word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: just A-Z, just the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + _BLOCK)], ends[last + k :], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vectors(bits: list[int], radius: int = RADIUS) -> dict[int, int]:
    """A vector of radius + 1 bits for each bit position, spread evenly by a multiplicative rule."""
    full = (1 << (radius + 1)) - 1
    return {b: (i * 11 + 5) % full + 1 for i, b in enumerate(bits)}


def masks(bits: list[int] | range = range(64), radius: int = RADIUS) -> list[int]:
    """The covering family over ``bits``: for any ``radius`` of them some mask leaves out all."""
    of = vectors(list(bits), radius)
    return [sum(1 << b for b, m in of.items() if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def make():
        return lambda doc_id, text: (doc_id, signed(fingerprint(text)))

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, fp long")


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over values at most ``radius`` bits apart; memory in proportion to the values."""
    links, rest = [], values.copy()
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                frontier += list(found)
                rest = rest[~near]
    return links


def _dealt(fps: DataFrame, families: list[list[int]] | None = None) -> DataFrame:
    """A row for each fingerprint and table; ``families`` deals the rows of bucket (t, key) out again by family t."""
    if families is None:
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())])
        return fps.select("fp", F.inline(tables)).select("t", "key", "fp")
    whole = F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in f]) for f in families]), F.col("t") + 1)
    return fps.select("t", "fp", F.posexplode(whole).alias("t2", "mask")).select((F.col("t") * 64 + F.col("t2") + 1000).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _connect(dealt: DataFrame, most: int | None, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Links within the buckets of up to ``most`` members, and the members of the larger ones."""
    sized = cut(dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = sized.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    fits = F.col("n") <= most if most else F.lit(True)
    # few buckets hold more than two: where their keys can be sent to every task, only their members are shuffled again
    wanted = sized.where((F.col("n") > 2) & fits).select("t", "key")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_KEYS else wanted
    several = dealt.join(wanted, ["t", "key"], "left_semi")

    def forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fps in frame["fps"]:
                got = _forest(np.asarray(fps, np.int64).view(np.uint64), radius)
                yield pd.DataFrame(np.array(got, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    # a list is bounded by ``most``, or at the last level by the bits left free
    trees = several.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(forests, "a long, b long")
    if not most:
        return pairs.unionByName(trees), None
    large = sized.where(F.col("n") > most).select("t", "key")
    return pairs.unionByName(trees), None if large.isEmpty() else dealt.join(large, ["t", "key"], "left_semi")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect all pairs within the radius.

    Buckets are keyed by (table, masked bits). A mask leaves about 32 bits free
    and a second covering of those about 16, so that a bucket of the second
    level has at most some 2**17 possible members.
    """
    found, large = _connect(_dealt(fps), bucket, radius)
    if large is not None:
        families = [[m | x for x in masks([b for b in range(64) if not m >> b & 1], radius)] for m in masks()]
        found = found.unionByName(_connect(_dealt(large, families), None, radius)[0])
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternating large and small stars; each step is an aggregation and a join, so
    a node of many links is combined before the shuffle and split after it. The
    edge set is cut to the shared folder in each round.
    """
    before = None
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut, so that a node of very many links is split in the join
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points from the larger to the smaller end
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def clusters(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each document; a node is the smallest doc_id of a fingerprint."""
    found = cut(fingerprints(docs))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("node")))
    # each fingerprint becomes a row of every table, so they are spread first
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // DEALT))
    edges = links(nodes.select("fp").repartition(tasks), radius, bucket)
    name = lambda c: nodes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    edges = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = components(edges)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows that share a doc_id stay or go together.

    A row without a doc_id can't be named and stays.
    """
    gone = cut(clusters(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    if gone.count() <= SMALL_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
