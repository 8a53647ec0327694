"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised where they lie. Pieces (a document, or a part of one longer than the capacity) are dealt to
tasks by a hash and best-fit packed there in order of decreasing length. Bins with no more than ``SLACK`` tokens of
room are nearly full and final; the others go on as items to the next round, which has as many tasks as their number
asks for. Rounds end when one task has taken all that was left, or when a round joined hardly any of its bins
(``GAIN``): what is then open has no partners. No task holds more than about ``ITEMS`` items, however large the input
is, and every piece is in exactly one sequence.

Defined results: a null or empty text is one piece holding just the end token; a text of any length is tokenised whole
and cut into full pieces of which only the first may be shorter; the file's special tokens are read as such; ties go by
doc_id and piece, so a lost task packs the same bins again; repeated rows are packed each; an empty table gives no
rows; further columns are not touched.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import cut, table, text_or_empty

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one task of a round packs.
ITEMS = 50_000
#: A bin with no more room than this is nearly full, and final in every round. On the 9994 pieces of sf0.1 dealt out by 500,
#: 0 passes on 2615 bins and ends with 4489 sequences, 8 passes on 583 and ends with 4488 (4464 would be full throughout).
SLACK = 8
#: Rounds end when one joins less than this share of the bins that it took.
GAIN = 0.01
#: From so many white-space characters in a row on, the splitting rule is not left to tiktoken, whose stack a million overflow.
BLANKS = 4096


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library.

    The file's vocabulary and splitting rule are handed to tiktoken's merge loop, which gives the ids of ``tokenizers``
    (a test holds one against the other) at several times its speed.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.model = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blanks = re.compile(rf"\s{{{BLANKS}}}")

    def _plain(self, text: str) -> list[int]:
        if self.blanks.search(text):
            one = self.model._encode_single_piece
            known: dict[str, list[int]] = {}
            return [i for m in self.split.finditer(text) for i in (known[m[0]] if m[0] in known else known.setdefault(m[0], one(m[0])))]
        return self.model.encode_ordinary(text)

    def text(self, text: str) -> np.ndarray:
        if self.parts is None or not any(x in text for x in self.special):
            return np.array(self._plain(text), "<u4")
        ids: list[int] = []
        for part in self.parts.split(text):
            ids += [self.special[part]] if part in self.special else self._plain(part)
        return np.array(ids, "<u4")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 128).columns)
                rows = []
                for doc_id, text in zip(ids, texts, strict=True):
                    data = encoder.text(text).tobytes() + end
                    rows += [(doc_id, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(data) // 4, capacity))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin number of each length, taken in the given order; best fit by a bit set of the rooms that open bins have."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, bins, out = 0, 0, []
    for n in lengths:
        fitting = present >> n
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + n
            b = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        left = room - n
        if left:
            if not rooms[left]:
                present |= 1 << left
            rooms[left].append(b)
        out.append(b)
    return out


_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
_BINS = f"sequence_id long, fill long, final boolean, members {_MEMBERS}"


def _pack(level: int, capacity: int, slack: int):
    """Rows (fill, members) of one task, best-fit into bins; a task's rows come largest first."""
    target = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int64()), ("final", pa.bool_()), ("members", pa.list_(_ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (level << 56) | (context.partitionId() << 32)
        fills, parts = [], []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            parts.append(pa.Table.from_batches([batch]).select([1]))
        if not fills:
            return
        members = pa.concat_tables(parts).column(0).combine_chunks()
        members = members if isinstance(members, pa.ListArray) else pa.concat_arrays(members.chunks)
        where = np.array(best_fit(fills, capacity))
        # rows in order of their bins; their members then lie together
        order = np.argsort(where, kind="stable")
        sorted_members = members.take(pa.array(order))
        counts = np.diff(sorted_members.offsets.to_numpy())
        n_bins = int(where.max()) + 1
        sizes = np.bincount(where[order], weights=counts, minlength=n_bins).astype(np.int64)
        total = np.bincount(where, weights=np.array(fills), minlength=n_bins).astype(np.int64)
        # a member's offset is what lies before it in its bin
        flat = sorted_members.flatten()
        length = flat.field("length").to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        before = np.concatenate([[0], np.cumsum(length)])
        offset = before[:-1] - np.repeat(before[begins[:-1]], sizes)
        flat = pa.StructArray.from_arrays([*flat.flatten()[:-1], pa.array(offset, pa.int64())], fields=list(_ITEM))
        lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)
        out = pa.table([pa.array(base + np.arange(n_bins)), pa.array(total), pa.array(total >= capacity - slack), lists.cast(target.field(3).type)], schema=target)
        yield from out.to_batches(max_chunksize=4096)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = ITEMS, slack: int = SLACK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = cut(items)
    whole = items.where(F.col("length") >= capacity)
    member = F.struct(*names, F.lit(0).cast("long").alias("offset"))
    # rows that repeat each other are told apart, so that they are dealt to many tasks; the ids stand, as the items are cut
    rows = items.where(F.col("length") < capacity).select(F.col("length").alias("fill"), F.array(member).alias("members"), F.monotonically_increasing_id().alias("row"))
    count = rows.count()
    done, level = [], 0
    while True:
        tasks = max(1, -(-count // per_task))
        if tasks > 1:
            dealt = rows.withColumn("task", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(tasks)).cast("int")).repartitionByRange(tasks, "task")
        else:
            dealt = rows.coalesce(1)
        first = F.col("members")[0]
        ordered = dealt.sortWithinPartitions(F.desc("fill"), first["doc_id"], first["piece"], "row").select("fill", "members")
        bins = cut(ordered.mapInArrow(_pack(level, capacity, slack), _BINS))
        left, sized = bins.agg(F.count(F.when(~F.col("final"), 1)), F.count("*")).first()
        if tasks == 1 or count - sized < GAIN * count or left == 0:
            done.append(bins)
            break
        done.append(bins.where("final"))
        rows = bins.where("not final").select("fill", "members", F.col("sequence_id").alias("row"))
        count, level = left, level + 1
    out = reduce(DataFrame.unionByName, done).select("sequence_id", F.inline("members"))
    # a full piece is a sequence of its own
    alone = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.select(*names, "sequence_id", "offset").unionByName(alone)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path(VOCABULARY)))
