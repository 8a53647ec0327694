"""WARC archives and their index, merged from sorted capture runs.

Pages are written as WARC 1.1 response records (an HTTP response of the page) into the shared folder. Tasks number
their archives by the bytes that they have written, so an archive holds ``ARCHIVE`` payload bytes and at most one page
more, however large pages are and wherever they lie. The text sink writes them: a record is a row, and the line
separator is the pair of line ends that closes a record, so any file system that Spark knows will do and a lost task
leaves nothing behind. Reading takes an archive at a time, unpacks it piece by piece and walks record by record along
Content-Length; ``offset`` counts unpacked bytes.

Each archive gives a capture run, sorted by URL key, timestamp and page. Splitters from a sample of all runs cut each
run into segments, in order as they are; a segment is one row of the shuffle, so nothing is sorted again. A loser tree
merges the segments of each range, and the ranges in order make up the globally ordered capture history. Splitters are
whole keys down to the record, so one URL, or one page that is repeated, may span several ranges.

Records with equal payloads of at least ``LEAST`` bytes are written once, as the response with the smallest page_id;
the others are revisits of it, without body. The pages table has no capture time, so the date is a fixed epoch plus
page_id seconds.

Defined results: a null page is an empty payload; a null URL is the empty URL; a row without a page_id is a response
with a null page_id, dated at the epoch, and nothing refers to it; rows that repeat a page_id are each written, alike
if their payloads are; an empty table gives no rows; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import cut, table, work_path

#: Payloads below this size are always stored in full.
LEAST = 100
#: Revisits that are few enough to be sent to every task, by count; more are joined by a shuffle.
SMALL = 50_000
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
#: Bytes after which an archive is closed; one is read as one value, and each has a folder of its own, so neither tiny nor huge.
ARCHIVE = 128 << 20
#: Captures that are sampled for each range, to choose the splitters from.
SAMPLED = 64
#: Index rows that one merging task is meant to take.
RANGE = 200_000

_EOL = "\r\n"


def digested(pages: DataFrame) -> DataFrame:
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    return read.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that repeat an earlier payload; no payload is shuffled.

    The first ones are cut before they are joined, so that the partition of a payload that very many pages share is
    split at run time.
    """
    read = digested(pages).where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = cut(read.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return read.join(first, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page."""
    again = cut(revisits(pages))
    if again.count() <= SMALL:
        again = F.broadcast(again)
    met = digested(pages).join(again, ["page_id", "payload_digest"], "left")
    return met.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))


#: The head of the HTTP response that a record holds before the page.
HTTP = f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL * 2}"


def records(found: DataFrame) -> DataFrame:
    """(value, payload_bytes): the record's text without the two line ends that close it."""
    record_id = lambda c: F.concat(F.lit("<urn:plantwatch:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # white space and line ends can't stand in a header
    url = F.regexp_replace("url", r"[\s\x00-\x1f]+", "%20")
    head = F.concat_ws(
        _EOL, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))), F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")), F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
    )
    return found.select(F.concat(head, F.lit(_EOL * 2 + HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ARCHIVE bytes and at most one record more, however the pages lie in tasks."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                out.append(f"{task:06d}-{number:06d}")
                held += size
                if held >= ARCHIVE:
                    number, held = number + 1, 0
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["value", "archive"])

    dealt = records(described(pages)).mapInArrow(numbered, "value string, archive string")
    dealt.write.partitionBy("archive").option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


def unpacked(packed: memoryview, piece: int = 1 << 20) -> Iterator[bytes]:
    """What gzip members hold, piece by piece."""
    at = 0
    while at < len(packed):
        member = zlib.decompressobj(31)
        while at < len(packed) and not member.eof:
            given = packed[at : at + piece]
            at += len(given)
            yield member.decompress(given)
        at -= len(member.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive that comes in pieces; one record is held at a time."""
    pieces, held, at, begin = iter(pieces), bytearray(), 0, 0

    def more(least: int) -> bool:
        """Whether ``held`` has so many bytes from ``begin`` on, after reading on as needed."""
        nonlocal begin
        if len(held) - begin < least and begin:
            del held[:begin]
            begin = 0
        while len(held) - begin < least:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while more(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", begin + max(0, seen - 3))) < 0:
            seen = len(held) - begin
            if not more(seen + 1):
                raise ValueError(f"the head of the record at {at} doesn't end")
        version, *lines = held[begin:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        head, size = end + 4 - begin, int(headers["Content-Length"])
        if not more(head + size + 4) or held[begin + head + size : begin + head + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end after {size} bytes")
        yield at, headers, bytes(held[begin + head : begin + head + size])
        begin += head + size + 4
        at += head + size + 4


def url_key(url: str) -> str:
    """Host labels from the top, then path and query: captures of one site lie together."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".lower()


_INDEX = "url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, verified boolean"
_TARGET = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("verified", pa.bool_())])


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives, each archive's a run in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x.endswith(":none>") else int(x[x.rindex(":") + 1 : -1])
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive, rows = name.rsplit("/archive=", 1)[-1], []
                for at, head, block in parse(unpacked(memoryview(packed.as_buffer()))):
                    response = head["WARC-Type"] == "response"
                    body = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    seen = hashlib.sha256(body).hexdigest() if response else digest
                    size = len(body) if response else int(head["X-Payload-Length"])
                    url, ts = head["WARC-Target-URI"], head["WARC-Date"]
                    rows.append((url_key(url), ts, number(head["WARC-Record-ID"]), url, head["WARC-Type"], size, seen, None if response else number(head["WARC-Refers-To"]), archive, at, len(body), seen == digest and size == int(head["X-Payload-Length"])))
                rows.sort(key=place)
                for k in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 10_000], strict=True), _TARGET, strict=True)], schema=_TARGET)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _INDEX)


def place(row: tuple) -> tuple:
    """An index row's place in the history; rows without a page come before those of the same moment with one."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


class LoserTree:
    """Merges sorted runs; each step costs one comparison for every level of the tree."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        """Run i climbs; at each node the loser stays. A node that has waited for its second run keeps the first to come."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_index(runs: DataFrame, per_range: int = RANGE) -> DataFrame:
    """All runs in one order by (url_key, ts, page_id), with each row's range and place in it."""
    runs = cut(runs)
    total = runs.count()
    ranges = max(1, -(-total // per_range))
    splitters: list[tuple] = []
    if ranges > 1:
        key = ["url_key", "ts", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "archive", "offset"]
        spread, shares = F.pmod(F.xxhash64("archive", "offset"), F.lit(1 << 30)), 1 << 30
        sample = sorted(map(tuple, runs.where(spread < max(1, shares * ranges * SAMPLED // total)).select(*key).collect()))
        splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    segment = pa.schema([("range", pa.int32()), ("run", pa.string()), ("part", pa.int32()), ("rows", pa.list_(pa.struct(list(_TARGET))))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run's rows come in order; a new archive begins a new run."""
        run, part = None, 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            begin = 0
            while begin < len(rows):
                archive = rows[begin][8]
                run, part = archive, part + 1 if archive == run else 0
                stop = begin + 1
                while stop < len(rows) and rows[stop][8] == archive:
                    stop += 1
                keys = [place(r) for r in rows[begin:stop]]
                cuts = [0, *(bisect_left(keys, x) for x in splitters), len(keys)]
                found = [(i, archive, part, begin + x, begin + y) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                members = batch.to_struct_array()
                lists = [members.slice(x, y - x) for *_, x, y in found]
                ends = [0]
                for x in lists:
                    ends.append(ends[-1] + len(x))
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(lists)).cast(segment.field(3).type)], schema=segment)
                begin = stop

    fields = _INDEX.replace(" ", ":").replace(",:", ",")
    cuts_of = runs.mapInArrow(segments, f"range int, run string, part int, rows array<struct<{fields}>>")
    # what is put in order here are segments, a few for each run; their rows stay as they are
    dealt = cuts_of.repartitionByRange(ranges, "range").sortWithinPartitions("range", "run", "part")
    target = _TARGET.append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))

    def merged(number: int, parts: list[tuple[str, pa.StructArray]]) -> Iterator[pa.RecordBatch]:
        """A range's captures in order; the segments of one run follow each other."""
        held = pa.concat_arrays([x for _, x in parts])
        columns = [held.field(i).to_pylist() for i in range(len(_TARGET))]
        keys = [place(row) for row in zip(*columns, strict=True)]
        ends, at, runs_ = {}, 0, {}
        for run, x in parts:
            runs_.setdefault(run, []).append(range(at, at + len(x)))
            at += len(x)
        ends = [((keys[i], i) for r in spans for i in r) for spans in runs_.values()]
        order = pa.array([i for _, i in LoserTree(ends)])
        table_ = pa.Table.from_arrays(held.take(order).flatten(), schema=_TARGET)
        table_ = table_.append_column("range", pa.array([number] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from table_.cast(target).to_batches(max_chunksize=10_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            lists = batch.column(3)
            for i, (number, run) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if number != now and parts:
                    yield from merged(now, parts)
                    parts = []
                now = number
                parts.append((run, lists[i].values))
        if parts:
            yield from merged(now, parts)

    return dealt.mapInArrow(merge, _INDEX + ", range int, place long")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return merge_index(capture_runs(spark, path)).drop("length", "url")
