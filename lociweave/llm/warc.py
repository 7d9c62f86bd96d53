"""WARC archives and their index: captures are written to archive files, indexed where they lie, and the sorted index runs
are merged into one globally ordered capture history.

Writing: a capture whose payload another capture repeats is a revisit record that refers to it; which capture keeps the
payload is settled on digests alone, before any payload moves. Payloads move once, to archive files of bounded size, each sorted
by URL key and time. A record is a gzip member of its own, so that a reader can start at any offset of the index. Files go
through Spark's text writer, the sink for lines of bytes: a member's last byte is zero, as its size takes less than four bytes,
and the writer sets it as the line's end. Records of 16 MB and more are split into several members for that.
Reading: each archive is parsed by Content-Length, and its index entries form a run sorted by URL key and time. Merging:
URL keys are sampled for the bounds of ranges of about RANGE_ROWS entries; runs are cut there into slices, and a task merges a
range's slices of all runs with a loser tree, one range at a time; tasks follow each other in order. Time takes part in the
bounds, so that a URL captured very often is cut too.

Defined cases: a null html is an empty payload; a null url is written as an empty target; line breaks in a URL are percent-encoded
on writing; a null page id is written as an empty one, comes back as null and is never referred to, so that a payload only such
pages have is a response each time; page ids may repeat: each row is a record, and all rows with a payload's largest id
are responses; ids are any 64-bit integers, and capture times of tables without any are the id in seconds after EPOCH,
modulo the seconds until the year 10000, in UTC whatever the session's time zone; other columns are ignored; an empty table
gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_rows, cut, new_path, path_exists

FILE_BYTES, RANGE_ROWS, MOST_RANGES, SAMPLED = 24 << 20, 200_000, 10_000, 20
MEMBER_BYTES = (1 << 24) - 1
# the capture time of page 0, for tables without one, 2024-01-01T00:00:00Z, and the seconds from then to the year 10000
EPOCH, SPAN = 1_704_067_200, 251_698_233_600


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host's labels in reverse, without www, then port, path and query: captures of a site sort together."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url.lower()
    labels = re.sub(r"^www\d*\.", "", m[1].lower()).split(".")
    return ",".join(reversed(labels)) + (m[2] or "").removesuffix(":80").removesuffix(":443") + ")" + (m[3] or "/").lower()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, least: int = 0) -> None:
    """The pages as archives under path. Payloads of fewer than `least` bytes are never revisits."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    slim, _ = cut(rows.select("id", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("hex")), "digests")
    total = slim.agg(F.sum("bytes"), F.count("*")).first()
    if not total[1]:
        return
    # which records revisit which: copies meet as small rows, combined map-side; ids may repeat with other payloads
    kept = slim.where(F.col("bytes") >= least).groupBy("hex").agg(F.max("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    known = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")
    revisits = slim.where(F.col("bytes") >= least).join(kept, "hex").where("id IS NULL OR id <> refers_to").select(known, "hex", "refers_to").distinct()
    most_records = max(1, int(file_bytes * total[1] // (total[0] + 400 * total[1])))
    # payloads move once at most, for this join; archives are what its partitions hold, cut by records of the mean size
    joined = rows.select("*", known, F.sha1(F.col("payload").cast("binary")).alias("hex")).join(revisits, ["key", "hex"], "left")

    at = EPOCH + F.pmod(F.coalesce("id", F.lit(0)), F.lit(SPAN))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86400).cast("int")).cast("string")
    clock = [F.lpad((F.floor(at % 86400 / n) % 60 if n < 3600 else F.floor(at % 86400 / n)).cast("int").cast("string"), 2, "0") for n in (3600, 60, 1)]
    when = F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    uuid = F.regexp_replace(F.md5(F.concat(F.lit("page"), F.col("key"), F.lit(" "), F.col("url"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.upper("hex"), F.lit("\r\nX-Page-ID: "), F.col("key"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    records = joined.select(F.concat(head, block, F.lit("\r\n\r\n")).cast("binary").alias("record"), sort_key(F.col("url")).alias("k"), "id").sortWithinPartitions("k", "id")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(0):
                whole = memoryview(record.as_buffer())
                cuts = [gzip.compress(whole[low : low + MEMBER_BYTES], 6, mtime=0) for low in range(0, len(whole), MEMBER_BYTES)]
                yield pa.record_batch([pa.array([b"\0".join(x[:-1] for x in cuts)], pa.binary())], names=["value"])

    zipped = records.select("record").mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    with arrow_rows(pages.sparkSession, 256):
        zipped.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", most_records).text(path)


def sort_key(url: Column) -> Column:
    """url_key() in DataFrame functions."""
    shape = r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(F.regexp_extract(url, shape, 1)), r"^www\d*\.", ""), r"\.")), ",")
    port = F.regexp_replace(F.regexp_extract(url, shape, 2), "^:(80|443)$", "")
    rest = F.lower(F.regexp_extract(url, shape, 3))
    return F.when(url.rlike(shape), F.concat(host, port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))).otherwise(F.lower(url))


def records_of(content: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, headers, block) of each record of an archive: where its gzip members lie, and what Content-Length says it holds."""
    at, view = 0, memoryview(content)
    while at < len(content):
        record, low = b"", at
        while True:
            unzip, got = zlib.decompressobj(31), []
            while not unzip.eof:
                if at >= len(content):
                    raise ValueError(f"the record at byte {low} does not end")
                some = view[at : at + (1 << 16)]
                got.append(unzip.decompress(some))
                at += len(some) - len(unzip.unused_data)
            record = record + b"".join(got) if record else b"".join(got)
            if record[:5] != b"WARC/":
                raise ValueError(f"no record at byte {low}")
            head = record.index(b"\r\n\r\n")
            headers = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in record[:head].split(b"\r\n")[1:])
            body, size = head + 4, int(headers[b"Content-Length"])
            if len(record) >= body + size + 4:
                break
        if record[body + size :] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {low} does not end where it says")
        yield low, at - low, headers, record[body : body + size]


def entry_key(url_key: str, ts: str, page: int | None) -> tuple:
    """What index entries are ordered by; pages without an id come first."""
    return url_key.encode(), ts, page is not None, page or 0


INDEX = "url_key string, ts string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX rows of all records under path: a run for each archive, in order of URL key and time. Digests come from the payloads."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for at, length, h, block in records_of(batch.column(1)[k].as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = h[b"WARC-Type"].decode()
                    if kind == "revisit":
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32encode(bytes.fromhex(h[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode())).decode()
                    else:
                        size, digest = len(payload), base32_sha1(payload)
                    url = h[b"WARC-Target-URI"].decode()
                    refers = h.get(b"X-Refers-To-Page-ID")
                    rows.append((url_key(url), h[b"WARC-Date"].decode(), int(h[b"X-Page-ID"]) if h[b"X-Page-ID"] else None, url, size, digest, kind, int(refers) if refers else None, name, at, length))
                rows.sort(key=lambda r: entry_key(*r[:3]))
                names = [f.split()[0] for f in INDEX.split(", ")]
                kinds = {"string": pa.string(), "bigint": pa.int64()}
                for low in range(0, len(rows), 10_000):
                    part = list(zip(*rows[low : low + 10_000], strict=True))
                    yield pa.record_batch([pa.array(c, kinds[f.split()[1]]) for c, f in zip(part, INDEX.split(", "), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


class LoserTree:
    """The k-way merge of sorted runs: each step replays one path of a tournament whose inner nodes keep the losers."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        k = len(runs)
        self.k = k
        self.losers = [-1] * max(1, k)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def first(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator:
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self.first(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """INDEX rows in order of URL key, time and page, globally: ranges follow each other, and each is merged from its slices of the runs."""
    n = runs.count()
    parts = min(MOST_RANGES, max(1, -(-n // range_rows)))
    sampled = runs.sample(min(1.0, SAMPLED * parts / n), seed=1).select("url_key", "ts", "page_id").collect() if parts > 1 else []  # about SAMPLED for each range
    sampled = sorted(entry_key(*r) for r in sampled)
    bounds = sorted({sampled[i * len(sampled) // parts] for i in range(1, parts)}) if sampled else []

    def keys_of(rows: pa.RecordBatch) -> list[tuple]:
        return [entry_key(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("url_key", "ts", "page_id")), strict=True)]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch holds runs or parts of runs, one after the other: they are cut where the file changes and at the bounds."""
        for batch in batches:
            keys, files = keys_of(batch), batch.column("file").to_pylist()
            low = 0
            for high in range(1, len(keys) + 1):
                place = bisect.bisect_right(bounds, keys[low]) if high == 1 or high - 1 == low else place
                if high == len(keys) or files[high] != files[low] or keys[high] < keys[high - 1] or place < len(bounds) and keys[high] >= bounds[place]:
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema) as stream:
                        stream.write_batch(batch.slice(low, high - low))
                    yield pa.record_batch([pa.array([place], pa.int32()), pa.array([files[low]]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["range", "file", "slice"])
                    low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            tables = [pa.ipc.open_stream(x).read_all() for x in held]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
            tree = LoserTree([[(k, at + i) for i, k in enumerate(keys_of(t))] for t, at in zip(tables, starts.tolist(), strict=False)])
            order = np.fromiter((i for _, i in tree), dtype=np.int64, count=int(starts[-1]))
            yield from pa.concat_tables(tables).take(pa.array(order)).combine_chunks().to_batches(10_000)

        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != now and held:
                    yield from whole(held)
                    held = []
                now = batch.column(0)[k].as_py()
                held.append(batch.column(1)[k].as_py())
        if held:
            yield from whole(held)

    with arrow_rows(runs.sparkSession, 50_000):
        cut_runs, _ = cut(runs.mapInArrow(slices, "range int, file string, slice binary"), "slices")
    ranged = cut_runs.repartitionByRange(len(bounds) + 1, "range").sortWithinPartitions("range", "file")
    return ranged.select("range", "slice").mapInArrow(run, INDEX)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, least: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture history of archives written from pages and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col, file_bytes, least)
    runs, _ = cut(index(spark, path), "runs")
    return merge(runs, range_rows).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "file", "offset", "length")
