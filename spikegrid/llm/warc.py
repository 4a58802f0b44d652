"""WARC archives and their capture index.

Every task writes archives (one gzip member for each record) and, for each archive, a
run of index rows sorted by URL key and time. Runs are cut at sampled splitters, and
each key range merges its segments of all runs with a loser tree, so the index is in
global order without a sort of the whole. Records are then read back through it.

Of records with equal payloads of at least ``smallest`` bytes, that with the smallest
page_id is the response; others are revisits without payload that refer to it. Archives
have a name of their own for each attempt, and only names that a finished task returned
are read.

The table has no capture time: page_id seconds after ``EPOCH`` stands in, and a null id
counts as 0. Nulls: a null html is an empty payload, a null url has an empty key. A null
page_id is never the smallest unless the group has no other; rows that repeat the
smallest id with its payload are responses all. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import datetime
import gzip
import hashlib
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.llm.common import saved, shared_path
from spikegrid.llm.token_files import open_store

SMALLEST = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE = 4096
RANGE_ROWS = 20_000
EPOCH = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sortable form: host reversed and in lower case, then the rest."""
    rest = (url or "").partition("://")[2]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):] if rest else ""


def capture_time(page_id: int | None) -> str:
    seconds = (page_id or 0) % (250 * 365 * 86400)
    return (EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; a revisit of page ``first`` if that is given."""
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
            f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of one record; a response's payload must have its digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    refers = fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page}")
    return {"page_id": None if page == "null" else int(page), "payload_bytes": said, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": int(refers[len("<urn:page:"):-1]) if refers else None}


class LoserTree:
    """Merges k sorted runs: inner nodes hold losers, so each row costs one path upwards."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.tree = [-1] * max(1, self.k)
        for run in range(self.k):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        """Run a goes before run b; a used-up run loses, equal rows go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = run
                return
            if self._less(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while self.heads[run := self.tree[0]] is not None:
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def with_revisits(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Adds digest and ``first``, the page that a revisit refers to (null: response)."""
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("digest"))
    long_enough = pages.where(F.octet_length("html") >= smallest).select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))
    groups = long_enough.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    rows = rows.join(groups.select("digest", "_first"), "digest", "left")
    return rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def splitters(pages: DataFrame, ranges: int, sample: int = SAMPLE) -> list[tuple[str, str, int]]:
    """Boundaries (URL key, time, id) from a bounded sample of the captures, drawn by hash."""
    drawn = pages.select("url", "page_id").orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample).collect()
    keys = sorted((url_key(r["url"]), capture_time(r["page_id"]), -1 if r["page_id"] is None else r["page_id"]) for r in drawn)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


ENTRY = pa.struct([("key", pa.string()), ("time", pa.string()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRY_SQL = "key string, time string, page long, file string, offset long, length long"


def write_archives(rows: DataFrame, folder: str, cuts: list[tuple], archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives and their runs: (range, run, entries), the entries of a run in one key range, sorted."""
    schema = pa.schema([("range", pa.int32()), ("run", pa.string()), ("entries", pa.list_(ENTRY))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, name, offset, entries = None, "", 0, []

        def run():
            out.close()
            entries.sort()
            parts: dict[int, list] = {}
            for e in entries:
                parts.setdefault(bisect.bisect_right(cuts, e[:3]), []).append(dict(zip(("key", "time", "page", "file", "offset", "length"), e)))
            entries.clear()
            return pa.RecordBatch.from_pylist([{"range": r, "run": name, "entries": p} for r, p in parts.items()], schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if out is None:
                        name, offset = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    member = gzip.compress(record(row["page_id"], row["url"], payload, row["digest"], row["first"]), 5, mtime=0)
                    out.write(member)
                    entries.append((url_key(row["url"]), capture_time(row["page_id"]), -1 if row["page_id"] is None else row["page_id"], name, offset, len(member)))
                    offset += len(member)
                    if offset >= archive_bytes:
                        yield run()
                        out = None
        if out is not None:
            yield run()

    store, root = open_store(folder)
    store.create_dir(root)
    runs = rows.select("page_id", "url", "html", "digest", "first").mapInArrow(write, f"range int, run string, entries array<struct<{ENTRY_SQL.replace(' ', ':').replace(',:', ',')}>>")
    return saved(runs, "capture-runs")


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """(range, place, key, time, page, file, offset, length) in global order: by range, then place."""
    names = ["key", "time", "page", "file", "offset", "length"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[tuple]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["range"], []).append([tuple(e[n] for n in names) for e in row["entries"]])
        for r in sorted(held):
            merged = list(LoserTree(held.pop(r)))
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), *map(pa.array, zip(*merged))],
                                             ["range", "place", *names])

    dealt = runs.repartition(max(1, ranges), "range")
    return dealt.mapInArrow(merge, f"range int, place long, {ENTRY_SQL}")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        for batch in batches:
            rows = batch.to_pylist()
            found: list = [None] * len(rows)
            for k in sorted(range(len(rows)), key=lambda i: (rows[i]["file"], rows[i]["offset"])):
                name = rows[k]["file"]
                if name not in opened:
                    if len(opened) >= 32:
                        opened.popitem(last=False)[1].close()
                    opened[name] = store.open_input_file(f"{root}/{name}")
                opened.move_to_end(name)
                opened[name].seek(rows[k]["offset"])
                found[k] = parse(opened[name].read(rows[k]["length"]))
            yield pa.RecordBatch.from_pylist(found, schema)
        for f in opened.values():
            f.close()

    return index.select("file", "offset", "length").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, smallest: int = SMALLEST, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, str]:
    """The merged index and the folder of the archives."""
    folder = shared_path(pages.sparkSession, "archives")
    ranges = max(1, min(SAMPLE // 8, -(-pages.count() // range_rows)))
    cuts = splitters(pages, ranges)
    runs = write_archives(with_revisits(pages, smallest), folder, cuts, archive_bytes)
    return merge_runs(runs, ranges), folder


def archived(pages: DataFrame, **options) -> DataFrame:
    return read_back(*archive(pages, **options))
