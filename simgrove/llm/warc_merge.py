"""WARC output with an external index merge.

Each task writes its pages as one archive (a gzip member for each record) and its captures as a sorted run of index entries: URL key,
timestamp, page, file, offset, length. Runs are cut at the same key ranges; for each range a loser tree merges the runs' pieces, which gives
capture histories in global order. Records are then read back from the archives by the entries of the merged index.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response; the others are revisits that name it.

Defined results: a null html is an empty payload; a null url has the key ''; rows with a null page_id are never revisits and read back as null; repeated
rows with the smallest page_id are all responses; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import broadcast_if_small, n_partitions, scratch_path, stored
from simgrove.llm.shared_files import open_fs, put

MIN_REVISIT = 100
BROADCAST_ROWS = 200_000
#: keys sampled to find range borders
SAMPLE_KEYS = 20_000
#: archives are closed at so many compressed bytes
ARCHIVE_BYTES = 64 << 20
LEVEL = 4
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
ENTRY = "key string, ts string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query; scheme, 'www.' and fragment don't matter."""
    try:
        p = urlsplit((url or "").strip())
        host, port = (p.hostname or "").removeprefix("www."), p.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def captured_at(page_id: int | None) -> str:
    """The table has no time of capture: pages are a second apart, in the order of their ids."""
    try:
        return (EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {captured_at(page_id)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, and its payload (None for a revisit); lengths and digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = body.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError("a payload doesn't have its digest")
    number = lambda s: None if s is None or s.endswith(":null>") else int(s.rpartition(":")[2][:-1])
    return {"page_id": number(h["WARC-Record-ID"]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To")), "payload": payload}


class LoserTree:
    """k-way merge of sorted lists: inner nodes hold the losers, so each step replays one path from leaf to root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = [r for r in runs if r], []
        k = len(self.runs)
        self.at = [0] * k
        self.tree = [-1] * max(1, k)
        self.winner = self._build(1) if k > 1 else 0

    def _head(self, i: int) -> tuple | None:
        r = self.runs[i]
        return r[self.at[i]] if self.at[i] < len(r) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self._head(self.winner)) is not None:
            yield head
            i = self.winner
            self.at[i] += 1
            node = (i + k) // 2
            while node >= 1:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.winner = i


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.filter((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    first = stored(first, "repeated_payloads")
    j = p.join(broadcast_if_small(first, first.count(), BROADCAST_ROWS), F.col("digest") == F.col("d"), "left")
    return j.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives and their sorted runs: a row for each run, run and entries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, parts, size, entries = TaskContext.get().partitionId(), 0, [], 0, []
        attempt = TaskContext.get().taskAttemptId()  # rows may come in another order in another attempt: its files have names of their own

        def close() -> pa.RecordBatch:
            path = f"{folder}/capture-{part:06d}-{attempt}-{k:06d}.warc.gz"
            put(path, parts)
            rows = [dict(zip(("key", "ts", "page_id", "offset", "length"), e[0:2] + e[3:])) | {"file": path} for e in sorted(entries)]
            return pa.RecordBatch.from_pydict({"run": [f"{part:06d}-{k:06d}"], "entries": [rows]}, schema=_RUN)

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                z = gzip.compress(record(page, url, payload, digest, refers), LEVEL, mtime=0)
                entries.append((url_key(url), captured_at(page), -1 if page is None else page, page, size, len(z)))
                parts.append(z)
                size += len(z)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    k, parts, size, entries = k + 1, [], 0, []
        if entries:
            yield close()

    return stored(pages.mapInArrow(run, f"run string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ', ')}>>"), "runs")


_ENTRY = pa.struct([("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RUN = pa.schema([("run", pa.string()), ("entries", pa.list_(_ENTRY))])


def _order(e: dict) -> tuple:
    return (e["key"], e["ts"], -1 if e["page_id"] is None else e["page_id"], e["file"], e["offset"])


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """The merged index: span, place (in the span), then the entry; spans and places together are the global order."""
    spark = runs.sparkSession
    sizes = runs.select(F.sum(F.size("entries"))).first()[0] or 0
    share = min(1.0, SAMPLE_KEYS / max(1, sizes))
    keys = runs.select(F.explode("entries").alias("e")).select("e.key", "e.ts", F.coalesce("e.page_id", F.lit(-1)).alias("p"))
    sample = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64("key", "p"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(4 * SAMPLE_KEYS).collect())
    borders = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for b in batches:
            for r in range(b.num_rows):
                es = b.column("entries")[r].as_py()
                heads = [_order(e)[:3] for e in es]
                at = [0, *(bisect.bisect_left(heads, x) for x in borders), len(es)]
                spans = [i for i in range(len(at) - 1) if at[i + 1] > at[i]]
                yield pa.RecordBatch.from_pydict({"span": spans, "run": [b.column("run")[r].as_py()] * len(spans), "entries": [es[at[i] : at[i + 1]] for i in spans]}, schema=pa.schema([("span", pa.int32()), *_RUN]))

    entries = runs.schema["entries"].dataType.simpleString()
    pieces = runs.mapInArrow(cut, f"span int, run string, entries {entries}")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held = None, []

        def out() -> pa.RecordBatch:
            merged = [e[-1] for e in LoserTree(held)]
            return pa.RecordBatch.from_pydict({"span": [span] * len(merged), "place": list(range(len(merged))), **{f.name: [e[f.name] for e in merged] for f in _ENTRY}}, schema=pa.schema([("span", pa.int32()), ("place", pa.int64()), *_ENTRY]))

        for b in batches:
            for r in range(b.num_rows):
                s = b.column("span")[r].as_py()
                if s != span and held:
                    yield out()
                    held = []
                span = s
                held.append([(*_order(e), e) for e in b.column("entries")[r].as_py()])
        if held:
            yield out()

    return pieces.repartition(ranges, "span").sortWithinPartitions("span", "run").mapInArrow(merge, f"span int, place long, {ENTRY}")


def read_records(index: DataFrame) -> DataFrame:
    """Records by the merged index's entries, each archive opened once: page_id, payload_bytes, payload_digest, record_type, refers_to, and span, place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            rows = []
            for e in b.to_pylist():
                if e["file"] != name:
                    if f is not None:
                        f.close()
                    name = e["file"]
                    where, path = open_fs(name)
                    f = where.open_input_file(path)
                rows.append(parse(zlib.decompress(f.read_at(e["length"], e["offset"]), 31)) | {"span": e["span"], "place": e["place"]})
            yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in _OUT.names}, schema=_OUT)

    n = n_partitions(index.sparkSession)
    split = index.withColumn("piece", F.floor(F.col("offset") / (4 << 20)))
    return split.repartition(n, "file", "piece").sortWithinPartitions("file", "offset").drop("piece").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, span int, place long")


_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("span", pa.int32()), ("place", pa.int64())])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes, indexes, merges and reads back."""
    spark = pages.sparkSession
    runs = write_archives(with_revisits(pages), folder or scratch_path(spark, "warc"))
    index = stored(merge_runs(runs, n_partitions(spark)), "capture_index")
    return read_records(index)


ORACLE = """
with p as (select page_id, coalesce(html, '') h, strlen(coalesce(html, ''))::bigint n, sha256(coalesce(html, '')) g from pages),
f as (select g, min(page_id) f from p where n >= 100 group by g)
select page_id, n payload_bytes, p.g payload_digest, case when n >= 100 and page_id <> f then 'revisit' else 'response' end record_type,
case when n >= 100 and page_id <> f then f end refers_to from p left join f on p.g = f.g
"""
