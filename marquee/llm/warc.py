"""WARC archives: writing, an external index merge, and reading back.

Writing: each task writes gzip members, a record each, to files of its own in the shared folder, under a
name that no other attempt has, and gives out its capture run: index rows sorted by URL key and timestamp.
The runs are a written table, so only files of attempts that succeeded are ever read. Of records with equal
payloads of at least ``least`` bytes the one with the largest id is a response and the others are revisits.

Index merge: runs are dealt by range of (URL key, timestamp, id), so that a host or URL with very many
captures still falls into many ranges; in each range a loser tree merges the sorted pieces of all runs. The
result is globally ordered from one range to the next.

Reading: the merged index goes through tasks in its order; each batch opens the archives it needs and reads
its members by offset, checks them and gives out the fields.

Defined results: null html is an empty payload; null URLs have an empty key; a null id is written as such
and sorts first; repeated rows are records of their own, and of repeated ids with equal payloads one is the
response; a payload of any length is one record; captures of equal URL keys and times are ordered by id; empty tables give
empty archives; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import new_path, ready, slices, written

EPOCH = 1_704_067_200  # 2024-01-01, from which captures of tables without times count
_RUN = "run string, url_key string, captured long, page_id long, file string, at long, size long"


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels in reverse, then path and query, in lower case without the scheme and www."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?", "")
    host = F.regexp_extract(bare, r"^([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^#]*)", 1), r"^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _date(seconds: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_date(captured)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(id, payload bytes, payload digest, type, id referred to) of one gzip member, checked against its own digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda field: int(x) if (x := fields[field][len("<urn:x-page:") : -1]) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None


def _write(folder: str, most_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out, place, size = [], None, "", 0
        for part in slices(batches, 256, 8 << 20):
            for page_id, url, key, captured, html, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    place, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    files, path = _open(place)
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)  # members are compressed one by one
                pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url, captured, (html or "").encode(), digest, refers_to)) + pack.flush()
                out.write(member)
                rows.append((place, key, captured, page_id, place, size, len(member)))
                size += len(member)
                if size >= most_bytes:
                    out.close()
                    yield _run(rows)
                    rows, out = [], None
        if out is not None:
            out.close()
            yield _run(rows)

    return run


def _run(rows: list[tuple]) -> pa.RecordBatch:
    """The capture run of one file, sorted."""
    rows.sort(key=_order)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["run", "url_key", "captured", "page_id", "file", "at", "size"])


def _order(row: tuple) -> tuple:
    return row[1].encode(), row[2], row[3] is not None, row[3] or 0, row[0], row[5]


class LoserTree:
    """Merges sorted lists: inner nodes keep the losers of their games, so each step plays one game a level."""

    def __init__(self, lists: list[list], key: Callable):
        self.lists, self.key, self.at = lists, key, [0] * len(lists)
        self.k = max(1, len(lists))
        self.keys = [key(x[0]) if x else None for x in lists] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator:
        while self.keys[self.winner] is not None:
            w = self.winner
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = self.key(self.lists[w][self.at[w]]) if self.at[w] < len(self.lists[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: the pieces of the runs, ordered as they were, through a loser tree."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[0], []).append(row)
    held: list[tuple] = []
    for row in LoserTree([runs[r] for r in sorted(runs)], _order) if runs else ():
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema.names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4096):
        rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
        order = sorted(range(len(rows)), key=lambda k: (rows[k][4], rows[k][5]))
        found: list = [None] * len(rows)
        for place, group in groupby(order, key=lambda k: rows[k][4]):
            files, path = _open(place)
            with files.open_input_file(path) as archive:
                for k in group:
                    archive.seek(rows[k][5])
                    found[k] = (*parse(archive.read(rows[k][6])), rows[k][1], rows[k][2])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured"]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names)


def write_archives(pages: DataFrame, least: int = 1000, most_bytes: int = 256 << 20, id_col: str = "page_id", broadcast_rows: int = 100_000) -> DataFrame:
    """Writes pages (id_col, url, html) as WARC files in the shared folder; the table of their sorted capture runs.

    Up to broadcast_rows repeated payloads (48 bytes each) are broadcast; beyond, pages and payloads meet by a shuffle
    on the digest. The result is the same."""
    spark = pages.sparkSession
    ready(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    # The captures of payloads that come more than once, without the payloads; only these need a response named.
    large = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("held")).where("held > 1").select("digest", "response")
    large = written(large, "repeated-payloads")
    small = large.count() <= broadcast_rows
    rows = rows.join(F.broadcast(large) if small else large, "digest", "left")
    other = F.when((F.col("bytes") >= least) & (F.col("page_id") != F.col("response")), F.col("response"))
    captured = F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)) % (1 << 30)
    ready_rows = rows.select("page_id", "url", url_key(F.col("url")).alias("url_key"), captured.alias("captured"), "html", "digest", other.alias("refers_to"))
    return written(ready_rows.mapInArrow(_write(new_path(spark, "warc"), most_bytes), _RUN), "capture-runs")


def merge_index(runs: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """The capture history: all runs in the order of URL key, timestamp and id, from partition to partition."""
    ranges = max(8, runs.count() // rows_per_range)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "at")
    # Each range holds about rows_per_range rows, and its pieces of runs come sorted from the shuffle.
    return dealt.sortWithinPartitions("run", "url_key", "captured", "page_id", "at").mapInArrow(_merge, _RUN)


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, in its order: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured."""
    return index.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured long")
