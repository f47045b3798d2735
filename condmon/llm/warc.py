"""WARC archives with a two-level capture index.

Tasks write archives of one gzip member per record into shared storage. The index sorts the captures by URL key (host
reversed, then path) into compressed blocks; each range of keys is one part with a sparse directory, one line per block.
A lookup searches the list of parts, then one part's directory, then one block, each by bisection, and
reads a record by its byte range.

Files are written under names of their own by every attempt of a task, and only those that the committed table of captures
or parts names are read, so that a lost executor leaves nothing half-written in the index.

Defined results:
* NULL payload is empty. Of equal payloads the capture with the smallest id is the response and the others revisit it;
  rows that repeat the smallest id are all responses, as are all rows when every id is NULL.
* A NULL id comes last and is left out of its record. A NULL or empty URL has the empty key.
* Records with payloads under `revisit_bytes` are all responses.
* Other columns are left out. An empty table gives an index without parts, and lookups without rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.llm.common import map_rows, named, shuffle_partitions
from condmon.session import scratch_path, stored

BLOCK_LINES = 1000       # captures in a compressed block of the index
ARCHIVE_BYTES = 1 << 30  # an archive is closed after this size
CAPTURES = "key string, url string, id bigint, archive string, at bigint, size bigint, kind string, digest string"
PARTS = "first string, last string, blocks string, directory string, n bigint"
RECORDS = ("key string, id bigint, url string, kind string, payload binary, payload_bytes bigint, payload_digest string, "
           "refers_to bigint")


def url_key(url: str | None) -> str:
    """com,example,www:port)/path?query of a URL; the fragment is left out. What is no URL is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, revisit: bool,
                 date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(body)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {response_id}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(33, 127))  # a header line holds URLs of visible ASCII as they are


@dataclass
class Record:
    fields: dict[str, str]
    payload: bytes

    @property
    def payload_bytes(self) -> int:
        """The full payload's length, which a revisit record only tells in its HTTP header."""
        return int(self.fields["http-content-length"])


def parsed(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    body = rest[:int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    for line in http.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[f"http-{name.lower()}"] = value
    return Record(fields, payload)


def filesystem(uri: str):
    """The file system of a shared folder, and the path there."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


class Appender:
    """A file that is made when the first bytes come."""

    def __init__(self, folder: str, ending: str):
        self.uri, self.at, self.out = f"{folder}/{uuid.uuid4().hex}{ending}", 0, None

    def append(self, data: bytes) -> int:
        if self.out is None:
            disk, path = filesystem(self.uri)
            disk.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = disk.open_output_stream(path, compression=None)
        start, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Reader:
    """Range reads that keep the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, at: int, size: int) -> bytes:
        if uri != self.uri:
            disk, path = filesystem(uri)
            self.uri, self.file = uri, disk.open_input_file(path)
        self.file.seek(at)
        return self.file.read(size)

    def whole(self, uri: str) -> bytes:
        disk, path = filesystem(uri)
        with disk.open_input_file(path) as f:
            return f.read()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page, and give the table of captures (CAPTURES)."""
    rows = named(pages, id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("same", F.sha1("html"))
    equal = (rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("same")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"))
    marked = rows.join(equal, "same", "left").drop("same")

    def make():
        def run(found):
            archive = Appender(folder, ".warc.gz")
            for r in found:
                payload = r["html"].encode()
                digest = base32_sha1(payload)
                revisit = r["first"] is not None and r["id"] != r["first"]
                member = gzip.compress(record_bytes(r["id"], r["url"], payload, digest, r["first"], revisit, date), 6, mtime=0)
                at = archive.append(member)
                yield (url_key(r["url"]), r["url"], r["id"], archive.uri, at, len(member), "revisit" if revisit else "response", digest)
                if archive.at > ARCHIVE_BYTES:
                    archive.close()
                    archive = Appender(folder, ".warc.gz")
            archive.close()

        return run

    return stored(map_rows(marked, make, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write blocks and directories, and give the table of parts (PARTS), one row per range of keys."""
    parts = shuffle_partitions(captures.sparkSession)
    order = ["key", "id", "archive", "at"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def make():
        def run(rows):
            blocks, lines, directory, last = Appender(folder, ".blocks"), [], [], None

            def flush():
                data = zlib.compress("\n".join(lines).encode())
                directory.append([json.loads(lines[0])[0], blocks.append(data), len(data)])
                lines.clear()

            for r in rows:
                lines.append(json.dumps([r["key"], r["id"], r["archive"], r["at"], r["size"]]))
                last = r["key"]
                if len(lines) == BLOCK_LINES:
                    flush()
            if lines:
                flush()
            blocks.close()
            if directory:
                listing = Appender(folder, ".directory")
                listing.append("\n".join(map(json.dumps, directory)).encode())
                listing.close()
                yield directory[0][0], last, blocks.uri, listing.uri, len(directory)

        return run

    return stored(map_rows(ranged, make, PARTS), "index-parts")


def lookup(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """keys (key) -> (key, id, archive, at, size) of all captures of those keys.

    The list of parts has one row per partition of the index, whatever the number of captures; it goes to all tasks.
    """
    listed = sorted((tuple(r) for r in parts.collect()), key=lambda p: (p[0], p[1]))
    shipped = keys.sparkSession.sparkContext.broadcast(listed)
    n = shuffle_partitions(keys.sparkSession)
    wanted = keys.select("key").filter(F.col("key").isNotNull()).distinct()

    def make_blocks():
        def run(rows):
            known = shipped.value
            reader, at, firsts, entries = Reader(), None, [], []
            lasts = [p[1] for p in known]
            for r in rows:
                key = r["key"]
                i = bisect.bisect_left(lasts, key)
                while i < len(known) and known[i][0] <= key:
                    if at != i:
                        entries = [json.loads(x) for x in reader.whole(known[i][3]).split(b"\n")]
                        at, firsts = i, [e[0] for e in entries]
                    # The block before the first one that starts with the key can end with it.
                    low, high = bisect.bisect_left(firsts, key), bisect.bisect_right(firsts, key)
                    for e in entries[max(0, low - 1):high]:
                        yield key, known[i][2], e[1], e[2]
                    i += 1

        return run

    def make_entries():
        def run(rows):
            reader, block, keys_there, lines = Reader(), None, [], []
            for r in rows:
                if block != (r["blocks"], r["at"]):
                    block = (r["blocks"], r["at"])
                    data = zlib.decompress(reader.read(r["blocks"], r["at"], r["size"]))
                    lines = [json.loads(x) for x in data.split(b"\n")]
                    keys_there = [x[0] for x in lines]
                low, high = bisect.bisect_left(keys_there, r["key"]), bisect.bisect_right(keys_there, r["key"])
                for x in lines[low:high]:
                    yield tuple(x)

        return run

    sought = wanted.repartition(n, "key").sortWithinPartitions("key")
    blocks = map_rows(sought, make_blocks, "key string, blocks string, at bigint, size bigint")
    near = blocks.repartition(n, "blocks", "at").sortWithinPartitions("blocks", "at", "key")
    return map_rows(near, make_entries, "key string, id bigint, archive string, at bigint, size bigint")


def read_records(found: DataFrame) -> DataFrame:
    """Range-read the records of captures (key, id, archive, at, size). See RECORDS."""
    n = shuffle_partitions(found.sparkSession)

    def make():
        def run(rows) -> Iterator[tuple]:
            reader = Reader()
            for r in rows:
                record = parsed(gzip.decompress(reader.read(r["archive"], r["at"], r["size"])))
                f, revisit = record.fields, record.fields["warc-type"] == "revisit"
                page, refers = f.get("x-page-id"), f.get("x-refers-to-page-id")
                digest = f["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(record.payload)
                yield (r["key"], page and int(page), f.get("warc-target-uri"), f["warc-type"], None if revisit else record.payload,
                       record.payload_bytes if revisit else len(record.payload), digest, refers and int(refers))

        return run

    near = found.repartition(n, "archive", F.floor(F.col("at") / (8 << 20))).sortWithinPartitions("archive", "at")
    return map_rows(near, make, RECORDS)


def key_table(urls: DataFrame, url_col: str = "url") -> DataFrame:
    def make():
        return lambda rows: ((url_key(r["u"]),) for r in rows)

    return map_rows(named(urls, u=url_col).distinct(), make, "key string").distinct()


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared storage of the session, as a URI that every task can open."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
