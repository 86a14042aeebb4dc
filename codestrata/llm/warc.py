"""WARC archives with a two-level capture index.

Pages are dealt by the range of their index key, reversed host then path then page
id, so a busy host or URL spreads over many tasks. Each task writes its pages in key
order to one archive, a gzip member per record, and beside it one index part:
compressed blocks of lines `key TAB offset length`, then a sparse directory with the
first key of each block. The top level has one row per part. A look-up finds the
part, binary-searches its directory, binary-searches the block, and reads just the
record's range.

Pages with equal payloads of at least `min_bytes` share one response, that of the
largest page id; the others are revisits that refer to it.

Files go through pyarrow's file systems to the folder that all executors share, under
names unique to the attempt; a part counts only if its task returned its row, so a
repeated or lost attempt leaves nothing that is read.

Defined results: a null html is an empty payload; a null URL has the empty key; rows
repeated with the largest id are all responses; rows with null ids are revisits where
a group has an id, else responses; an empty table gives an empty archive. Only id,
url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.text import bounded_batches
from codestrata.session import Scratch

BLOCK_LINES = 1000
LOOKUPS = 4000  # captures read back by one task
PARTS = "archive string, index string, first_key string, last_key string, records long"
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
OPEN_FILES = 32


def surt(url: Column) -> Column:
    """Reversed host, then path and query; no scheme, user, port or fragment. White space is escaped, null is empty."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^#]*)", 1)
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"\s", "%20")


def index_key(url: Column, page_id: Column) -> Column:
    """The key of a capture: one string, in whose order everything is sorted."""
    ident = F.coalesce(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("-"))
    return F.concat(surt(url), F.lit(" "), ident)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: codestrata\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields and payload; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda x: int(x[10:-1]) if len(x) > 11 else None
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class IndexPart:
    """An index part opened for look-ups: its directory in memory, the last block kept."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length), 31))
        self.first = [d[0].encode() for d in self.directory]
        self.held, self.keys, self.at = -1, [], []

    def block(self, i: int) -> None:
        if i != self.held:
            _, offset, length = self.directory[i]
            lines = [x.split("\t") for x in zlib.decompress(self.file.read_at(length, offset), 31).decode().split("\n")]
            self.held, self.keys, self.at = i, [x[0].encode() for x in lines], [tuple(map(int, x[1].split(" "))) for x in lines]

    def find(self, key: bytes) -> Iterator[tuple[int, int]]:
        """(offset, length) of every capture with the key."""
        i = max(0, bisect_left(self.first, key) - 1)  # equal keys may begin in the block before
        while i < len(self.first) and self.first[i] <= key:
            self.block(i)
            j = bisect_left(self.keys, key)
            while j < len(self.keys) and self.keys[j] == key:
                yield self.at[j]
                j += 1
            i += 1


def _writer(base: str, block_lines: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(base)
        name = f"{root}/{uuid.uuid4().hex}"
        files.create_dir(root, recursive=True)
        archive = index = None
        offset = written = records = 0
        directory, lines, first, last = [], [], None, None

        def close_block() -> None:
            nonlocal written
            data = _gzip("\n".join(lines).encode())
            directory.append([lines[0].split("\t")[0], written, len(data)])
            index.write(data)
            written += len(data)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if archive is None:
                    archive, index, first = files.open_output_stream(f"{name}.warc.gz", compression=None), files.open_output_stream(f"{name}.cdx", compression=None), r["key"]
                    data = _gzip(_info(name.rpartition("/")[2] + ".warc.gz", date))
                    archive.write(data)
                    offset = len(data)
                data = _gzip(_record(r["page_id"], r["url"], r["payload"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["owner"], r["revisit"], date))
                archive.write(data)
                lines.append(f"{r['key']}\t{offset} {len(data)}")
                offset, records, last = offset + len(data), records + 1, r["key"]
                if len(lines) == block_lines:
                    close_block()
        if archive is not None:
            if lines:
                close_block()
            data = _gzip(json.dumps(directory).encode())
            index.write(data + len(data).to_bytes(8, "big"))
            archive.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"archive": f"{name}.warc.gz", "index": f"{name}.cdx", "first_key": first, "last_key": last, "records": records}])

    return write


class Archive:
    """Written archives: the folder and the top level of the index."""

    def __init__(self, base: str, parts: list[tuple]):
        self.base, self.parts = base, sorted(parts, key=lambda p: p[2].encode())

    @staticmethod
    def write(pages: DataFrame, base: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Archive:
        bounded_batches(pages.sparkSession)
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
        digested = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
        groups = digested.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND owner IS NOT NULL").select("sha1", "owner")
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), index_key(F.col(url_col), F.col(id_col).cast("long")).alias("key"))
        rows = rows.join(scratch.write(groups), "sha1", "left")
        revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
        dealt = rows.withColumn("revisit", revisit).repartitionByRange("key").sortWithinPartitions("key")
        found = scratch.write(dealt.select("page_id", "url", "payload", "sha1", "key", "owner", "revisit").mapInArrow(_writer(base, block_lines, date), PARTS))
        return Archive(base, [tuple(r) for r in found.collect()])  # a row per archive

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The captures of every key of keys (key), each key once."""
        base, parts = self.base, self.parts
        first = [p[2].encode() for p in parts]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, _ = pafs.FileSystem.from_uri(base)
            opened: OrderedDict[int, tuple] = OrderedDict()
            for batch in batches:
                out = []
                for key in batch["key"].to_pylist():
                    key = key.encode()
                    i = max(0, bisect_left(first, key) - 1)
                    while i < bisect_right(first, key):
                        if i not in opened:
                            opened[i] = (IndexPart(files, parts[i][1]), files.open_input_file(parts[i][0]))
                            if len(opened) > OPEN_FILES:
                                opened.popitem(last=False)
                        index, archive = opened[i]
                        for offset, length in index.find(key):
                            r = parse_record(zlib.decompress(archive.read_at(length, offset), 31))
                            out.append({k: r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")})
                        i += 1
                yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

        # As many tasks as the records ask for; the keys alone are small, so their bytes say little about the work.
        tasks = max(1, -(-sum(p[4] for p in parts) // LOOKUPS))
        return keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(read, CAPTURE)

    def get(self, spark: SparkSession, url: str) -> list[dict]:
        """All captures of one URL with their payloads, by a prefix of the key."""
        prefix = spark.range(1).select(surt(F.lit(url))).first()[0].encode() + b" "
        files, _ = pafs.FileSystem.from_uri(self.base)
        out, first = [], [p[2].encode() for p in self.parts]
        i = max(0, bisect_left(first, prefix) - 1)
        while i < len(first) and (first[i] <= prefix or first[i].startswith(prefix)):
            index, archive = IndexPart(files, self.parts[i][1]), files.open_input_file(self.parts[i][0])
            j = max(0, bisect_left(index.first, prefix) - 1)
            while j < len(index.first) and (index.first[j] <= prefix or index.first[j].startswith(prefix)):
                index.block(j)
                n = bisect_left(index.keys, prefix)
                while n < len(index.keys) and index.keys[n].startswith(prefix):
                    offset, length = index.at[n]
                    out.append(parse_record(zlib.decompress(archive.read_at(length, offset), 31)))
                    n += 1
                j += 1
            i += 1
        return out


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages, then look every page up in the index and read its record back."""
    scratch = Scratch(pages.sparkSession, "warc")
    archive = Archive.write(pages, scratch.path("archive"), scratch, id_col, url_col, html_col, min_bytes)
    return archive.lookup(pages.select(index_key(F.col(url_col), F.col(id_col).cast("long")).alias("key")))
