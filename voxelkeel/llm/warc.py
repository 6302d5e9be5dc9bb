"""WARC archives: a writer with revisit records and a splittable reader.

The writer lays each page down as one gzip member, many members to a file. The reader deals byte
ranges of the files to tasks. A task looks for the gzip magic in its range, takes a place for a
record only if a member can be decoded there and its header is a WARC header, and owns the records
that start in its range, reading over the range's end to finish the last one.

Defined results: a null payload is empty; rows with a null key are written with the record id
``<urn:page:none:...>`` and read back with a null key; equal rows are equal records (rows that share the
largest key of their payload are all responses); an empty table gives no file and no record; other
columns of the input are ignored. Headers and payloads of any length pass as a whole, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import join_keeping_hot, shuffle_partitions, staged
from voxelkeel.session import scratch_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: A file is closed when it has this many bytes, so that lost work is small and listings stay short.
FILE_BYTES = 128 << 20
#: Bytes of a range that one reading task owns.
SPLIT_BYTES = 4 << 20
CHUNK = 1 << 20

MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary, path string, start long"
)


def open_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder; a bare path is a mounted one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member that holds one response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    own = f"none:{uuid.uuid4()}" if page_id is None else str(page_id)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{own}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Which row of each group of equal payloads is the response: that with the largest page_id."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    best = rows.groupBy("_sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("_n"))
    return join_keeping_hot(rows, best, "_sha", "_n", pages.count()).drop("_sha")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; returns the manifest (path, bytes, records).

    Only files in the manifest count: a task that is run again writes under new names, and what its
    lost attempt left is never read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_filesystem(folder)
        store.create_dir(root, recursive=True)
        out = path = None
        size = count = 0
        for batch in batches:
            for page_id, url, payload, response_id in zip(batch.page_id.tolist(), batch.url.tolist(), batch.payload.tolist(), batch.response_id.tolist()):
                page_id = None if pd.isna(page_id) else int(page_id)
                response_id = None if pd.isna(response_id) else int(response_id)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder.rstrip('/')}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record_member(page_id, url, bytes(payload), response_id, page_id != response_id)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [count]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [count]})

    return staged(mark_revisits(pages).mapInPandas(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from a place on, read forward a chunk at a time; what lies behind is let go."""

    def __init__(self, handle, start: int):
        self.handle, self.start, self.data, self.ended = handle, start, b"", False

    def fill(self, upto: int) -> None:
        while self.start + len(self.data) < upto and not self.ended:
            self.handle.seek(self.start + len(self.data))
            more = self.handle.read(CHUNK)
            self.ended = not more
            self.data += more

    def drop(self, before: int) -> None:
        if before - self.start > CHUNK:
            self.data, self.start = self.data[before - self.start :], before

    def find_magic(self, at: int, end: int) -> int | None:
        while at < end:
            self.fill(at + CHUNK)
            found = self.data.find(MAGIC, at - self.start)
            if found >= 0:
                return self.start + found if self.start + found < end else None
            reached = self.start + len(self.data) - len(MAGIC) + 1
            if self.ended or reached <= at:
                return None
            at = reached
            self.drop(at)
        return None


def _member_at(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers and block of the record in the gzip member at ``at``, and the place behind it; None if there is none."""
    unpack = zlib.decompressobj(31)
    raw, place, header_end = [], at, -1
    head = bytearray()
    while not unpack.eof:
        window.fill(place + 1)
        part = window.data[place - window.start : place - window.start + (1 << 16)]
        if not part:
            return None
        try:
            got = unpack.decompress(part)
        except zlib.error:
            return None
        place += len(part)
        raw.append(got)
        if header_end < 0:
            seen = max(0, len(head) - 3)
            head += got
            if not head.startswith(VERSION[: len(head)][: len(VERSION)]):
                return None
            header_end = head.find(b"\r\n\r\n", seen)
    if header_end < 0:
        return None
    place -= len(unpack.unused_data)
    full = b"".join(raw)
    headers = {}
    for line in full[len(VERSION) : header_end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if "warc-type" not in headers or not length.isdigit() or len(full) < header_end + 4 + int(length):
        return None
    return headers, full[header_end + 4 : header_end + 4 + int(length)], place


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def records_in_range(handle, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose gzip member starts in [start, end): place, headers, block."""
    window, at = _Window(handle, start), start
    while (at := window.find_magic(at, end)) is not None:
        found = _member_at(window, at)
        if found is None:
            at += 1
            continue
        headers, block, after = found
        yield at, headers, block
        at = after
        window.drop(at)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, bytes), read by byte ranges.

    Digest and length of a response are worked out from what was read; ``payloads=False`` leaves the
    bytes themselves in the reading task. A record of another type than response or revisit is returned with its type and block as payload.
    """
    ranges = manifest.filter(F.col("bytes") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(shuffle_partitions(manifest.sparkSession), "path", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for uri, start in zip(batch.path, batch.start):
                store, path = open_filesystem(uri)
                rows, held = [], 0
                with store.open_input_file(path) as handle:
                    for at, headers, block in records_in_range(handle, int(start), int(start) + split_bytes):
                        kind = headers["warc-type"]
                        payload, size = block, len(block)
                        if kind in ("response", "revisit"):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = len(payload)
                            if kind == "revisit":
                                stated = re.search(rb"\r\nContent-Length: (\d+)", http)
                                payload, size = None, int(stated[1]) if stated else None
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            digest = bare_digest(payload)
                        rows.append((_page(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), digest, size, _page(headers.get("warc-refers-to")), payload if payloads else None, uri, at))
                        held += len(block) if payloads else 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns, dtype=object)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return ranges.mapInPandas(read, RECORDS)


def archive_and_read(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads=payloads)
