"""Archives: round trip, revisit choice, ranges that cut records, damaged and foreign bytes."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from voxelkeel.llm import warc

SCHEMA = "extra string, page_id long, url string, html string"


def brute(rows):
    out = []
    for _, page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for _, p, _, h in rows if (h or "").encode() == payload and p is not None]
        best = max(same, default=None)
        kind = "response" if page_id == best else "revisit"
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None if kind == "response" else best))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    rows = [("a", 1, "http://x/é b", "same"), ("b", 2, None, "same"), ("c", 9, "http://y", "same"), ("d", 3, "", None), ("e", 4, "u", ""), ("f", None, "u", "alone"),
            ("g", 5, "u", "WARC/1.1\r\n\x1f\x08 é\r\n\r\n" * 40), ("h", 6, "u", "long " * 200_000), ("i", 7, "u", "twice"), ("i", 7, "u", "twice")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=500)
    read = warc.read_archives(manifest, split_bytes=split)
    assert result(read) == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in read.filter("record_type = 'response'").collect()}
    assert payloads[5].decode() == rows[6][3] and payloads[6].decode() == rows[7][3]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).count() == 0


def test_hot_payload(spark, tmp_path):
    rows = [(None, k, "u", "hot" if k % 3 else f"own {k}") for k in range(3000)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    assert result(warc.read_archives(manifest, 5000)) == brute(rows)


def test_only_members_with_warc_headers_count():
    good = warc.record_member(1, "u", b"payload", None, False)
    foreign = gzip.compress(b"not a record " * 50)
    raw = b"junk" + warc.MAGIC + b"junk" + foreign + good + warc.MAGIC + good[:60]
    for start in range(len(raw) - len(good)):
        found = list(warc.records_in_range(io.BytesIO(raw), start, len(raw)))
        assert [at for at, _, _ in found] == ([raw.index(good)] if start <= raw.index(good) else [])


def test_header_of_any_length():
    url = "http://x/" + random.Random(2).randbytes(3 << 20).hex()
    first, second = warc.record_member(1, url, b"payload", None, False), warc.record_member(2, "u", b"next", None, False)
    found = list(warc.records_in_range(io.BytesIO(first + second), 0, len(first) + len(second)))
    assert [at for at, _, _ in found] == [0, len(first)]
    assert found[0][1]["warc-target-uri"] == url and found[0][2].endswith(b"payload")
