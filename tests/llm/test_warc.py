import gzip
import hashlib
import zlib

import pytest
from tests.llm.conftest import LONG

from gleaner.llm import warc
from gleaner.session import Workspace

SCHEMA = "page_id bigint, url string, html string, archive string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "").encode() == body and j is not None), default=None)
        revisit = len(body) >= 1000 and i is not None and i < top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "x" * 1000),
    (2, "http://a/2", "x" * 1000),
    (3, None, "x" * 999),
    (4, "http://a/\r\nX: y", "x" * 999),
    (5, "u", None),
    (6, "u", ""),
    (None, "u", "x" * 1000),
    (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 900),
    (8, "ü", "é\r\n\r\nWARC/1.1\r\n" * 900),
    (8, "ü", "é\r\n\r\nWARC/1.1\r\n" * 900),
    (9, "long", LONG),
    *[(100 + i, "hot", "h" * 5000) for i in range(200)],
]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS)).collect()
    assert all(r.error is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_archives_are_gzip_members_of_one_record(spark):
    folder = Workspace(spark, "warc-test").path
    manifest = warc.write_archives(warc.with_revisits(pages(spark, ROWS)), folder)
    whole = b""
    for row in manifest.collect():
        with open(row.archive.removeprefix("file:"), "rb") as f:
            packed = f.read()
        assert len(list(warc.members(iter([packed])))) == row.records
        whole += gzip.decompress(packed)
    assert whole.count(b"WARC-Record-ID: ") == len(ROWS)
    payloads = {r.page_id: r.payload for r in warc.read_archives(manifest).collect()}
    assert payloads[9] == LONG.encode() and payloads[1] is None and payloads[2] == b"x" * 1000


def test_blocks_of_any_size_give_the_same_members():
    records = [warc.record_bytes(i, f"u{i}", bytes([65 + i]) * i * 300, None) for i in range(9)]
    packed = b"".join(gzip.compress(r) for r in records)
    for n in (1, 7, 64, 10**6):
        assert [m for _, m in warc.members(packed[i : i + n] for i in range(0, len(packed), n))] == records


def test_damage_is_told():
    record = warc.record_bytes(1, "u", b"payload", None)
    warc.parse_record(record)
    for bad in (record[:-1], record + b"x", record.replace(b"payload", b"paylode"), b"WARC/1.1\r\n", record.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(iter([gzip.compress(record)[:-3]])))
    with pytest.raises(zlib.error):
        list(warc.members(iter([b"not gzip"])))


def test_a_broken_archive_gives_an_error_row(spark, tmp_path):
    good, bad = gzip.compress(warc.record_bytes(1, "u", b"a", None)), gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(good + bad + good + good[:20])
    manifest = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", 4, 0)], warc.MANIFEST)
    got = warc.read_archives(manifest).collect()
    assert [r.error is None for r in got] == [True, False, True, False]
