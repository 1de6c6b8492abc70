import hashlib
import struct

import pytest

from quillstream.llm import warc_archive as W
from quillstream.llm.shared import fresh_path

PAGES = "page_id long, url string, html string, status string, payload string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_pages_come_back(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u\r\nv", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "z" * 200_000), (9, None, big)]
    folder = fresh_path(spark, "test-warc")
    W.write(W.with_revisits(make(spark, rows)), folder)
    got = W.page_records(spark, folder).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    for i, _, html in rows:
        raw = (html or "").encode()
        mine = [r for r in got if r.page_id == i]
        assert all((r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()) for r in mine)
        revisit = html == big and i in (1, 2)
        assert {(r.record_type, r.refers_to) for r in mine} == {("revisit", 9) if revisit else ("response", None)}
    whole = {r.record_id: r for r in W.read(spark, folder).collect()}
    assert bytes(whole["urn:quillstream:page:7"].payload) == b"z" * 200_000
    assert whole["urn:quillstream:page:3"].target_uri == "uv"


def test_empty_table(spark):
    folder = fresh_path(spark, "test-warc")
    W.write(W.with_revisits(make(spark, []).where("false")), folder)
    assert spark.read.parquet(f"{folder}/manifest").count() == 0


def record(payload=b"hello"):
    return W.record_bytes(1, "http://a", payload, hashlib.sha1(payload).hexdigest(), None, "2024-01-01T00:00:00Z")


def test_archives_roll_and_keep_frames():
    records = [record(bytes([65 + k % 26]) * (50 + k)) for k in range(700)]
    made = list(W.archives(iter(records)))
    assert sum(n for _, n in made) == 700
    assert all(struct.unpack_from("<I", raw)[0] == W.MAGIC_DICTIONARY for raw, _ in made)
    assert [r for raw, _ in made for r in W.frames(raw)] == records
    assert list(W.archives(iter([]))) == []


def test_broken_archives():
    raw, _ = next(W.archives(iter([record()] * 3)))
    for bad in (raw[:5], b"\0" * 20, raw[:-3], raw[:9] + raw[10:]):
        with pytest.raises(ValueError):
            list(W.frames(bad))


@pytest.mark.parametrize(
    "change, status",
    [
        (lambda r: r, "ok"),
        (lambda r: r[:-1], "wrong length"),
        (lambda r: r.replace(b"hello", b"hullo"), "wrong digest or payload length"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "missing warc-date"),
        (lambda r: b"junk", "no WARC header"),
        (lambda r: r.replace(b"sha1:", b"sha1:!!"), "bad digest"),
    ],
)
def test_records_are_validated(change, status):
    assert W.parse_record(change(record()))["status"] == status
