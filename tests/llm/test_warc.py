import hashlib

import pytest

from rowparity.llm.warc import MAGIC, read_archives, round_trip

SCHEMA = "page_id long, url string, html string, payload string, record_type string, n int"


def brute(rows):
    best = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000:
            best[data] = max((x for x in (best.get(data), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = best.get(data)
        revisit = first is not None and i != first
        out.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(first) if revisit else "None"))
    return sorted(out)


def digest(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", "x"), (2, "http://b", None), (3, None, ""), (4, "u\r\nEvil: 1", fake), (5, "u", fake * 40), (6, "u", big), (7, "u", big), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", "\r\n\r\n" * 300), (11, "u", "WARC/1.1\r\n" * 150), (12, "u", "z" * 300_000), (None, "u", big), (7, "u", big), (13, "u", "a\nb\r\x00c" * 200)]
    found = round_trip(make(spark, rows), str(tmp_path / "a"), 2000)
    assert digest(found) == brute(rows)
    assert {r.page_id: bytes(r.payload).decode() for r in found.collect() if r.record_type == "response" and r.page_id is not None} == {i: h or "" for i, _, h in rows if i not in (None, 6)}


def test_empty_table(spark, tmp_path):
    assert round_trip(make(spark, []), str(tmp_path / "e")).collect() == []


def record(payload, digest=None):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = "WARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    head %= digest or hashlib.sha1(payload).hexdigest(), len(body)
    return MAGIC.encode() + head.encode() + body + b"\r\n\r\n"


INNER = record(b"inner")
PAYLOADS = [b"a", INNER, INNER * 3 + MAGIC.encode(), b"", MAGIC.encode() * 5, record(INNER), b"x" * 700 + INNER + b"\xff\r\n\r\n", INNER * 9, b"z"]


def archive(folder, data):
    folder.mkdir()
    (folder / "part-0").write_bytes(data)
    return str(folder)


@pytest.mark.parametrize("split", [200, 1000, 1 << 27])
def test_chain_rejects_magic_in_payloads(spark, tmp_path, split):
    starts, at = [], 0
    for p in PAYLOADS * 3:
        starts.append(at)
        at += len(record(p))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = archive(tmp_path / "a", b"".join(map(record, PAYLOADS * 3)))
        rows = sorted((r.offset, bytes(r.payload)) for r in read_archives(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(zip(starts, PAYLOADS * 3, strict=True))


def test_a_false_chain_that_joins_the_true_one(spark, tmp_path):
    """A header in a payload whose record would end with the payload's own: its successor is a true record."""
    head = MAGIC.encode() + b"WARC-Type: response\r\nContent-Length: 3\r\n\r\n"
    payloads = [b"one", b"before " + head + b"abc", b"two", head + b"abc", b"three"]
    rows = read_archives(spark, archive(tmp_path / "a", b"".join(map(record, payloads)))).collect()
    assert [bytes(r.payload) for r in sorted(rows, key=lambda r: r.offset)] == payloads


@pytest.mark.parametrize("data", [record(b"a") + record(b"b")[:-2], b"x" + record(b"a"), record(b"a") + record(b"b") + b"more", record(b"a") + record(b"b")[:-9]])
def test_broken_archives_are_refused(spark, tmp_path, data):
    with pytest.raises(ValueError):
        read_archives(spark, archive(tmp_path / "a", data))


def test_wrong_payloads_are_refused(spark, tmp_path):
    found = read_archives(spark, archive(tmp_path / "a", record(b"a") + record(b"b", "0" * 40)))
    with pytest.raises(Exception, match="digest"):
        found.collect()
