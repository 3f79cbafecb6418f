import base64
import hashlib

import pytest

from factorloom.llm import warc


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_with_magic_inside_payloads(spark, tmp_path, compression):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\n" + "x" * 500
    rows = [(i, f"http://a/{i}", "body é %d " % (i % 40) * (1 + i % 7)) for i in range(300)]
    across = ("y" * 700 + trap) * 40
    rows += [(1005, "http://e/", across), (1000, "http://b/", trap), (1001, None, trap * 50), (1002, "http://c/", None), (1003, "http://d/", ""), (1004, "u", long), (None, "n", "none")]
    path = str(tmp_path / "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_warc(pages, path, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = warc.page_records(warc.read_warc(spark, path, with_payload=False, jump_bytes=1500)).collect()
        bodies = {(r.id, bytes(r.payload)) for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    best = {}
    for i, _, h in rows:
        best.setdefault(h or "", []).append(i)
    newest = {h: max((i for i in ids if i is not None), default=None) for h, ids in best.items()}
    want = set()
    for i, _, h in rows:
        data, top = (h or "").encode(), newest[h or ""]
        want.add((i, len(data), _b32(data), "response" if i == top else "revisit", None if i == top else top))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert len(got) == len(rows)
    assert ("<urn:page:1001>", (trap * 50).encode()) in bodies and ("<urn:page:1004>", long.encode()) in bodies
    assert ("<urn:page:1005>", across.encode()) in bodies


def test_broken_archives_keep_what_comes_before(spark, tmp_path):
    """A record without its end, one that claims more than the file holds, and a file that begins otherwise."""
    record = lambda i, body, n=None, end="\r\n\r\n": f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) if n is None else n}\r\n\r\n{body}{end}"
    long = "z" * 3000 + "WARC/1.1\r\n" + "z" * 3000
    files = {"a": record(1, "x") + record(2, long, end="xxxx") + record(3, "y"), "b": record(4, "x") + record(5, "x", n=1 << 40), "c": "junk" + record(6, "x"), "d": record(7, long) + record(8, "x")}
    for name, data in files.items():
        (tmp_path / f"part-{name}").write_text(data, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id[10:-1], bytes(r.payload).decode()) for r in got) == [("1", "x"), ("4", "x"), ("7", long), ("8", "x")]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_warc(spark, path, with_payload=False)).count() == 0
