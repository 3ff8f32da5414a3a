"""Operator 4 on archives of other writers."""

import gzip
import json
import zipfile

import pytest

from cortexgrid.llm import warc

BODY = b"<html>" + b"many words " * 40 + b"</html>"


def record(kind, block, *fields, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def chunked(body):
    parts = [body[i : i + 97] for i in range(0, len(body), 97)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\nTransfer-Encoding: Chunked\r\n\r\n"
RECORDS = [
    record("warcinfo", b"software: another writer\r\n", "WARC-Record-ID: <urn:uuid:aaaa>", "Content-Type: application/warc-fields"),
    record("request", b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n", "WARC-Record-ID: <urn:uuid:bbbb>", "Content-Type: application/http; msgtype=request"),
    record("response", HTTP + chunked(BODY), "warc-record-id:<urn:uuid:cccc>", "WARC-Target-URI: http://a.example/", "Content-Type: application/http;", "  msgtype=response", f"WARC-Payload-Digest: sha1:{warc.payload_digest(BODY)}"),
    record("response", b"HTTP/1.1 200 OK\r\n\r\n" + BODY, "WARC-Record-ID: <urn:uuid:dddd>", "Content-Type: application/http; msgtype=response"),
    record("revisit", b"", "WARC-Record-ID: <urn:uuid:eeee>", "WARC-Refers-To: <urn:uuid:dddd>", version="WARC/1.1"),
    record("metadata", b"fetchTimeMs: 7\r\n", "WARC-Payload-Digest: sha256:00ff"),
    record("resource", "é".encode(), "WARC-Record-ID: <urn:uuid:ffff>", "Content-Type: text/plain"),
    record("response", b"HTTP/1.1 200 OK\r\n\r\n" + BODY[:9], "WARC-Record-ID: <urn:uuid:9999>", "WARC-Truncated: length", f"WARC-Payload-Digest: sha1:{warc.payload_digest(BODY)}"),
]
WANT = [
    ("warcinfo", 26, None), ("request", 0, None), ("response", len(BODY), "http://a.example/"), ("response", len(BODY), None), ("revisit", 0, None),
    ("metadata", 16, None), ("resource", 2, None), ("response", 9, None),
]


def archive(path, index, plain=False):
    packed = [r if plain else gzip.compress(r) for r in RECORDS]
    name = "data.warc" if plain else "data.warc.gz"
    lines, at = [], 0
    for i, raw in enumerate(packed):
        lines.append(f"com,example)/{i} 20200101000000 " + json.dumps({"offset": str(at), "length": str(len(raw)), "filename": name}))
        at += len(raw)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr(f"archive/{name}", b"".join(packed))
        z.writestr("datapackage.json", "{}")
        if index == "cdxj":
            z.writestr("indexes/index.cdxj", "\n".join(lines), zipfile.ZIP_DEFLATED)
        if index in ("cdx.gz", "idx"):
            blocks = [gzip.compress("\n".join(lines[k : k + 3]).encode() + b"\n") for k in range(0, len(lines), 3)]
            z.writestr("indexes/index.cdx.gz", b"".join(blocks))
            if index == "idx":
                start = [sum(map(len, blocks[:k])) for k in range(len(blocks))]
                z.writestr("indexes/index.idx", "!meta 0 " + json.dumps({"format": "cdxj-gzip-1.0"}) + "\n" + "".join(f"com,example)/{3 * k} 2020 " + json.dumps({"offset": s, "length": len(b)}) + "\n" for k, (s, b) in enumerate(zip(start, blocks))))
    return str(path)


@pytest.mark.parametrize("index", [None, "cdxj", "cdx.gz", "idx"])
def test_records_of_other_writers(spark, tmp_path, index):
    path = archive(tmp_path / f"other-{index}.wacz", index)
    rows = warc.read_archives(spark.createDataFrame([("file://" + path,)], "archive string")).collect()
    assert sorted((r.record_type, r.payload_bytes, r.url or "") for r in rows) == sorted((k, n, u or "") for k, n, u in WANT)
    by = {r.record_id: r for r in rows}
    assert by["<urn:uuid:cccc>"].payload == BODY == by["<urn:uuid:dddd>"].payload and by["<urn:uuid:dddd>"].payload_digest == warc.payload_digest(BODY)
    assert by["<urn:uuid:eeee>"].payload is None and by["<urn:uuid:eeee>"].refers_to_id == "<urn:uuid:dddd>" and by["<urn:uuid:eeee>"].refers_to is None
    assert all(r.page_id is None for r in rows)


def test_plain_records_by_index(spark, tmp_path):
    path = archive(tmp_path / "plain.wacz", "cdxj", plain=True)
    assert warc.read_archives(spark.createDataFrame([("file://" + path,)], "archive string")).count() == len(RECORDS)


def test_damage_is_an_error():
    good = RECORDS[2]
    assert warc.parse_record(good)[4] == warc.payload_digest(BODY)
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"many", b"tiny"))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))
