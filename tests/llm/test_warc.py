"""WARC files, plain and compressed, from bytes to resolved revisits."""

import gzip

from loomlog.llm import revisits, warc


def record(kind, rid, url, date, http, body=b"", profile=""):
    block = http.encode() + b"\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{profile}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


PROFILE = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n"
RECORDS = [
    record("warcinfo", "i", "", "2024-01-01T00:00:00Z", "software: x"),
    record("response", "a", "http://ex.com/p/", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Type: text/html\r\nX: 1\r\nX: 2', b"<p>WARC/1.1 in a body</p>"),
    record("revisit", "b", "https://ex.com/p", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\nVary: A\r\nContent-Type: no', b"", PROFILE),
    record("revisit", "c", "https://ex.com/p", "2024-01-03T00:00:00Z", "HTTP/1.1 200 OK", b"", "WARC-Profile: identical-payload-digest\r\n"),
    record("revisit", "d", "https://ex.com/q", "2024-01-03T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "1"', b"", PROFILE),
]


def test_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(RECORDS) + RECORDS[1][:60])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r.replace(b"ex.com", b"ex.org")) for r in RECORDS) + b"\x1f\x8bcut")
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path))
    rows = found.collect()
    assert sorted(r.warc_id for r in rows) == sorted(["<a>", "<b>", "<d>"] * 2)
    assert {(r.http_status, bytes(r.body)) for r in rows if r.kind == "response"} == {(200, b"<p>WARC/1.1 in a body</p>")}
    got = {(r.url_key, r.kind): r for r in revisits.resolve_revisits(found).collect()}
    a, b = got["https://ex.com/p", "response"], got["https://ex.com/p", "revisit"]
    assert b.status == "resolved" and b.source_id == a.record_id
    assert b.headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "1, 2", "vary": "A"}
    assert got["https://ex.org/q", "revisit"].status == "orphan"


def test_pieces_and_issues(spark, tmp_path, monkeypatch):
    big = record("response", "z", "http://ex.com/big", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", bytes(range(256)) * 3000)
    lost = RECORDS[1].replace(b"Content-Length", b"Content-Size").replace(b"<p>WARC/1.1", b"<p>")
    whole = b"".join(RECORDS) + lost + big + RECORDS[2]
    want = [(h.get("warc-record-id"), b) for h, b in warc.records(whole)]
    assert [i for i, _ in want] == ["<i>", "<a>", "<b>", "<c>", "<d>", "<z>", "<b>"] and len(want[5][1]) > 768_000
    packed = gzip.compress(b"".join(RECORDS[:2])) + b"\0\0" + b"".join(gzip.compress(r) for r in (*RECORDS[2:], lost, big, RECORDS[2]))
    for piece in (1 << 20, 1000, 7):
        monkeypatch.setattr(warc, "PIECE", piece)
        for content in (whole, packed) if piece > 7 else (whole[:3000], packed):
            got = [(h.get("warc-record-id"), b) for h, b in warc.records(content)]
            assert got == want[: len(got)] and (len(got) == len(want) or content == whole[:3000])
    monkeypatch.undo()
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(packed[:-9])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(RECORDS[1]) + b"\x1f\x8bnonsense")
    got = {r.path.rsplit("/", 1)[1]: (r.records, r.no_length, r.broken) for r in warc.read_issues(spark, str(tmp_path)).collect()}
    assert got["a.warc"] == (7, 1, 0) and got["c.warc.gz"] == (1, 0, 1)
    assert got["b.warc.gz"][1:] == (1, 1)
