import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from quillspark.llm import warc

SCHEMA = "page_id long, url string, html string, kind string, payload binary, copy string, sha int, value long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", b"p", "c", 1, 2) for r in rows], SCHEMA)


def brute(rows, least=0):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault((r[2] or "").encode(), []).append(r)
    out = Counter()
    for payload, mine in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, r in enumerate(mine):
            again = k > 0 and len(payload) >= least
            out[r[0], len(payload), digest, "revisit" if again else "response", mine[0][0] if again else None] += 1
    return out


def pages():
    rng = random.Random(8)
    body = lambda n: "".join(rng.choice("abc <>\r\n\r\nÜ漢😀") for _ in range(n))
    rows = [(i, f"http://h{i % 3}.example.com/p?{i}", body(rng.randrange(200))) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "no scheme", "   "), (103, "http://a b\r\nc/", "x\r\n\r\nWARC/1.1\r\n\r\ny"), (None, "http://n/", "nobody"), (None, None, "nobody"), (90, "u", "nobody")]
    rows += [(5, "http://other/", rows[7][2]), rows[9], rows[9], (200, None, None), (201, "big", "long text " * 300_000)]
    rows += [(300 + i, f"http://copies/{i}", "the same page") for i in range(400)] + [(7, "http://x/", "\x00\x01 nul")]
    return rows


@pytest.mark.parametrize("least", [0, 8])
def test_against_brute_force(spark, least):
    rows = pages()
    got = warc.round_trip(frame(spark, rows), least).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows, least)
    assert all(r["digest_holds"] for r in got)


def test_copies_of_a_row_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(3, "u", "text of it")] * 50 + [(2, "v", "text of it")] + [(9, "w", "ab")] * 20 + [(None, None, None)] * 3
    for least in (0, 5):
        got = warc.round_trip(frame(spark, rows), least).collect()
        assert Counter(tuple(r)[:5] for r in got) == brute(rows, least)
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_heads_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEADS_BROADCAST", 0)
    rows = pages()
    assert Counter(tuple(r)[:5] for r in warc.round_trip(frame(spark, rows)).collect()) == brute(rows)


def test_assembled_captures_hold_what_was_written(spark):
    rows = pages()
    path = warc.write(frame(spark, rows), per_file=30)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    kinds = Counter(f["warc-type"] for x in files for f, _ in warc.parse(bytes(x["content"])))
    n = len(rows)
    assert len(files) >= 3 * n / 30 and kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == n
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == n and all(r["n_requests"] == r["n_metadata"] == 1 for r in got)
    payloads = Counter(bytes(r["response"]["payload"]) for r in got if r["response"]["kind"] == "response")
    assert payloads == Counter({(r[2] or "").encode(): 1 for r in rows})
    assert all(r["request"]["block"].startswith(b"GET ") for r in got)


def test_members_partial_captures_and_broken_files(spark, tmp_path):
    record = lambda kind, id_, body, *more: "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *more, f"Content-Length: {len(body)}", "", body, "", ""]).encode()
    parts = [record("warcinfo", "w", "software: x"), record("response", "a", "HTTP/1.1 200 OK\r\n\r\nbody"), record("request", "q2", "GET 2", "WARC-Concurrent-To: a"), record("request", "q1", "GET 1", "WARC-Concurrent-To: a"), record("metadata", "m", "{}", "WARC-Concurrent-To: elsewhere"), record("revisit", "b", "HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: gone", "WARC-Payload-Digest: sha1:AAA")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = {r["capture_id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"a", "b"}
    assert bytes(got["a"]["response"]["payload"]) == b"body" and bytes(got["a"]["request"]["block"]) == b"GET 1" and got["a"]["n_requests"] == 2
    assert got["a"]["metadata"] is None and got["b"]["response"]["refers_to"] == "gone" and got["b"]["n_requests"] == 0
    for broken in (parts[1][:-6], parts[1][:30], b"HELLO\r\n\r\n", parts[1].replace(b"Content-Length: 23", b"Content-Length: 21")):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_sql_agrees(spark):
    import duckdb

    from quillspark.llm.queries import ORACLE, QUERIES

    got = [tuple(r)[:5] for r in QUERIES["op12_warc"](spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    db = duckdb.connect()
    db.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = db.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLE['op12_warc']})").fetchall()
    assert Counter(got) == Counter(want)
