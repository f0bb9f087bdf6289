import gzip
import io
import random
import zlib

import pytest

from sparkredact.llm import warc

ROWS = [
    (1, "http://a/1", "<p>x</p>"),
    (2, "http://a/2", "<p>x</p>"),
    (3, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (4, "http://a/\r\nWARC-Type: evil", None),
    (5, "u", ""),
    (5, "u", ""),
    (None, "n", "<p>x</p>"),
    (None, "n", "alone"),
    (None, "m", "alone"),
    (9, "long", "y" * 3_000_000),
]


@pytest.fixture(scope="module", params=["none", "gzip"])
def archive(spark, tmp_path_factory, request):
    path = f"file://{tmp_path_factory.mktemp('warc')}/out"
    extra = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string")
    warc.write(extra.repartition(3), path, compression=request.param)
    return path


def test_round_trip(spark, archive):
    rows = warc.read(spark, archive).collect()
    assert len(rows) == len(ROWS)
    got = sorted((r.record_id, r.record_type, r.refers_to or "", (r.payload or b"").decode()) for r in rows)
    page = lambda i: f"<urn:page:{'null' if i is None else i}>"
    first = {"<p>x</p>": 2, "": 5}
    want = sorted(
        (page(i), "revisit", page(first[h]), "") if (h := html or "") in first and i != first[h] else (page(i), "response", "", h) for i, _, html in ROWS
    )
    assert got == want
    by_id = {r.record_id: r for r in rows}
    assert by_id["<urn:page:4>"].target_uri == "http://a/%0D%0AWARC-Type: evil"
    assert by_id["<urn:page:3>"].target_uri is None
    assert by_id["<urn:page:1>"].payload_length == 8
    for r in rows:
        if r.record_type == "response":
            assert r.payload_digest == "sha1:" + warc.sha1_base32(bytes(r.payload))


def test_predicates_go_to_the_reader(spark, archive):
    some = warc.read(spark, archive, payload=False).filter("record_type = 'revisit'")
    assert "= revisit" not in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 3 and some.filter("payload is not null").count() == 0


def test_least_payload(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:2] + ROWS[4:6], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", least=5)
    kinds = sorted(r.record_type for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    assert kinds == ["response"] * 3 + ["revisit"]


def test_compressed_members_skips_and_folded_headers():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://x\r\n /y\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    wanted = [("record_type", frozenset(["response"]))]
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(one) + gzip.compress(two)))
    (row,) = warc.records(stream, wanted, True)
    assert row["payload"] == b"body" and row["target_uri"] == "http://x /y"
    assert [r["record_type"] for r in warc.records(io.BytesIO(one + two), [], False)] == ["warcinfo", "response"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk\r\n\r\n"), [], True))


def test_unwanted_members_are_not_inflated(monkeypatch):
    record = lambda kind, body: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    big = random.Random(1).randbytes(2_000_000)
    data = warc.member(record(b"response", big)) + warc.member(record(b"revisit", b"x")) + warc.member(record(b"response", b""))
    assert [gzip.decompress(data)[:8]] == [b"WARC/1.1"]
    inflated, original = [], warc._Member.read
    monkeypatch.setattr(warc._Member, "read", lambda self, n: inflated.append(out := original(self, n)) or out)
    wanted = [("record_type", frozenset(["revisit"]))]
    assert [r["payload"] for r in warc.compressed(io.BytesIO(data), wanted, True)] == [b"x"]
    assert sum(map(len, inflated)) < 50_000
    assert [r["payload"] for r in warc.compressed(io.BytesIO(data), [], True)] == [big, b"x", b""]
    assert [r["payload_length"] for r in warc.compressed(io.BytesIO(data), [], False)] == [len(big), 1, 0]
    for bad in (data[: len(data) // 2], data[:1000] + b"\xff\xff" + data[1002:]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.compressed(io.BytesIO(bad), [], True))


def test_records_cut_short_or_without_length():
    head = b"WARC/1.1\r\nWARC-Type: resource\r\n"
    for bad in (head + b"Content-Length: 100\r\n\r\nshort", head + b"\r\n", head + b"Content-Length: ten\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad), [], True))
    no_blank = head + b"Content-Type: application/http\r\nContent-Length: 6\r\n\r\nHTTP/1\r\n\r\n" + head + b"Content-Length: 2\r\n\r\nok\r\n\r\n"
    assert [r["payload"] for r in warc.records(io.BytesIO(no_blank), [], True)] == [b"HTTP/1", b"ok"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0
