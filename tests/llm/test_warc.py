import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seatloom.llm import warc
from seatloom.llm.common import work_path


@given(st.binary(max_size=500), st.integers(1, 64))
def test_chunks_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("data", [b"", b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"2\r\nabXX", b"-1\r\n\r\n"])
def test_broken_chunks(data):
    with pytest.raises(ValueError):
        warc.dechunked(data)


def pages(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 400
    rows = [(1, "http://a", big), (2, None, big), (3, "x\r\ny", "short"), (4, "x", "short"), (5, "x", None), (6, "x", ""), (7, "x", "y" * 99), (8, "x", "y" * 99), (9, "x", "z" * 100), (10, "x", "z" * 100), (9, "x", "z" * 100), (None, "x", "z" * 100), (-4, "x", "\r\n\r\n" * 3000)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")


def test_pages_come_back_whole(spark):
    rows, df = pages(spark)
    got = warc.roundtrip(df).collect()
    firsts = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            firsts[h] = min(p, firsts.get(h, p))
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        first = firsts.get(h)
        revisit = first is not None and first != p
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got])) == sorted(map(str, want))
    assert all(r.intact for r in got)
    path = work_path(spark, "warc")
    warc.write_archives(warc.page_records(df), path)
    read = warc.http_payloads(warc.reassemble(warc.read_archives(spark, path))).collect()
    assert {bytes(r.payload) for r in read if r.kind == "response"} == {(h or "").encode() for _, _, h in rows}
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_payloads_that_no_page_with_an_id_has(spark):
    df = spark.createDataFrame([(None, "a", "q" * 200), (None, "b", "q" * 200)], "page_id bigint, url string, html string")
    assert [(r.kind, r.refers_to, r.payload_bytes) for r in warc.roundtrip(df).collect()] == [("response", None, 200)] * 2


def test_revisits_are_resolved(spark):
    rows = [(1, "response", None, 10, "d", True), (2, "revisit", 1, 10, "d", True), (3, "revisit", 1, 11, "d", True), (4, "revisit", 1, 10, "e", True), (5, "revisit", 9, 10, "d", True), (6, "response", None, None, None, False), (7, "revisit", 6, 1, None, True), (1, "response", None, 10, "d", True)]
    df = spark.createDataFrame(rows, "page_id bigint, kind string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.intact) for r in warc.resolve_revisits(df).collect()}
    assert got == {1: (10, "d", True), 2: (10, "d", True), 3: (None, None, False), 4: (None, None, False), 5: (None, None, False), 6: (None, None, False), 7: (None, None, False)}
    assert warc.resolve_revisits(df).count() == len(rows)


def test_small_segments_reassemble_in_any_order(spark):
    rows, df = pages(spark)
    path = work_path(spark, "warc")
    warc.write_archives(warc.page_records(df), path, segment_bytes=1000, chunk_bytes=77)
    records = warc.read_archives(spark, path)
    assert records.where("segment > 1").count() > 5
    twice = records.unionByName(records.where("segment = 2")).repartition(5)
    whole = warc.http_payloads(warc.reassemble(twice)).collect()
    columns = ["origin", "kind", "refers_to", "payload_bytes", "payload_digest", "intact"]
    assert sorted(map(str, warc.read_captures(spark, path).select(columns).collect())) == sorted(str(r) for r in warc.http_payloads(warc.reassemble(records)).select(columns).collect())
    assert len(whole) == len(rows) and all(r.intact for r in whole)
    for gone in ("segment = 1", "segment = 2", "total is not null"):
        left = warc.http_payloads(warc.reassemble(records.where(f"not coalesce({gone}, false)"))).collect()
        broken = [r for r in left if not r.intact]
        assert broken and all(r.payload is None for r in broken)


def test_damaged_files_are_errors():
    good = warc._record("response", "a", b"block") + b"\r\n\r\n"
    assert [b for _, b in warc.parse_records(good * 2)] == [b"block"] * 2
    for bad in (good[:-5], b"junk", good + b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))
