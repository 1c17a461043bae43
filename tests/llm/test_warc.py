from __future__ import annotations

import gzip

import pytest

from rallypoint.llm import warc as w
from rallypoint.llm.common import new_dir
from rallypoint.llm.queries import ORACLES, QUERIES
from tests.compare import same_rows

SCHEMA = "page_id bigint, url string, html string, key string, payload_bytes string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def folder_of(spark):
    folder = new_dir(spark, "warc-test")
    fs, path = w.FileSystem.from_uri(folder)
    fs.create_dir(path)
    return folder


def test_query_equals_sql(spark, duck, small):
    same_rows(QUERIES["op8_capture_index"](spark, small), duck.sql(ORACLES["op8_capture_index"]))


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://www.Example.com/a?b=1#c", "com,example,www)/a?b=1"), ("https://x.org:8080", "org,x:8080)/"), (None, ""), ("not a url", "not a url"), ("http://[bad", "http://[bad")],
)
def test_keys(url, want):
    assert w.url_key(url) == want


def test_records_are_warc(spark):
    member = w.record(7, "http://a.b/ü x", "é".encode(), None, False)
    raw = gzip.decompress(member)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith("é\r\n\r\n".encode())
    got = w.parse(member)
    assert (got["page_id"], got["record_type"], got["payload_bytes"], got["payload"]) == ("7", "response", 2, "é".encode())
    with pytest.raises(ValueError, match="damaged"):
        w.parse(gzip.compress(raw.replace("é".encode(), b"xy")))


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a.com/", "same"), (2, "http://a.com/", "same"), (2, "http://a.com/", "same"), (3, None, None), (4, "x\r\ny", ""), (None, "http://a.com/", "same"), (9, "http://b.com/", "z" * 200_000), (9, "http://b.com/", "z" * 200_000)]
    got = sorted(map(tuple, w.round_trip(spark, pages(spark, *rows)).collect()), key=str)
    same, empty, long = (w.base32_sha1(x) for x in (b"same", b"", b"z" * 200_000))
    want = [(1, 4, same, "response", None), (2, 4, same, "revisit", 1), (2, 4, same, "revisit", 1), (3, 0, empty, "response", None), (4, 0, empty, "revisit", 3), (None, 4, same, "revisit", 1), (9, 200_000, long, "response", None), (9, 200_000, long, "response", None)]
    assert got == sorted(want, key=str)
    assert w.round_trip(spark, pages(spark, *rows).limit(0)).count() == 0


def test_lookup_over_many_blocks_and_parts(spark):
    folder = folder_of(spark)
    rows = [(i, f"http://h{i % 7}.com/p{i // 7 % 30}", f"text {i}") for i in range(900)]
    captures = w.write(pages(spark, *rows), folder, archive_bytes=20_000)
    parts = w.index(captures, folder, lines=10, lines_per_part=150)
    assert len(parts) > 2
    keys = spark.createDataFrame([(w.url_key(u),) for u in ("http://h3.com/p5", "http://h0.com/p0", "http://none.com/")], "key string")
    found = w.fetch(w.find(keys, folder, parts), folder)
    want = {str(i) for i, u, _ in rows if u in ("http://h3.com/p5", "http://h0.com/p0")}
    assert {r["page_id"] for r in found.collect()} == want
    assert {bytes(r["payload"]).decode() for r in found.collect()} == {f"text {i}" for i in want}


def test_small_payloads_are_never_revisits(spark):
    out = w.deduplicated(pages(spark, (1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")), min_bytes=3)
    assert {r["page_id"]: r["refers_to"] for r in out.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_any_text_is_an_id(spark):
    ids = ["", None, "a\nb", "a b", "x>y", "%41", "é/:", "WARC-Type: x\r\n\r\n"]
    made = spark.createDataFrame([(x, f"http://a.com/{i}", f"p{i // 4}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    got = [(r.page_id, r.refers_to) for r in w.round_trip(spark, made).collect()]
    first = lambda xs: min(x for x in xs if x is not None)
    want = [(x, None if x == first(ids[k : k + 4]) else first(ids[k : k + 4])) for k in (0, 4) for x in ids[k : k + 4]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_key_of_many_captures_is_searched_by_part(spark):
    folder = folder_of(spark)
    rows = [(i, None, f"text {i}") for i in range(2000)] + [(9000, "http://a.com/", "x")]
    captures = w.write(pages(spark, *rows), folder)
    parts = w.index(captures, folder, lines=20, lines_per_part=200)
    found = w.find(captures, folder, parts)
    assert found.count() == 2001 and found.select("file", "offset").distinct().count() == 2001
    each = found.groupBy(w.F.spark_partition_id().alias("p")).count().collect()
    assert len(each) > 5 and max(r["count"] for r in each) < 600
