import base64
import hashlib
import io
import gzip

from linkveil.llm import warc as q
from linkveil.session import new_path

PAGES = "page_id long, url string, html string, text string, file string, digest string"


def want(rows):
    first = {}
    for r in rows:
        h = r.html or ""
        if r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        f = first.get(r.html or "")
        same = f is None or r.page_id == f
        out.append((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else f))
    return sorted(out, key=str)


def check(spark, pages):
    path = new_path(spark, "w")
    index = q.write_warc(pages, path)
    got = q.read_warc(index, path).collect()
    rows = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got]
    assert sorted(((a, b, c, d, e) for a, b, c, d, e in rows), key=str) == want(pages.collect())
    return path, index, got


def test_pages_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path, index, got = check(spark, pages)
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(r.payload.decode() == html[int(r.page_id)] for r in got if r.record_type == "response")
    some = index.where("page_id % 7 = 3")
    assert {int(r.page_id) for r in q.read_warc(some, path).collect()} == {x for x in html if x % 7 == 3}


def test_awkward_pages(spark):
    rows = [
        (1, "http://a/\r\nX-Page: 9", "same", "x", "f", "d"), (2, None, "same", None, None, None), (3, "u", None, None, None, None), (4, "", "", None, None, None),
        (5, "é ü", "long " * 300_000, None, None, None), (None, "n", "same", None, None, None), (6, "u", "\r\n\r\nWARC/1.1\r\n", None, None, None), (0, "z", "same", None, None, None),
        (6, "u", "\r\n\r\nWARC/1.1\r\n", None, None, None), (None, None, "alone", None, None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    path, index, got = check(spark, pages)
    assert {r.url for r in got} == {r[1] for r in rows}
    assert q.read_warc(q.write_warc(pages.limit(0), new_path(spark, "w")), path).count() == 0


def test_archives_are_readable_from_start_to_end(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = new_path(spark, "w")
    index = q.write_warc(pages, path).collect()
    for name in {r.file for r in index}:
        data = gzip.GzipFile(fileobj=io.BytesIO(open(f"{path}/{name}".removeprefix("file://").removeprefix("file:"), "rb").read())).read()
        assert data.count(b"WARC/1.1\r\n") == sum(r.file == name for r in index)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    index = q.write_warc(pages, new_path(spark, "w"), min_bytes=3)
    assert {r.page_id: r.type for r in index.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_ranges_coalesce():
    assert q.coalesced([(0, 10), (10, 5), (100, 5), (1000, 5)], gap=90, most=200) == [(0, 3, 0, 105), (3, 4, 1000, 1005)]
    assert q.coalesced([(0, 10), (10, 10)], gap=0, most=15) == [(0, 1, 0, 10), (1, 2, 10, 20)]


def test_ids_with_line_breaks_are_refused():
    import pytest

    for bad in ("a\nb", "a\r\nX-Page: 2"):
        with pytest.raises(ValueError, match="line break"):
            q.record(bad, "u", b"x")
        with pytest.raises(ValueError, match="line break"):
            q.record("ok", "u", b"x", bad)
