"""WARC archives, index first (operator 10).

Writing: payloads are told apart by their SHA-1 and length; the record with the smallest id of equal payloads is a response,
the others are revisits that refer to it. Each task writes its rows as one archive of gzip members in the shared folder and
returns one index row per record: file, offset, length, URL, digest. Only index rows of tasks that ended well are
kept, and archives of failed attempts have names that no index row holds.

Reading: index rows are selected first (by URL, digest, id or any column), dealt by file, sorted by offset, and
neighbouring byte ranges are fetched by one read each.

Edge cases: null payloads are empty; empty payloads are equal payloads too (with min_bytes 0); null ids sort after all
others and are carried along; ids with a line break are refused, for they go into a header; null URLs are written as an empty target; line breaks and blanks in URLs are
percent-encoded in the header and kept in the index; repeated rows of the smallest id are each a response; an empty table writes nothing and reads nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import sized, small_batches, table
from linkveil.session import materialize, new_path

DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than GAP are fetched together, up to about MOST bytes at a time.
GAP, MOST = 64 << 10, 8 << 20


def record_id(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def header_value(page_id) -> str:
    value = str(page_id)
    if "\r" in value or "\n" in value:
        raise ValueError("an id with a line break cannot go into a header")
    return value


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> tuple[bytes, str]:
    """One WARC/1.1 record as bytes, a revisit if refers_to is given; and its payload digest."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[6:6] = [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {header_value(refers_to)}"]
    if page_id is not None:
        lines.insert(6, f"X-Page: {header_value(page_id)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """The headers of a record (lower-case names), its kind and its payload's bytes, digest and text."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    kind = headers["warc-type"]
    if kind == "response":
        if len(payload) != size or f"sha1:{digest_of(payload)}" != headers["warc-payload-digest"]:
            raise ValueError("a payload does not match its header")
    return {"headers": headers, "type": kind, "payload": payload if kind == "response" else None, "bytes": size}


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Writes archives below path (a URI that all executors share) and returns the index as a table.

    Index: file, offset, length, url, digest, key, type.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(key, F.col(url).alias("__url"), F.struct(F.sha1(body).alias("s"), F.length(body).alias("n")).alias("__sha"), body.alias("__body"))
    own = rows.select(F.col("__sha").alias("__s"), key, (F.length("__body") >= min_bytes).alias("__long")).where("__long")
    first = own.groupBy("__s").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = sized(materialize(first, "first-records"), 100_000)  # a small table leaves the payloads where they are
    kind = pages.schema[key].dataType.simpleString()
    joined = rows.join(first, F.col("__sha") == F.col("__s"), "left").select(
        key, "__url", "__body", F.when(~F.col(key).eqNullSafe(F.col("__first")), F.col("__first")).alias("__refers")
    )

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            got = []
            for page_id, address, payload, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data, digest = record(page_id, address, payload, refers)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(data) + pack.flush()
                out.write(member)
                got.append((name, at, len(member), address, digest, page_id, "response" if refers is None else "revisit"))
                at += len(member)
            if got:
                columns = list(zip(*got, strict=True))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), b.schema.field(0).type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "offset", "length", "url", "digest", key, "type"])
        if out is not None:
            out.close()

    schema = f"file string, offset bigint, length bigint, url string, digest string, `{key}` {kind}, type string"
    with small_batches(pages.sparkSession):
        return materialize(joined.mapInArrow(per_partition, schema), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int, int]]:
    """(first, past, start, end): neighbouring ranges (offset, length), sorted, that one read of bytes start to end covers."""
    out: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            out[-1] = (out[-1][0], k + 1, out[-1][2], max(out[-1][3], offset + length))
        else:
            out.append((k, k + 1, offset, offset + length))
    return out


def read_warc(selected: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records of selected index rows: page_id string, url, payload_bytes, payload_digest, record_type, refers_to string, payload."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(path)
        name, source = None, None
        try:
            for b in batches:
                rows = list(zip(*[c.to_pylist() for c in b.columns], strict=True))
                at = 0
                while at < len(rows):
                    end = next((k for k in range(at, len(rows)) if rows[k][0] != rows[at][0]), len(rows))
                    if rows[at][0] != name:
                        if source is not None:
                            source.close()
                        name, source = rows[at][0], fs.open_input_file(f"{base}/{rows[at][0]}")
                    for first, past, start, stop in coalesced([r[1:3] for r in rows[at:end]]):
                        data, got = source.read_at(stop - start, start), []
                        for _, offset, length, address in rows[at + first : at + past]:
                            r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            h = r["headers"]
                            got.append((h.get("x-page"), address, r["bytes"], h["warc-payload-digest"].removeprefix("sha1:"), r["type"], h.get("x-refers-to-page"), r["payload"] if with_payload else None))
                        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                    at = end
        finally:
            if source is not None:
                source.close()

    # pieces of a file are read by tasks of their own: a hot or large file does not wait for one task
    piece = F.expr(f"offset div {8 * MOST}")
    dealt = selected.select("file", "offset", "length", "url").repartition("file", piece).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(fetch, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), path)
    out = read_warc(index, path, with_payload=False)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: The same rows in DuckDB; base 32 takes five hex digits to four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((list_reduce(list_transform(range(5), lambda k: CAST(strpos('0123456789abcdef', substr(s, 5 * (j // 4) + k + 1, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)
                     // CAST(pow(32, 3 - j % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
