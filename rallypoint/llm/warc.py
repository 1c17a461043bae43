"""WARC archives with a two-level capture index.

Tasks write records, each a gzip member, into archive files of the shared
folder. Captures (key, file, offset, length) are dealt to index parts by ranges
of their key, the URL with its host reversed; a part holds sorted lines in
compressed blocks and, at its end, a sparse directory with each block's first
and last key. A list of the parts' first and last keys is the upper level. A
lookup searches the list and then the directory by bisection, reads the block's
range alone, and the records' ranges after that.

Only captures that a finished task reported reach the index; what a lost task
had written is never read.

A key with very many captures spans parts, each of which its own task searches,
and captures are handed on block by block. The upper level has a row for every
LINES_PER_PART captures, and travels to the tasks.

Defined results for unusual input: a null html has an empty payload, a null url
an empty key; ids are percent-encoded in records, so that any text, line ends
and the empty one too, comes back as it was, apart from null; a null page_id is
never referred to unless all equal payloads have null ids, which then are all
responses; repeated rows with the smallest page_id are responses; very long
payloads are written whole; an empty table gives an empty result; other columns,
whatever their names, are never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.llm.common import materialise, new_dir, partitions_for

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1000
LINES_PER_PART = 1 << 15
#: Payload bytes that a task hands on at a time.
HANDED_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
MIN_REVISIT_BYTES = 0
_FOOTER = struct.Struct("<QQ")
CAPTURE = "key string, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """The URL for sorting: host labels reversed, then port, path and query; no scheme."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: Iterable[tuple[str, object]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _name(page_id: object) -> str:
    return "<urn:x-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit holds the response's head alone."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_head(fields, "WARC/1.1") + block + b"\r\n\r\n") + packer.flush()


_ID = re.compile(r"<urn:x-page(?::(.*))?>")


def _id(name: str) -> str | None:
    found = _ID.fullmatch(name)[1]
    return None if found is None else unquote(found)


def parse(member: bytes) -> dict:
    """page_id and refers_to (as text), url, record_type, payload_bytes, payload_digest and payload of a record.

    Raises ValueError if a response's payload doesn't match its digest.
    """
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    own = {k: _id(fields[f]) if f in fields else None for k, f in (("page_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"))}
    return own | {"url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _file(folder: str, label: str, ending: str) -> str:
    return f"{folder}/{label}-{uuid.uuid4().hex}.{ending}"


def write_records(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Appends every row's record to this task's archives; yields the captures."""
    store, base = FileSystem.from_uri(folder)
    out, path, at = None, "", 0
    try:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    path, at = _file(base, "pages", "warc.gz"), 0
                    out = store.open_output_stream(path, compression=None)
                member = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"])
                out.write(member)
                rows.append((url_key(row["url"]), path, at, len(member)))
                at += len(member)
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "file", "offset", "length"])
    finally:
        if out is not None:
            out.close()


def write_part(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Writes this task's sorted captures as one index part; yields its place and key range."""
    store, base = FileSystem.from_uri(folder)
    path, held, blocks, at, n = _file(base, "index", "cdx"), [], [], 0, 0
    out = None

    def end_block() -> None:
        nonlocal at
        packed = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), LEVEL)
        out.write(packed)
        blocks.append((held[0][0], held[-1][0], at, len(packed)))
        at += len(packed)
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out = out or store.open_output_stream(path, compression=None)
            held.append(row)
            n += 1
            if len(held) >= lines:
                end_block()
    if out is None:
        return
    if held:
        end_block()
    directory = zlib.compress(json.dumps(blocks).encode())
    out.write(directory + _FOOTER.pack(at, len(directory)))
    out.close()
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (blocks[0][0], blocks[-1][1], path, n)], names=["first", "last", "part", "n"])


class Lookup:
    """Finds captures by key; parts are (first, last, path) in order."""

    def __init__(self, folder: str, parts: list[tuple[str, str, str]]) -> None:
        self.store, _ = FileSystem.from_uri(folder)
        self.parts, self.lasts = parts, [x[1] for x in parts]
        self.open_part, self.blocks, self.block_lasts = "", [], []
        self.open_block, self.rows, self.keys = ("", -1), [], []

    def _range(self, path: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(path) as f:
            return f.read_at(length, offset)

    def _part(self, path: str) -> None:
        if path != self.open_part:
            size = self.store.get_file_info(path).size
            offset, length = _FOOTER.unpack(self._range(path, size - _FOOTER.size, _FOOTER.size))
            self.blocks = json.loads(zlib.decompress(self._range(path, offset, length)))
            self.block_lasts = [x[1] for x in self.blocks]
            self.open_part = path

    def _block(self, i: int) -> None:
        if (self.open_part, i) != self.open_block:
            self.rows = [json.loads(x) for x in zlib.decompress(self._range(self.open_part, *self.blocks[i][2:])).decode().split("\n")]
            self.keys = [x[0] for x in self.rows]
            self.open_block = (self.open_part, i)

    def parts_of(self, key: str) -> Iterator[int]:
        """Numbers of the parts that may hold the key."""
        for p in range(bisect.bisect_left(self.lasts, key), len(self.parts)):
            if self.parts[p][0] > key:
                return
            yield p

    def find(self, key: str, part: int) -> Iterator[list[list]]:
        """[key, file, offset, length] of each capture of the key in a part, block by block."""
        self._part(self.parts[part][2])
        for i in range(bisect.bisect_left(self.block_lasts, key), len(self.blocks)):
            if self.blocks[i][0] > key:
                return
            self._block(i)
            yield self.rows[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]


def deduplicated(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to, revisit: every page, equal payloads tied to their smallest page_id."""
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    many = marked.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialise(many.select(F.col("digest").alias("equal"), "original"), "equal")
    tied = marked.join(many, F.col("digest") == F.col("equal"), "left")
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.lit(False))
    return tied.select("page_id", "url", "html", F.when(revisit, F.col("original")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) into folder; the captures."""
    return materialise(deduplicated(pages, min_bytes).mapInArrow(lambda b: write_records(b, folder, archive_bytes), CAPTURE), "captures")


def index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES, lines_per_part: int = LINES_PER_PART) -> list[tuple[str, str, str]]:
    """Writes the index parts into folder; their (first, last, path), a row per lines_per_part captures."""
    order = ["key", "file", "offset"]
    dealt = captures.repartitionByRange(partitions_for(captures.count(), lines_per_part), *order).sortWithinPartitions(*order)
    parts = materialise(dealt.mapInArrow(lambda b: write_part(b, folder, lines), "first string, last string, part string, n bigint"), "parts")
    return sorted((r["first"], r["last"], r["part"]) for r in parts.collect())


def find(keys: DataFrame, folder: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    """The captures of the keys (column key), found through the index."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(folder, parts)
        for batch in batches:
            for key in batch.column("key").to_pylist():
                at = np.fromiter(lookup.parts_of(key), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at)], names=["key", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, held = Lookup(folder, parts), []

        def out() -> pa.RecordBatch:
            columns, kinds = list(zip(*held, strict=True)), (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "file", "offset", "length"])

        for batch in batches:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                for rows in lookup.find(key, part):
                    held += rows
                    if len(held) >= BLOCK_LINES:
                        yield out()
                        held.clear()
        if held:
            yield out()

    placed = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(place, "key string, part int")
    return placed.repartitionById(max(1, len(parts)), F.col("part")).sortWithinPartitions("part", "key").mapInArrow(search, CAPTURE)


RECORD = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def fetch(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the captures, read range by range and checked against their digests."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = FileSystem.from_uri(folder)
        path, source = "", None
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != path:
                    path, source = file, store.open_input_file(file)
                found = parse(source.read_at(length, offset))
                rows.append([found[n] for n in names])
                held += len(found["payload"]) if payload else 256
                if held >= HANDED_BYTES:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    placed = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, RECORD + ", payload binary" * payload)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages, indexes them, looks every URL up again and reads the records back."""
    folder = new_dir(spark, "warc")
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1])
    captures = write(pages, folder)
    parts = index(captures, folder)
    found = fetch(find(captures, folder, parts), folder, payload=False)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
