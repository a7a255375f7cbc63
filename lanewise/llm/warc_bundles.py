"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames followed by a skippable frame
with a seek table (a pair of sizes for each frame, then the footer), so any Zstandard reader reads
it as one stream and a seeking reader decodes single frames. An index maps each record to its
bundle, frame and offset within the frame.

Records of equal payloads are written once: the one with the largest page_id as `response`, the
others as `revisit` records that name it and carry the payload's digest and length but no body.
Payloads below `min_bytes` are always written in full.

Bundles are rows of a Parquet table (column `bundle`), as Spark can write that to any store.

Defined results: null html is an empty payload, null url an empty target. Repeated rows of the
largest page_id are each a response. Of rows without an id, those whose payload no numbered row
has are responses, others revisit it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import table, written

# Fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, of frames in a bundle (uncompressed), and the level.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 16 << 20, 3
#: Payloads of fewer bytes are never written as revisits.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def digest_text(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(key: str, url: str, kind: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Groups records into frames; `close` gives the bundle with its seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self._compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self._frame_bytes, self._frame, self._held = frame_bytes, [], 0
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Takes a record; returns its frame and its offset there."""
        if self._held and self._held + len(data) > self._frame_bytes:
            self._end_frame()
        at = len(self._frames), self._held
        self._frame.append(data)
        self._held += len(data)
        self.bytes += len(data)
        return at

    def _end_frame(self) -> None:
        if self._held:
            packed = self._compress(b"".join(self._frame))
            self._frames.append(packed)
            self._sizes.append((len(packed), self._held))
            self._frame, self._held = [], 0

    def close(self) -> bytes:
        self._end_frame()
        rows = b"".join(struct.pack("<II", *x) for x in self._sizes)
        foot = struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        return b"".join([*self._frames, struct.pack("<II", SKIPPABLE, len(rows) + len(foot)), rows, foot])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    step = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - n * step
    if magic != SEEKABLE or start < 8 or struct.unpack_from("<I", bundle, start - 8)[0] != SKIPPABLE:
        raise ValueError("the bundle has no seek table")
    out, at = [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", bundle, start + i * step)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers, the block and the end of the record that begins at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[end + 4 : stop], stop + 4


def classified(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to. Only digests and ids are grouped; the join splits hot payloads."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.sha2(html.cast("binary"), 256).alias("strong"), F.octet_length(html).alias("size"))
    groups = own.groupBy("digest", "strong").agg(F.max("page_id").alias("kept"))
    many = own.join(groups, ["digest", "strong"])
    first = F.col("kept").isNull() | F.coalesce(F.col("page_id") == F.col("kept"), F.lit(False)) | (F.col("size") < min_bytes)
    return many.select("page_id", "url", "html", "digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("kept")).alias("refers_to"))


def bundles(pages: DataFrame, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """bundle, and its index as arrays record_keys, frames, offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index = BundleWriter(frame_bytes), []
        for batch in batches:
            for page, url, html, sha1, kind, refers in zip(*batch.columns, strict=True):
                key = f"urn:page:{page.as_py() if page.is_valid else ''}"
                refers_to = f"urn:page:{refers.as_py()}" if refers.is_valid else None
                target = url.as_py().replace("\r", "%0D").replace("\n", "%0A")
                data = record(key, target, kind.as_py(), digest_text(sha1.as_py()), html.as_py().encode("utf-8", "surrogatepass"), refers_to)
                index.append((key, *writer.add(data)))
                if writer.bytes >= bundle_bytes:
                    yield row(writer, index)
                    writer, index = BundleWriter(frame_bytes), []
        if index:
            yield row(writer, index)

    def row(writer: BundleWriter, index: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([writer.close()], pa.binary()), *[pa.array([[x[i] for x in index]], pa.list_(k)) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))]], names=["bundle", "record_keys", "frames", "offsets"])

    return classified(pages, min_bytes).select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(run, "bundle binary, record_keys array<string>, frames array<int>, offsets array<long>")


def index_of(stored: DataFrame) -> DataFrame:
    """record_key, bundle_sha1, frame, offset: where each record is."""
    zipped = F.explode(F.arrays_zip("record_keys", "frames", "offsets"))
    return stored.select(F.sha1("bundle").alias("bundle_sha1"), zipped.alias("x")).select(F.col("x.record_keys").alias("record_key"), "bundle_sha1", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset"))


def records(stored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, frame, offset, read from the bundles.

    A response's digest is computed anew from the payload read; it must be the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0):
                raw = bundle.as_py()
                rows = []
                for frame in range(len(seek_table(raw))):
                    data, at = read_frame(raw, frame), 0
                    while at < len(data):
                        start = at
                        head, block, at = parse(data, at)
                        cut = block.index(b"\r\n\r\n") + 4
                        size = next(int(x[15:]) for x in block[:cut].split(b"\r\n") if x.startswith(b"Content-Length:"))
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        if kind == "response":
                            body = block[cut:]
                            if len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"{head['WARC-Record-ID']}: the payload isn't what was written")
                        page = head["WARC-Record-ID"][1:-1].rpartition(":")[2]
                        refers = head.get("WARC-Refers-To", "")[1:-1].rpartition(":")[2]
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, frame, start))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset"])

    return stored.select("bundle").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, frame int, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    stored = written(bundles(table(spark, sf_dir, "pages")), "warc", codec="uncompressed")
    return records(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: base32 of the digest by its 40-bit groups of 8 letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d"""
