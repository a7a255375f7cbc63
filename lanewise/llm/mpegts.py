"""Media columns: MPEG transport streams.

A payload of 8-bit samples is stored as a transport stream of 188-byte packets: a program
association table, a program map table with one private elementary stream, then packetised
elementary packets (PES), one for each access unit of samples. Each access unit begins with a time
stamp (90 kHz) and a random-access mark, so a reader can enter there. Reading parses the tables
(with their checksums), checks sync bytes and continuity counters, reassembles the elementary
packets and returns the samples with time stamps and random-access points.

Defined results: null and empty texts are a payload of fill bytes of one block. Equal texts give
equal streams, repeated rows one each; empty tables none. A damaged stream raises ValueError, naming the packet. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, written

# Fixed values of the format
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0, 0x1000, 0x100, 0xBD, 0x06
CLOCK = 90_000
#: Samples a second, samples of a block, samples of an access unit (its PES packet stays below 64 KiB).
RATE, BLOCK, UNIT = 8_000, 576, 576 * 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = ((value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(value)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000)))
_PLAIN = [struct.pack(">BHB", SYNC, ES_PID, 0x10 | c) for c in range(16)]
_FITTED = [struct.pack(">BHB", SYNC, ES_PID, 0x30 | c) for c in range(16)]
_ENTRY = [struct.pack(">BHB", SYNC, 0x4000 | ES_PID, 0x30 | c) for c in range(16)]


def _stamp(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0xE, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1))


def _clock(t: int) -> bytes:
    return struct.pack(">IH", (t >> 1) & 0xFFFFFFFF, (t & 1) << 15 | 0x7E00)


def encode(samples: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """The transport stream of the samples."""
    out, counter = [_TABLES], 0
    for start in range(0, len(samples), unit):
        part = samples[start : start + unit]
        time = start * CLOCK // rate % (1 << 33)
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(part) + 8, 0x80, 0x80, 5) + _stamp(time) + part
        at, entry = 0, True
        while at < len(pes):
            left = len(pes) - at
            if entry:  # adaptation field with random-access mark and clock reference
                stuffing = max(0, 176 - left)
                out.append(_ENTRY[counter] + bytes((7 + stuffing, 0x50)) + _clock(time) + b"\xff" * stuffing)
                take, entry = 176 - stuffing, False
            elif left >= 184:
                out.append(_PLAIN[counter])
                take = 184
            else:
                stuffing = 183 - left
                out.append(_FITTED[counter] + bytes((stuffing,)) + (b"\0" + b"\xff" * (stuffing - 1) if stuffing else b""))
                take = left
            out.append(pes[at : at + take])
            at += take
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    samples: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    times: list[int] = field(default_factory=list)  # of access units, 90 kHz
    entries: list[int] = field(default_factory=list)  # byte offsets of random-access packets


def _body(section: bytes, table_id: int) -> bytes:
    length = 3 + (struct.unpack_from(">H", section, 1)[0] & 0xFFF)
    if section[0] != table_id or length > len(section) or section_crc(section[:length]):
        raise ValueError(f"table {table_id} is damaged")
    return section[8 : length - 4]


def decode(media: bytes) -> Stream:
    """The stream's tables, samples, time stamps and random-access points."""
    if len(media) % PACKET:
        raise ValueError("the stream's last packet is cut")
    found, units, counters = Stream(packets=len(media) // PACKET), [], {}
    maps: set[int] = set()
    for at in range(0, len(media), PACKET):
        sync, head, flags = struct.unpack_from(">BHB", media, at)
        if sync != SYNC or head & 0x8000:
            raise ValueError(f"packet {at // PACKET}: no sync or a transport error")
        pid, control, counter = head & 0x1FFF, flags >> 4 & 3, flags & 15
        data, entry = at + 4, False
        if control & 2:
            size = media[data]
            entry = size > 0 and bool(media[data + 1] & 0x40)
            data += 1 + size
        if not control & 1:
            continue
        if counters.setdefault(pid, counter) != counter:
            raise ValueError(f"packet {at // PACKET}: continuity counter {counter}, not {counters[pid]}")
        counters[pid] = (counter + 1) & 15
        body = media[data : at + PACKET]
        if pid == PAT_PID:
            programs = _body(body[1 + body[0] :], 0)
            found.programs = {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", programs)}
            maps = set(found.programs.values())
        elif pid in maps:
            listed = _body(body[1 + body[0] :], 2)
            place = 4 + (struct.unpack_from(">H", listed, 2)[0] & 0xFFF)
            while place < len(listed):
                kind, es, info = struct.unpack_from(">BHH", listed, place)
                found.streams[es & 0x1FFF] = kind
                place += 5 + (info & 0xFFF)
        elif pid in found.streams:
            if entry:
                found.entries.append(at)
            if head & 0x4000:
                units.append([body])
            elif units:
                units[-1].append(body)
            else:
                raise ValueError("an elementary packet begins in its middle")
    samples = []
    for parts in units:
        pes = b"".join(parts)
        code, length = struct.unpack_from(">IH", pes, 0)
        if code >> 8 != 1 or length + 6 != len(pes):
            raise ValueError("an elementary packet is incomplete")
        if pes[7] & 0x80:
            a, b, c, d, e = pes[9:14]
            found.times.append((a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1)
        samples.append(pes[9 + pes[8] :])
    found.samples = b"".join(samples)
    return found


def index_of(samples: int, unit: int = UNIT, rate: int = RATE) -> tuple[list[int], list[int]]:
    """The time stamps of a stream's access units, and the byte offsets of the packets that they begin in."""
    times, entries, packets = [], [], len(_TABLES) // PACKET
    for start in range(0, samples, unit):
        times.append(start * CLOCK // rate % (1 << 33))
        entries.append(packets * PACKET)
        pes = 14 + min(unit, samples - start)
        packets += 1 + -(-max(0, pes - 176) // 184)
    return times, entries


def payload(text: str | None, block: int = BLOCK) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with bytes 255 up to a positive multiple of the block; and their number unfilled."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // block)) * block, b"\xff"), len(raw)


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stream), times and entries (time stamps and byte offsets of random-access points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, held = 0, []
            for i in range(batch.num_rows):
                data, n = payload(batch.column(1)[i].as_py())
                media = encode(data)
                held.append((batch.column(0)[i].as_py(), n, media, *index_of(len(data))))
                size += len(media)
                if size > 16 << 20:
                    yield pack(held, batch.schema.field(0).type)
                    size, held = 0, []
            if held:
                yield pack(held, batch.schema.field(0).type)

    def pack(held: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in held], kind), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.binary()), *[pa.array([x[j] for x in held], pa.list_(pa.int64())) for j in (3, 4)]], names=["doc_id", "n_bytes", "media", "times", "entries"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, times array<long>, entries array<long>")


def feature_of(found: Stream) -> str:
    x = np.frombuffer(found.samples, np.uint8)
    mean, spread = float(x.mean()), float(x.std())
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    last = found.times[-1] if found.times else 0
    return f"programs={len(found.programs)};streams={len(found.streams)};packets={found.packets};units={len(found.times)};entries={len(found.entries)};last={last};mean={mean:.4f};std={spread:.4f};crossings={crossings}"


def digests(media: DataFrame) -> DataFrame:
    """What reading each stored stream gives: sizes, checksums and a feature; its times and entries must be the stored ones."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "random_access_points", "last_time"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, times, entries in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                raw = x.as_py()
                found = decode(raw)
                if found.times != times.as_py() or found.entries != entries.as_py():
                    raise ValueError("the stored time stamps or random-access points aren't the stream's")
                rows.append((len(found.samples), hashlib.sha256(found.samples).hexdigest(), zlib.crc32(found.samples[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(found), len(found.entries), found.times[-1]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([*batch.columns[:2], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media", "times", "entries").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, random_access_points long, last_time long")


def random_access(media: DataFrame) -> DataFrame:
    """doc_id, number, time, byte_offset: a row for each stored random-access point, without reading the streams."""
    points = media.select("doc_id", F.posexplode(F.arrays_zip("times", "entries")).alias("number", "x"))
    return points.select("doc_id", "number", F.col("x.times").alias("time"), F.col("x.entries").alias("byte_offset"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(written(stored(table(spark, sf_dir, "documents")), "media"))
