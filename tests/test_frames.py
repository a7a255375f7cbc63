"""Zstandard files of many frames: every cut into ranges gives the lines of the whole text, in tasks of their own."""

import random
import struct

import pytest
import zstandard

from lanewise.sources.frames import Bytes, frame_end, lines_of_range, write_frames
from lanewise.sources.ingest import ingest, read_lines

pack = zstandard.ZstdCompressor().compress
SEEK_TABLE = struct.pack("<II", 0x184D2A5E, 21) + b"\x28\xb5\x2f\xfd" + bytes(17)  # what is skipped may look like a frame


def lines_of(text: bytes) -> list[bytes]:
    lines = text.split(b"\n")
    return lines[:-1] if not lines[-1] else lines


@pytest.mark.parametrize("seed", range(30))
def test_ranges_hold_each_line_once(tmp_path, seed):
    rng = random.Random(seed)
    line = lambda: bytes(rng.choices(b"abc\r", k=rng.choice([0, 0, 1, 5, 300, 5000])))
    text = b"\n".join(line() for _ in range(rng.choice([0, 1, 3, 60]))) + rng.choice([b"", b"\n", b"\n\n"])
    cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(12)))
    if rng.random() < 0.3:  # frames that end with their lines
        cuts = [i + 1 for i, c in enumerate(text) if c == 10 and rng.random() < 0.5]
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    frames = [pack(p) + (SEEK_TABLE if rng.random() < 0.2 else b"") for p in parts]
    path = tmp_path / "x.zst"
    path.write_bytes(rng.choice([b"", SEEK_TABLE]) + b"".join(frames))
    size = path.stat().st_size
    for step in (1 << 20, 100, rng.randrange(8, 60)):
        got = [x for a in range(0, size, step) for x in lines_of_range(Bytes(str(path)), a, a + step)]
        assert got == lines_of(text)


def test_frame_ends(tmp_path):
    checked = zstandard.ZstdCompressor(write_checksum=True).compress(random.Random(1).randbytes(400_000))
    streamed = zstandard.ZstdCompressor().compressobj()
    unsized = streamed.compress(b"a" * 1_000_000) + streamed.flush()
    path = tmp_path / "x.zst"
    path.write_bytes(checked + unsized + unsized[:-1])
    data = Bytes(str(path))
    assert frame_end(data, 0) == len(checked) and frame_end(data, len(checked)) == len(checked) + len(unsized)
    assert frame_end(data, len(checked) + len(unsized)) is None and frame_end(data, 1) is None
    with pytest.raises(ValueError, match="cut off"):
        list(lines_of_range(data, 0, data.size))


def test_frames_are_tasks_and_rows_those_of_the_codec(spark, tmp_path):
    log = ["Kanata\t0004", *[f"I\t{i}\t{i}\t0" for i in range(4000)]]
    text = ("\r\n".join(log) + "\r\n").encode()
    step = -(-len(text) // 8)
    frames = [pack(text[a : a + step]) for a in range(0, len(text), step)]
    (tmp_path / "a b.zst").write_bytes(b"".join(frames))
    (tmp_path / "plain.log").write_bytes(text)
    (tmp_path / "none.zst").write_bytes(b"")
    got = read_lines(spark, str(tmp_path), min(map(len, frames)))
    want = read_lines(spark, str(tmp_path))
    texts = lambda df: {t: [r.value for r in df.where(df.trace == t).orderBy("block", "pos").collect()] for t in [r.trace for r in df.select("trace").distinct().collect()]}
    assert texts(got) == texts(want) and list(texts(got).values()) == [log, log]
    zst = got.where(got.trace.endswith(".zst"))
    assert len({r.block for r in zst.select("block").distinct().collect()}) == 8
    assert max(len(p) for p in zst.rdd.glom().collect()) < len(log) / 4
    with pytest.raises(ValueError, match="empty_file"):
        ingest(spark, str(tmp_path), range_bytes=1000)


def test_written_frames_are_read_again(spark, tmp_path):
    rows = [(n, i, f"{n} {i} ä" + "x" * (i % 50)) for n in ("p", "q") for i in range(500)]
    done = write_frames(spark.createDataFrame(rows, "name string, pos long, value string"), str(tmp_path / "out"), 1000).collect()
    assert {r.name for r in done} == {"p", "q"} and all(r.frames > 10 and r.bytes == (tmp_path / "out" / f"{r.name}.zst").stat().st_size for r in done)
    got = read_lines(spark, str(tmp_path / "out"), 700).orderBy("trace", "block", "pos").collect()
    assert [r.value for r in got] == [r[2] for r in rows]
    assert write_frames(spark.createDataFrame([], "name string, pos long, value string"), str(tmp_path / "none")).count() == 0
