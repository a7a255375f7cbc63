"""Packing documents into sequences of tokens: Martello-Toth reduction, then best fit.

Documents are tokenised, the end token follows, and those longer than a sequence are cut (the first
piece is the shorter one). Piece lengths are whole numbers up to the sequence's capacity, so an
instance of any size is a histogram of at most `capacity` counts, and packing it is exact work on
counts: equal pieces are placed as runs. Each placement of a run is one row of a small plan; pieces
then find their place by their rank among pieces of their length.

Reduction, on counts, from the longest length w down, with r = capacity - w left beside it:
  * nothing fits beside w: each such piece alone is a full answer;
  * the longest piece k that fits fills r, or no two pieces fit beside w: then no set that holds w
    has more beside it than k, so {w, k} dominates (exchange that set's other pieces for k).
Fixed sets leave the instance; this repeats until nothing dominates. The rest goes by best fit in
decreasing length: each run goes to the fullest open sequences that still hold it.

Defined results: null and empty texts are the end token alone. Very long texts are cut into as many pieces as they fill.
Repeated rows are packed each. Rows with a null id are packed too. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import table, written

CAPACITY = 1024
END_TOKEN = 2
TOKENIZER = "byte_bpe_50k"
#: Parts into which pieces of one length are dealt for ranking, at least, so that a frequent length is no hot key, and
#: pieces that a part has on average beyond that.
RANK_PARTS, RANK_ROWS = 64, 1 << 18


@cache
def encoder(name: str = TOKENIZER):
    """Text -> ids of the tokenizer's vocabulary, the special string <|endoftext|> as its own id.

    Uses the rank file of the same vocabulary, which a test holds against the other library's ids.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    coding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coding.encode_to_numpy(text, allowed_special="all") if "<|endoftext|>" in text else coding.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [])
            texts = batch.column(1)
            for row in range(batch.num_rows):
                own = np.append(encode(texts[row].as_py() or ""), end_token).astype("<u4")
                first = len(own) % capacity or capacity
                doc, start = ids[row].as_py(), 0
                for number, stop in enumerate(range(first, len(own) + 1, capacity)):
                    for column, value in zip(out, (doc, number, start, stop - start, zlib.crc32(own[start:stop].tobytes())), strict=True):
                        column.append(value)
                    start = stop
            yield pa.record_batch([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _largest(lengths: list[int], counts: dict[int, int], beside: int, room: int) -> int | None:
    """The longest piece that fits in room beside one of length `beside`."""
    at = bisect_right(lengths, room) - 1
    if at >= 0 and lengths[at] == beside and counts[beside] == 1:
        at -= 1
    return lengths[at] if at >= 0 else None


def _two_smallest(lengths: list[int], counts: dict[int, int], beside: int) -> float:
    """The sum of the two shortest pieces without one of length `beside`; infinite if there aren't two."""
    found: list[int] = []
    for x in lengths[:3]:
        found += [x] * min(2, counts[x] - (x == beside))
    return found[0] + found[1] if len(found) > 1 else float("inf")


def reduced(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int | None, int]], dict[int, int]]:
    """Sets (length, length beside it or none, how many) that some best answer holds, and the counts left.

    Each fixed set may make others dominate, so this goes on until none does.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    sets: list[tuple[int, int | None, int]] = []

    def take(length: int, n: int) -> None:
        counts[length] -= n
        if not counts[length]:
            del counts[length]

    moved = True
    while moved:
        moved = False
        for length in sorted(counts, reverse=True):
            while counts.get(length):
                room = capacity - length
                lengths = sorted(counts)
                k = _largest(lengths, counts, length, room)
                if k is None:
                    n = counts[length]
                elif k == room or _two_smallest(lengths, counts, length) > room:
                    n = counts[length] // 2 if k == length else min(counts[length], counts[k])
                    take(k, n)
                else:
                    break
                take(length, n)
                sets.append((length, k, n))
                moved = True
    return sets, counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset): rank r lies in sequence first + r - first rank.

    A run that meets a group of open sequences uses up its own pieces or the whole group, so there
    are at most a few runs for each length and sequence group, however many pieces there are.
    """
    sets, counts = reduced(histogram, capacity)
    placed = dict.fromkeys(histogram, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, placed[length], placed[length] + n, first, offset))
        placed[length] += n

    for length, beside, n in sets:
        place(length, n, sequences, 0)
        if beside is not None:
            place(beside, n, sequences, length)
        sequences += n
    # best fit, decreasing: open[room] has runs of sequences with that room left
    open_rooms: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_rooms:
                open_rooms[room] = []
                insort(rooms, room)
            open_rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        while counts.get(length):
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-counts[length] // (capacity // length))
                add(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            first, n = open_rooms[room].pop()
            if not open_rooms[room]:
                del open_rooms[room]
                rooms.remove(room)
            use = min(n, counts[length])
            place(length, use, first, capacity - room)
            counts[length] -= use
            add(room - length, first, use)
            add(room, first + use, n - use)
    return runs


def ranked(found: DataFrame, histogram: dict[int, int], least: int = RANK_PARTS, rows: int = RANK_ROWS) -> DataFrame:
    """found with rank: its number among the pieces of its length, from 0, gapless and stable.

    histogram has the pieces of each length; frequent lengths are dealt into more parts.
    """
    parts = [(length, max(least, -(-n // rows))) for length, n in histogram.items()]
    deal = found.sparkSession.createDataFrame(parts, "length long, parts long")  # at most `capacity` rows
    dealt = found.join(F.broadcast(deal), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    totals = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    # the window's partitioning serves the join too
    return dealt.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (pieces) with sequence_id and offset."""
    histogram = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    shared = found.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        width = int(table_[:, 2].max()) + 1 if len(table_) else 1
        keys = table_[:, 0] * width + table_[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            hit = table_[at] if len(table_) else np.zeros((batch.num_rows, 5), np.int64)
            yield pa.record_batch([*batch.columns[:5], pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ready = ranked(found, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(written(pieces(docs), "pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
