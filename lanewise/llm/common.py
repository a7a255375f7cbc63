"""Helpers shared by the operators: tables, shared scratch folders, text batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import shared_dir, written

__all__ = ["CHUNK_BYTES", "WordHasher", "checkpointed", "coded", "decoded", "fresh", "mixed", "shared_dir", "spread", "table", "text_chunks", "written"]

#: Bytes of text that the numpy helpers work on at once; bounds a task's temporary arrays.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, for what is added to it for a while."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def coded(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, .., so that any others can stand beside them."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def decoded(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1, .. of df under their names again, all others left out."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession, "")
    return df.checkpoint(eager=True)


def text_chunks(column: pa.Array, pad: int = 0, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string or binary column as (first row, bytes, offsets of each row's text and the end).

    A slice holds whole texts, about `limit` bytes of them (a longer text stands alone). With pad > 0,
    so many zero bytes stand before each text; offsets then point behind them. Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        part = data[offsets[row] : offsets[stop]]
        starts = offsets[row : stop + 1] - offsets[row]
        if pad:
            lengths = np.diff(starts)
            target = starts + pad * np.arange(1, stop - row + 2)
            spread = np.zeros(len(part) + pad * (stop - row), np.uint8)
            spread[np.arange(len(part)) + np.repeat(target[:-1] - starts[:-1], lengths)] = part
            yield row, spread, target
        else:
            yield row, part, starts
        row = stop


_POWER = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of white-space-separated words, for all words of a byte slice at once.

    A word's hash is the difference of two prefix sums of byte * p**position, brought back to
    position 0 by the inverse of p (p is odd, so it has one modulo 2**64), then mixed.
    """

    def __init__(self) -> None:
        self._size = 0

    def _grow(self, n: int) -> None:
        if n > self._size:
            self._size = n + n // 2 + 1
            inverse = pow(int(_POWER), -1, 1 << 64)
            self._up = _powers(_POWER, self._size)
            self._down = _powers(np.uint64(inverse), self._size)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
        """(hash, start, end, row) of each word; offsets are the rows' bounds in data, without gaps.

        For each length in prefixes, the hashes of the words cut to that many bytes follow.
        """
        n = len(data)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~space
        if n and len(offsets) > 2:
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
        else:
            cut = np.zeros(0, np.int64)
        edge = np.diff(inside)
        begins, ends = edge[:-1] == 1, edge[1:] == -1
        # a row's border also ends a word
        joined = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        begins[joined] = True
        ends[joined - 1] = True
        starts, stops = np.flatnonzero(begins[:n]), np.flatnonzero(ends[:n]) + 1
        self._grow(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=prefix[1:])
        of = lambda ends: mixed((prefix[ends] - prefix[starts]) * self._down[starts])
        return of(stops), starts, stops, np.searchsorted(offsets, starts, side="right") - 1, *[of(np.minimum(stops, starts + k)) for k in prefixes]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (sizes[0] of them), then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their low bits are usable as buckets."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
