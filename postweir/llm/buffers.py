"""Texts of an Arrow batch as one byte array, and word and shingle hashes over it (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20240611)
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, and the n + 1 bounds of its texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def kept_columns(keep: list[str]) -> Column:
    """(kept): the columns `keep` as one, without `text`: a task that reads the text has it in a column of its own, and needs it only once."""
    return F.struct(*([F.col(f"`{c}`") for c in keep if c != "text"] or [F.lit(True).alias("none")])).alias("kept")


def unkept_columns(keep: list[str]) -> list[Column]:
    """The columns `keep` again."""
    return [F.col("text") if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in keep]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of texts of about `limit` bytes together."""
    first, count = 0, len(bounds) - 1
    while first < count:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `solid` bytes, else of `[^\\x20\\x09-\\x0D]`, in each text, and the n + 1 bounds of each text's runs."""
    if solid is None:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE))
    letters = BYTE_CODES[data[np.repeat(starts, lengths) + place]] * powers[place]
    return mix(np.add.reduceat(letters, firsts) + lengths.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` words in a row inside a text, and the n + 1 bounds of each text's grams."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    gram_bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(gram_bounds[-1]) + np.repeat(bounds[:-1] - gram_bounds[:-1], counts)
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total += hashes[at + i] * _GRAM_FACTORS[i]
    return mix(total), gram_bounds
